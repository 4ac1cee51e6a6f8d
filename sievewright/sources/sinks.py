"""Writers: Spark's commit protocol makes each all-or-nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, shard: Column, files: int | None = None) -> None:
    """Compressed JSON lines, one folder a shard. A large shard is spread over several files by a hash of its rows."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files or 1))
    spread = df.withColumn("shard", shard).withColumn("__salt", salt)
    spread.repartition("shard", "__salt").drop("__salt").write.partitionBy("shard").mode("overwrite").option("compression", "gzip").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    df.write.mode("append").json(path)


def write_run(scores: DataFrame, summary: DataFrame, path: str, run_id: str) -> None:
    """Rows and summary of a run beside those of other runs."""
    for name, part in (("rows", scores), ("summary", summary)):
        part.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").parquet(f"{path}/{name}")


def run_index(spark, path: str) -> DataFrame:
    """All runs of a folder, the last identifier first."""
    return spark.read.parquet(f"{path}/summary").orderBy(F.col("run_id").desc_nulls_last())


def disagreement_report(verdicts: DataFrame, fields: tuple[str, ...], key: str, values: DataFrame | None = None) -> DataFrame:
    """One row per failing field of a record; with `values` (key, and `left_f`, `right_f` of each field f) beside what either side holds."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ok")) for f in fields])).alias("x")
    failing = verdicts.select(key, pairs).where("NOT x.ok").select(key, "x.field")
    if values is None:
        return failing
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"left_{f}").cast("string").alias("left"), F.col(f"right_{f}").cast("string").alias("right")) for f in fields])).alias("x")
    return failing.join(values.select(key, texts).select(key, "x.*"), [key, "field"], "left")


def report_text(report: DataFrame, key: str) -> DataFrame:
    """A section of text per record: its failing fields in the order of the alphabet."""
    line = F.concat(F.lit("- "), F.col("field"), F.lit(": "), F.coalesce("left", F.lit("")), F.lit(" | "), F.coalesce("right", F.lit("")))
    lines = report.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # one record has as many lines as fields
    return lines.select(key, F.concat(F.lit("## "), F.col(key).cast("string"), F.lit("\n"), F.array_join("lines", "\n")).alias("section"))


def nested_payload(df: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Flat columns as one nested JSON document a row."""
    parts = [F.struct(*[F.col(c) for c in columns]).alias(name) for name, columns in groups.items()]
    return df.select(key, F.to_json(F.struct(F.col(key), *parts)).alias("payload"))


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    """A small export as one CSV file with a header: written whole or not at all by the commit protocol."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
