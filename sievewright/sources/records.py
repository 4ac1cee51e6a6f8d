"""Readers of record files: explicit schemas, nothing inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 12 columns of a landed record, order fixed.
COLUMNS = ("No", "DOI", "Link", "Authors", "Abstract", "PDF URL", "Status", "Notes", "Has Bot Check", "Resolves To PDF", "broken_doi", "no english")
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Quoted multi-line CSV with a header; rows without a number (the tail of a spreadsheet) are dropped, missing columns refused."""
    head = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in required if c not in head.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema)
    return rows.where(F.coalesce(F.trim("No"), F.lit("")) != "") if "No" in rows.columns else rows


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document that is one array of records; blank identifiers become NULL."""
    rows = spark.read.json(path, schema=schema, multiLine=True)
    trimmed = [F.nullif(F.trim(c), F.lit("")).alias(c) if c in ("DOI", "Link", "doi", "link") else F.col(f"`{c}`") for c in rows.columns]
    return rows.select(*trimmed)


def read_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines, the last line of a key wins; unreadable lines and lines without a key are skipped.

    Lines are numbered by file, block and place, so that later files (by name) and later lines win.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    parsed = lines.select("file", "block", "seq", F.from_json("value", schema).alias("r")).where(F.coalesce(F.trim(F.col(f"r.{key}").cast("string")), F.lit("")) != "")
    last = parsed.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", F.struct("file", "block", "seq")).alias("r"))
    return last.select("r.*")


def sniff(head: str, name: str) -> str:
    """Format of a record file by its name, else by its first characters."""
    low = name.lower()
    if low.endswith((".csv", ".json")):
        return low.rsplit(".", 1)[1]
    return "json" if head.lstrip()[:1] in ("[", "{") else "csv"


def alias(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each wanted column from the first of its aliases that is not empty."""
    have = set(df.columns)
    pick = lambda options: F.coalesce(*[F.nullif(F.col(f"`{o}`"), F.lit("")) for o in options if o in have], F.lit(None).cast("string"))
    return df.select(*[pick(options).alias(name) for name, options in names.items()])


def read_keyed(spark: SparkSession, path: str, key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV rows by key: trimmed, blank keys dropped, of several rows of a key the last one of the file (then of the last file)."""
    rows = read_csv(spark, path, required or (key,))
    placed = rows.withColumn("__at", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()))
    keyed = placed.withColumn(key, F.trim(f"`{key}`")).where(F.col(f"`{key}`") != "")
    last = keyed.groupBy(F.col(f"`{key}`").alias("__k")).agg(F.max("__at").alias("__at"))
    return keyed.join(last.select("__at"), "__at", "left_semi").drop("__at")


def missing_files(spark: SparkSession, folder: str, pattern: str, expected: int) -> DataFrame:
    """Numbers from 1 to expected of which no file of the folder bears one; pattern has the number as its only group."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").option("recursiveFileLookup", "true").load(folder).select("path")
    have = files.select(F.regexp_extract("path", pattern, 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("batch_no")).distinct()
    return spark.range(1, expected + 1).select(F.col("id").alias("batch_no")).join(have, "batch_no", "left_anti")
