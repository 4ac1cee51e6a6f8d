"""What append-only logs and run tables say: counts, latencies, rolling shares, run deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ordered computations over a group are cut into blocks of about this many numbers of the order column.
BLOCK = 50_000


#: Cells between the smallest and the largest value of a group, in which places of sorted values are looked up.
CELLS = 2000


def latency(log: DataFrame, value: str, *by: str) -> DataFrame:
    """Smallest, mean, median, 95th per cent point (place int(.95 n) - 1 of the sorted values) and largest, by group.

    Values are counted by CELLS equal cells first; only the cells that hold a wanted place are sorted, each by itself, so
    no task holds the values of a group.
    """
    kept = log.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g"), *by, F.col(value).alias("v"))
    ends = kept.groupBy("g").agg(*[F.first(c).alias(c) for c in by], F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("avg"))
    width = F.greatest((F.col("hi") - F.col("lo")).cast("double"), F.lit(1e-9))
    cells = kept.select("g", "v").join(ends.select("g", "lo", "hi"), "g").select("g", "v", F.floor((F.col("v") - F.col("lo")) / width * CELLS).alias("cell"))
    upto = F.sum("k").over(Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # over at most CELLS + 1 rows
    counts = cells.groupBy("g", "cell").agg(F.count("*").alias("k")).withColumn("upto", upto)
    n = F.col("n")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place.alias("place")) for name, place in (("low", F.floor((n - 1) / 2)), ("high", F.floor(n / 2)), ("p95", F.greatest(F.floor(n * 0.95) - 1, F.lit(0))))])
    asked = ends.select("g", F.explode(wanted).alias("w")).select("g", "w.name", "w.place")
    before = F.col("upto") - F.col("k")
    spots = counts.join(asked, "g").where((F.col("place") >= before) & (F.col("place") < F.col("upto"))).select("g", "cell", "name", (F.col("place") - before).alias("at"))
    inside = cells.join(spots.select("g", "cell").distinct(), ["g", "cell"], "left_semi").groupBy("g", "cell", "v").agg(F.count("*").alias("m"))
    ranked = inside.withColumn("sofar", F.sum("m").over(Window.partitionBy("g", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.join(spots, ["g", "cell"]).where((F.col("at") < F.col("sofar")) & (F.col("at") >= F.col("sofar") - F.col("m")))
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("v")))
    points = found.groupBy("g").agg(((at("low") + at("high")) / 2).alias("median"), at("p95").alias("p95"))
    return ends.join(points, "g").select(*by, "n", "lo", "avg", "median", "p95", "hi")


def _blocks(df: DataFrame, by: str, order: str, width: int, *totals: Column) -> DataFrame:
    """Per group and block of order numbers: the given aggregates. One row a block."""
    return df.groupBy(by, F.floor(F.col(order) / width).alias("block")).agg(*totals)


def running_sum(log: DataFrame, value: str, by: str, order: str, width: int = BLOCK) -> DataFrame:
    """Sum of a column up to each row of its group, as `total`; order is a whole number, unique within a group.

    Sums run within blocks of the order column, and blocks begin with the total of those before them: a group that
    holds most rows is spread over its blocks instead of being sorted in one task.
    """
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = _blocks(log, by, order, width, F.sum(value).alias("s")).select(by, "block", F.sum("s").over(before).alias("start"))
    inner = Window.partitionBy(by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select(by, order, F.col(value).alias("v")).withColumn("block", F.floor(F.col(order) / width)).join(starts, [by, "block"])
    part = F.sum("v").over(inner)
    total = F.when(part.isNull(), F.col("start")).otherwise(part + F.coalesce("start", F.lit(0)))
    return rows.select(by, order, total.alias("total"))


def carried(log: DataFrame, value: str, by: str, order: str, width: int = BLOCK) -> DataFrame:
    """The last value that is not NULL up to each row of its group, as `carried`; blocks as in running_sum."""
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    starts = _blocks(log, by, order, width, last.alias("s")).select(by, "block", F.last("s", ignorenulls=True).over(before).alias("start"))
    inner = Window.partitionBy(by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select(by, order, F.col(value).alias("v")).withColumn("block", F.floor(F.col(order) / width)).join(starts, [by, "block"])
    return rows.select(by, order, F.coalesce(F.last("v", ignorenulls=True).over(inner), "start").alias("carried"))


def rolling_share(log: DataFrame, flag: Column, by: str, order: str, size: int = 20, width: int = BLOCK) -> DataFrame:
    """Share of flagged rows among the last `size` rows of a group in order; NULL until that many were seen.

    Rows get consecutive numbers first (counts of earlier blocks, then row numbers within a block); the last size - 1
    rows of every run of `width` numbers are repeated in the next run, where the frame of its first rows needs them.
    """
    if size > width:
        raise ValueError("size may not exceed width")
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = _blocks(log, by, order, width, F.count("*").alias("s")).select(by, "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    rows = log.select(by, order, flag.cast("int").alias("f")).withColumn("block", F.floor(F.col(order) / width)).join(starts, [by, "block"])
    seq = rows.withColumn("n", F.col("start") + F.row_number().over(Window.partitionBy(by, "block").orderBy(order)) - 1).withColumn("part", F.floor(F.col("n") / width))
    again = F.when(F.col("n") % width >= width - (size - 1), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))
    spread = seq.select(by, order, "f", "n", "part", F.explode(again).alias("run"))
    w = Window.partitionBy(by, "run").orderBy("n").rowsBetween(-(size - 1), 0)
    share = F.when(F.col("n") >= size - 1, F.avg("f").over(w))
    return spread.select(by, order, share.alias("share"), "part", "run").where("part = run").drop("part", "run")


def shard_routes(df: DataFrame, prefix, least: int = 10) -> DataFrame:
    """Rows per shard: prefixes with at least `least` rows by themselves, the rest together."""
    counts = df.select(prefix.alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") >= least, F.col("prefix")).otherwise("_other").alias("shard")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_prefixes"))


def run_deltas(runs: DataFrame, metric: str, order: str, band: float = 0.002) -> DataFrame:
    """Each run beside the one before it: difference and direction, flat within the dead band. Runs are few."""
    w = Window.orderBy(order)
    d = runs.withColumn("previous", F.lag(metric).over(w)).withColumn("delta", F.col(metric) - F.col("previous"))
    return d.withColumn("direction", F.when(F.col("delta").isNull(), None).when(F.abs("delta") <= band, "flat").when(F.col("delta") > 0, "up").otherwise("down"))
