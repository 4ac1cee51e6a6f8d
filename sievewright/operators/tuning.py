"""Where to put a match threshold: estimators over a column of ratios, each one aggregation over bins or values.

Empty input gives no row. Ties keep the first (lowest) value, as stated per estimator.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 200


def sweep(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """For each threshold, how many values reach it. One pass: conditional counts, turned into rows afterwards."""
    wide = df.agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("n_at_least")) for i, t in enumerate(thresholds)])).alias("r")
    return wide.select("n", rows).select("r.threshold", "r.n_at_least", "n")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts of BINS equal bins over 0 to 1; at most BINS rows whatever the input."""
    b = F.least(F.lit(BINS - 1), F.floor(F.col(value) * BINS)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def otsu(df: DataFrame, value: str) -> DataFrame:
    """The bin centre that parts the histogram with the greatest variance between classes (first of equal ones)."""
    h = histogram(df, value)
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most BINS rows
    sums = h.select(
        "bin", F.sum("n").over(order).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(order).alias("s0"),
        F.sum("n").over(Window.partitionBy()).alias("w"), F.sum(F.col("n") * F.col("bin")).over(Window.partitionBy()).alias("s"),
    ).where("w0 < w")
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1)
    best = sums.select("bin", between.alias("between")).agg(F.max(F.struct("between", (-F.col("bin")).alias("low"))).alias("b"))
    return best.where("b IS NOT NULL").select(((-F.col("b.low") + 0.5) / BINS).alias("threshold"))


def in_cells(df: DataFrame, cells: int = 2000) -> DataFrame:
    """`v` with its `cell`, one of `cells` + 1 between the smallest and the largest value, whatever their range."""
    ends = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    return df.join(F.broadcast(ends), how="cross").select("v", F.floor((F.col("v") - F.col("lo")) / width * cells).alias("cell"))


def largest_gap(df: DataFrame, value: str, floor: float = 0.5) -> DataFrame:
    """The widest gap between neighbouring distinct values from `floor` on (first of equal ones): its middle and its ends.

    No value gives (floor, floor, 1); a single one gives itself three times. Neighbours are found per bin first, so the
    window that closes gaps between bins sees one row a bin and not the whole column.
    """
    kept = in_cells(df.where(F.col(value) >= floor).select(F.col(value).cast("double").alias("v")).distinct()).withColumnRenamed("cell", "bin")
    inside = kept.withColumn("next", F.lead("v").over(Window.partitionBy("bin").orderBy("v"))).where("next IS NOT NULL").select("v", "next")
    ends = kept.groupBy("bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    across = ends.select(F.col("hi").alias("v"), F.lead("lo").over(Window.orderBy("bin")).alias("next")).where("next IS NOT NULL")
    best = inside.unionByName(across).agg(F.max(F.struct((F.col("next") - F.col("v")).alias("gap"), (-F.col("v")).alias("low"), F.col("next").alias("next"))).alias("g"))
    only = kept.agg(F.min("v").alias("only"))
    both = best.crossJoin(F.broadcast(only))  # one row each
    one = F.coalesce("only", F.lit(floor))
    return both.select(
        F.when(F.col("g").isNull(), one).otherwise((-F.col("g.low") + F.col("g.next")) / 2).alias("threshold"),
        F.when(F.col("g").isNull(), one).otherwise(-F.col("g.low")).alias("low"),
        F.when(F.col("g").isNull(), F.coalesce("only", F.lit(1.0))).otherwise(F.col("g.next")).alias("high"),
    )


def kde_valley(df: DataFrame, value: str, grid: int = 1000) -> DataFrame:
    """The lowest density between the two strongest peaks of a Gaussian kernel estimate; no row without two peaks.

    Defined on values rounded to 1 / `grid` (values lie between 0 and 1): they are aggregated to a histogram before densities
    are summed, so the join of grid and values is of bounded size on both sides.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.round(F.col(value) * grid).cast("int").alias("x")).agg(F.count("*").alias("k"))
    moments = df.agg(F.count(value).alias("n"), F.stddev(value).alias("sd")).where("n >= 4 AND sd > 0")
    points = spark.range(grid + 1).select((F.col("id") / grid).alias("at"))
    wide = 1.06 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    terms = points.join(F.broadcast(counts.join(F.broadcast(moments))), how="cross")
    z = (F.col("at") - F.col("x") / grid) / wide
    density = terms.groupBy("at").agg(F.sum(F.col("k") * F.exp(-z * z / 2)).alias("d"))
    order = Window.orderBy("at")
    near = density.select("at", "d", F.lag("d").over(order).alias("a"), F.lead("d").over(order).alias("b"))
    peaks = near.where("d > a AND d > b").orderBy(F.desc("d"), "at").limit(2).agg(F.min("at").alias("p"), F.max("at").alias("q"), F.count("*").alias("c")).where("c = 2")
    between = density.join(F.broadcast(peaks), (F.col("at") >= F.col("p")) & (F.col("at") <= F.col("q")))
    return between.groupBy("p", "q").agg(F.min(F.struct("d", "at")).alias("m")).select(F.col("m.at").alias("threshold"), F.col("p").alias("peak_low"), F.col("q").alias("peak_high"))


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Quantiles without interpolation: the value at place round(share * (n - 1)).

    Places are found in a histogram of cells first (a window over cells, not values); only the cells that hold one are
    then ordered, each by itself.
    """
    kept = in_cells(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")))
    cells = kept.groupBy("cell").agg(F.count("*").alias("k")).select("cell", "k", F.sum("k").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    total = df.agg(F.count(value).alias("n"))
    asked = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    places = asked.join(F.broadcast(total), how="cross").select("share", F.bround(F.col("share") * (F.col("n") - 1)).cast("long").alias("place"))
    inside = (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("k"))
    spots = cells.join(F.broadcast(places), inside).select("share", "cell", (F.col("place") - (F.col("upto") - F.col("k"))).alias("at"))
    order = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = kept.join(F.broadcast(spots.select("cell").distinct()), "cell").groupBy("cell", "v").agg(F.count("*").alias("m")).withColumn("sofar", F.sum("m").over(order))
    found = values.join(F.broadcast(spots), "cell").where((F.col("at") < F.col("sofar")) & (F.col("at") >= F.col("sofar") - F.col("m")))
    return found.select("share", F.col("v").alias("value"))


def bootstrap_of(df: DataFrame, value: str, estimator, rounds: int = 200, seed: int = 42, groups: int = 64) -> DataFrame:
    """2.5, 50 and 97.5 per cent points of an estimator (a function of a numpy array) over resamples of a bounded column.

    Resamples are drawn from the histogram of BINS bins (estimators see bin centres, at most 100,000 of them a round, a
    documented bound of the estimate), so their cost does not follow the rows; rounds are spread over `groups` tasks.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(F.least(F.lit(BINS - 1), F.floor(F.col(value) * BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    table = h.agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("t"))
    tasks = df.sparkSession.range(groups).join(F.broadcast(table), how="cross")  # one row beside a few

    def draw(parts):
        import numpy as np

        for pdf in parts:
            out = []
            for cell, t in zip(pdf["id"], pdf["t"], strict=True):
                centre, n = np.array([(x["bin"] + 0.5) / BINS for x in t]), np.array([x["n"] for x in t])
                rng = np.random.default_rng([seed, int(cell)])
                for _ in range(rounds // groups + (int(cell) < rounds % groups)):
                    if n.sum():
                        out.append(float(estimator(np.repeat(centre, rng.multinomial(min(int(n.sum()), 100_000), n / n.sum())))))
            yield pd.DataFrame({"mean": out})

    return nearest_rank(tasks.mapInPandas(draw, "mean double"), "mean", [0.025, 0.5, 0.975])


def bootstrap(df: DataFrame, value: str, rounds: int = 1000, seed: int = 42, cells: int = 64) -> DataFrame:
    """2.5, 50 and 97.5 per cent points of the mean over resamples. An estimate: resamples draw bins, each with its exact mean.

    Values are first aggregated to BINS sums, so a resample draws counts of bins and its cost does not follow the
    rows; the resamples are spread over `cells` tasks.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) * BINS).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    table = h.agg(F.array_sort(F.collect_list(F.struct("bin", "n", "m"))).alias("t"))
    tasks = df.sparkSession.range(cells).join(F.broadcast(table), how="cross")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for cell, t in zip(pdf["id"], pdf["t"], strict=True):
            n = np.array([x["n"] for x in t])
            m = np.array([x["m"] for x in t])
            if n.sum():
                rng = np.random.default_rng([seed, int(cell)])
                k = rounds // cells + (int(cell) < rounds % cells)
                out.extend((rng.multinomial(n.sum(), n / n.sum(), k) @ m / n.sum()).tolist())
        return pd.DataFrame({"mean": out})

    means = tasks.mapInPandas(lambda it: (draw(p) for p in it), "mean double")
    return nearest_rank(means, "mean", [0.025, 0.5, 0.975])
