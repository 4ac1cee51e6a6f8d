"""Reconciling repeated extractions of one record without losing good values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators.records import one_per_key


def fill(base: Column, delta: Column, allowed: Column | bool = True) -> Column:
    """The base value; the delta where base is empty, delta is not, and filling is allowed."""
    ok = allowed if isinstance(allowed, Column) else F.lit(allowed)
    return F.when(tx.absent_list(base) & ~tx.absent_list(delta) & ok, delta).otherwise(base)


def merge_filled(base: DataFrame, delta: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Base rows with empty fields filled from delta, except where the trusted side says the field is empty.

    delta and gold hold one row a key. Besides the merged fields, `filled` and `held_back` count what was done per row.
    """
    d = delta.select(key, *[F.col(f).alias(f"d_{f}") for f in fields])
    g = gold.select(key, F.lit(True).alias("has_gold"), *[F.col(f).alias(f"g_{f}") for f in fields])
    joined = base.select(key, *fields).join(d, key, "left").join(g, key, "left")
    can = {f: tx.absent_list(F.col(f)) & ~tx.absent_list(F.col(f"d_{f}")) for f in fields}
    denied = {f: F.col("has_gold").isNotNull() & tx.absent_list(F.col(f"g_{f}")) for f in fields}
    count = lambda cs: sum((F.when(c, 1).otherwise(0) for c in cs), F.lit(0))
    return joined.select(
        key, *[F.when(can[f] & ~denied[f], F.col(f"d_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        count(can[f] & ~denied[f] for f in fields).alias("filled"), count(can[f] & denied[f] for f in fields).alias("held_back"),
    )


def best_rerun(runs: DataFrame, key: str, score: str, source: str) -> DataFrame:
    """Per key the run with the most named authors; ties go to the source first in the alphabet."""
    return one_per_key(runs, key, -F.coalesce(F.col(score), F.lit(-1)), F.col(source))


def overlay(parts: list[DataFrame], key: str) -> DataFrame:
    """Later parts replace earlier ones row by row, whatever they hold."""
    ranked = parts[0].withColumn("__p", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        ranked = ranked.unionByName(part.withColumn("__p", F.lit(i)))
    return one_per_key(ranked, key, -F.col("__p")).drop("__p")


def fill_rates(before: DataFrame, after: DataFrame, key: str, group: str, fields: list[str], least: int = 10) -> DataFrame:
    """Per group with at least `least` rows: share of filled fields before and after, and the difference."""
    rate = lambda df, side: df.groupBy(group).agg(F.count("*").alias(f"n_{side}"), *[F.avg((~tx.absent_list(F.col(f))).cast("int")).alias(f"{f}_{side}") for f in fields])
    joined = rate(before, "before").join(rate(after, "after"), group).where(F.col("n_before") >= least)
    return joined.select(group, "n_before", *[c for f in fields for c in (f"{f}_before", f"{f}_after", (F.round(F.col(f"{f}_after") - F.col(f"{f}_before"), 6)).alias(f"{f}_delta"))])


def named_map(cell: Column) -> Column:
    """'Name::Affiliation || Name::Affiliation' as entries (name, affiliations in order)."""
    parts = F.filter(F.split(cell, r"\s*\|\|\s*"), lambda p: F.trim(p) != "")
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "::", 1)).alias("name"), F.when(F.instr(p, "::") > 0, F.trim(F.element_at(F.split(p, "::", 2), -1))).alias("aff")))
    names = F.array_distinct(F.transform(pairs, lambda x: x["name"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.transform(F.filter(pairs, lambda x: x["name"] == n), lambda x: x["aff"]).alias("affiliations")))


def label_changes(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Counts of each label on both sides, missing ones as 0."""
    b = before.groupBy(label).agg(F.count("*").alias("n_before"))
    a = after.groupBy(label).agg(F.count("*").alias("n_after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return b.join(a, label, "full_outer").select(label, zero("n_before"), zero("n_after"))
