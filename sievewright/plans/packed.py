"""Queries of packed fields: notes of landed rows and affiliation entries of gold authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.packed import split_packed
from sievewright.session import table

KEYS = ["src", "row_key", "author_pos", "aff_pos"]


def packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that may hold several values, with where it stands; exploding happens in the JVM, before Python."""
    notes = table(spark, sf_dir, "delta").select(
        F.lit("delta").alias("src"),
        F.col("row_id").alias("row_key"),
        F.lit(-1).alias("author_pos"),
        F.lit(-1).alias("aff_pos"),
        F.col("notes").alias("text"),
    )
    authors = table(spark, sf_dir, "gold_rows").select("rec_no", F.posexplode("authors").alias("author_pos", "author"))
    entries = authors.select("rec_no", "author_pos", F.posexplode("author.affiliations").alias("aff_pos", "text"))
    return notes.unionByName(
        entries.select(F.lit("gold_rows").alias("src"), F.col("rec_no").alias("row_key"), "author_pos", "aff_pos", "text")
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of each field that holds more than one."""
    return split_packed(packed_fields(spark, sf_dir), "text", KEYS, least=2)


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields of each source hold how many values."""
    per_field = split_packed(packed_fields(spark, sf_dir), "text", KEYS).groupBy(*KEYS).agg(F.count("*").alias("n_values"))
    return per_field.groupBy("src", "n_values").agg(F.count("*").alias("n_fields"))


QUERIES = {"p6_found": found, "p6_value_counts": value_counts}
ORACLE: dict[str, str] = {}
