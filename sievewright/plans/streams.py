"""Streaming queries over the fetch log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.session import table
from sievewright.streaming import logs


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_stream(spark, f"{d}/fetch_log.parquet", table(spark, d, "fetch_log").schema)


def status(spark: SparkSession, d: str) -> DataFrame:
    return logs.run_to_end(logs.status_counts(_stream(spark, d), "status"))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """Windows of event time; the watermark is wider than the log, so no entry of it is too late."""
    counts = logs.run_to_end(logs.windowed(_stream(spark, d).where(F.col("fetched_at").isNotNull()), "fetched_at", late="3650 days"))
    return counts.select(logs.wall(F.col("start")).alias("start"), "n")


def first_fetches(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, however often its fetches are read again."""
    firsts = logs.first_per_key(_stream(spark, d).where(F.col("fetched_at").isNotNull() & F.col("rec_no").isNotNull()), "rec_no", "fetched_at", "3650 days")
    return logs.run_to_end(firsts.select("rec_no"), "append")


QUERIES = {"stream_fetch_status": status, "stream_weekly": weekly, "stream_first_fetches": first_fetches}
ORACLE = {
    "stream_first_fetches": "select distinct rec_no from fetch_log where fetched_at is not null and rec_no is not null",
    "stream_fetch_status": "select status, count(*) as n, sum(attempts)::bigint as attempts from fetch_log group by 1",
    "stream_weekly": "select to_timestamp(floor(epoch(fetched_at) / 604800) * 604800)::timestamp as start, count(*) as n from fetch_log where fetched_at is not null group by 1",
}
