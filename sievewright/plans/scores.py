"""Graded scores and agreement of gold and parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.operators import agreement as ag
from sievewright.operators import scoring
from sievewright.operators.records import latest_rows
from sievewright.session import cut, table


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_rows(table(spark, d, "gold_rows"), table(spark, d, "parsed_rows"))


def _verdicts(spark: SparkSession, d: str, relaxed: bool) -> DataFrame:
    parsed = latest_rows(table(spark, d, "parsed_rows").select("rec_no", "parse_id", "parsed", "landed_at"), "rec_no", "landed_at", "parse_id")
    return ag.agreement(table(spark, d, "gold_rows"), parsed, relaxed)


QUERIES = {
    "row_scores": _scores,
    "score_overall": lambda s, d: scoring.summarise(_scores(s, d)),
    "score_by_publisher": lambda s, d: scoring.summarise(_scores(s, d), "publisher_domain"),
    "score_by_failure": lambda s, d: scoring.summarise(scoring.by_tag(_scores(s, d)), "failure_mode"),
    "score_by_run": lambda s, d: scoring.summarise(_scores(s, d), "run_id"),
    "score_slices": lambda s, d: scoring.by_slice(cut(_scores(s, d))),
    "agreement_strict": lambda s, d: ag.agreement_rates(_verdicts(s, d, False)),
    "agreement_relaxed": lambda s, d: ag.agreement_rates(_verdicts(s, d, True)),
    "disagreements": lambda s, d: _verdicts(s, d, True).where("NOT (authors AND rases AND corresponding AND abstract AND pdf_url)"),
}
ORACLE: dict[str, str] = {}
