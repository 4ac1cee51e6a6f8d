import pytest

from sievewright.plans import pages


@pytest.fixture
def doubled(spark, tmp_path):
    """Gold records, each landed twice under one number."""
    rows = spark.read.parquet("/root/testdata/sf0.001/gold_rows.parquet").limit(12)
    rows.unionByName(rows).write.parquet(str(tmp_path / "gold_rows.parquet"))
    return str(tmp_path)


def test_round_trip_joins_no_pages(spark, doubled):
    """Every row is a page of its own, and neither side of a join holds pages."""
    df = pages.round_trip(spark, doubled)
    wanted = spark.read.parquet(f"{doubled}/gold_rows.parquet").where("size(authors) > 0 and length(trim(abstract)) > 3").count()
    assert [tuple(r) for r in df.collect()] == [(wanted, wanted)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "rec_no" not in plan.split("Aggregate")[0]
