import json

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import audit, correct, records, scoring, tuning
from sievewright.sources import records as src
from sievewright.sources import sinks


def test_best_name():
    assert correct.best_name("Jane Doe", ["Max Roe", "DOE, Jane"]) == "DOE, Jane"
    assert correct.best_name(" ", ["x"]) is None and correct.best_name("Jane", []) is None and correct.best_name("Jane Doe", ["Max Roe"]) is None


def test_corrections_of_author_cells():
    known = [("Jane Doe", ["A", "B"]), ("Max Roe", ["C"])]
    assert correct.correct_authors("", known)[1] == [("populate", "Jane Doe", "", "A; B"), ("populate", "Max Roe", "", "C")]
    assert correct.correct_authors("[broken", known) == ("[broken", []) and correct.correct_authors('{"a": 1}', known) == ('{"a": 1}', [])
    cell, log = correct.correct_authors(json.dumps([{"name": "Doe, Jane", "rasses": "old"}, "text", {"name": "Max Roe", "rasses": "C"}]), known)
    assert log == [("overwrite", "Doe, Jane", "old", "A; B")] and [a["rasses"] for a in json.loads(cell) if isinstance(a, dict)] == ["A; B", "C"]
    assert [c[0] for c in correct.correct_authors(json.dumps([{"name": "Eva Ek"}]), known)[1]] == ["append", "append"]


def test_fixes_are_joined(spark):
    gold = spark.createDataFrame([("10.1/a", None), ("10.1/b", "[]"), (None, "x")], "doi string, authors string").selectExpr("*", "1 as changes")
    deltas = spark.createDataFrame([(1, "10.1/a", "affiliations", "fix_gold", "Ann::Old"), (2, " 10.1/a ", "affiliations", "fix_gold", "Ann::Uni || Ann::Lab || Bo::"), (3, "10.1/b", "affiliations", "keep", "X::Y"), (4, None, "affiliations", "fix_gold", "X::Y")], "seq long, doi string, field string, suggested_action string, parser_value string")
    got = {r.doi: r for r in correct.apply_fixes(gold, deltas).collect()}
    assert json.loads(got["10.1/a"].authors) == [{"name": "Ann", "rasses": "Uni; Lab", "corresponding_author": False}] and len(got["10.1/a"].changes) == 1
    assert got["10.1/b"].authors == "[]" and got["10.1/b"].changes == [] and got[None].authors == "x"
    assert correct.apply_fixes(gold.limit(0), deltas).count() == 0


def test_fallback_and_character_changes(spark):
    rows = spark.createDataFrame([(1, "", "a", "note", "FALSE"), (2, "x", "b", None, "FALSE"), (3, "", "", None, None)], "k int, abstract string, pdf_url string, notes string, status string")
    second = spark.createDataFrame([(1, "found", "zz"), (2, "other", "")], "k int, abstract string, pdf_url string")
    got = {r.k: r for r in correct.with_fallback(rows, second, "k", ["abstract", "pdf_url"], "second try").collect()}
    assert (got[1].abstract, got[1].pdf_url, got[1].notes, got[1].status) == ("found", "a", "note | second try", "TRUE")
    assert (got[2].abstract, got[2].notes, got[2].status) == ("x", None, "FALSE") and got[3].status is None
    ops = correct.character_changes(rows.selectExpr("k", "'abcd' as x", "if(k = 1, 'abXd', if(k = 2, 'abcd', null)) as y"), "x", "y", ["k"]).collect()
    assert {(r.k, r.op, r.left_start, r.left_end) for r in ops} == {(1, "replace", 2, 3), (3, "delete", 0, 4)}


@pytest.mark.parametrize(("a", "b"), [
    ("https://www.sciencedirect.com/x/pdfft?md5=1&pid=2", "https://sciencedirect.com/x/pdf"), ("https://pubs.acs.org/doi/epdf/10.1/a?ref=article_openPDF", "https://pubs.acs.org/doi/pdf/10.1/a"),
    ("https://journals.lww.com/downloadpdf.aspx?trck=1&an=7", "https://journals.lww.com/downloadpdf.aspx?an=7"),
])
def test_addresses_of_one_file(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(tx.canonical_url(F.col("a")).alias("a"), tx.canonical_url(F.col("b")).alias("b")).first()
    assert r.a == r.b


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "one.csv").write_text('No,DOI,Notes\n1, 10.1/a ,first\n2,10.1/b,x\n3,10.1/a,last\n4,,none\n')
    assert {(r.DOI, r.Notes) for r in src.read_keyed(spark, str(tmp_path / "one.csv"), "DOI").collect()} == {("10.1/a", "last"), ("10.1/b", "x")}
    folder = tmp_path / "batches"
    folder.mkdir()
    for n in (1, 3):
        (folder / f"batch-{n}.csv").write_text("x\n")
    assert {r.batch_no for r in src.missing_files(spark, str(folder), r"batch-(\d+)\.csv", 4).collect()} == {2, 4}
    df = spark.createDataFrame([(2, "b", False), (1, 'a "q"', True)], "k int, t string, abstract boolean")
    sinks.export_csv(df, str(tmp_path / "out"), "k")
    assert [r.t for r in spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').collect()] == ['a "q"', "b"]
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    values = df.selectExpr("k", "t as left_abstract", "cast(null as string) as right_abstract")
    report = sinks.disagreement_report(df, ("abstract",), "k", values)
    assert [(r.k, r.field, r.left, r.right) for r in report.collect()] == [(2, "abstract", "b", None)]
    assert sinks.report_text(report, "k").first().section == "## 2\n- abstract: b | "
    assert json.loads(sinks.nested_payload(df, "k", {"texts": ["t"], "flags": ["abstract"]}).where("k = 2").first().payload) == {"k": 2, "texts": {"t": "b"}, "flags": {"abstract": False}}


def test_page_texts_and_numbers(spark):
    page = "<html><head><title>T</title><script>x()</script></head><body>" + "y" * 50 + "<!-- c --></body></html>"
    row = spark.createDataFrame([(page,)], "p string").select(audit.without_scripts(F.col("p"), 20).alias("t"), audit.page_state(F.col("p"), F.lit("https://x/challenge")).alias("s")).first()
    assert row.t.startswith("<head><title>T</title></head>") and len(row.t) == len("<head><title>T</title></head>") + 20 and "script" not in row.t
    assert row.s.blocked and not row.s.ok
    df = spark.createDataFrame([(i * 7 % 300, f"d{i}") for i in range(200)], "n long, d string")
    got = audit.numbered(df, "n", "d", width=20).orderBy("no").collect()
    assert [r.no for r in got] == list(range(1, 201)) and [(r.n, r.d) for r in got] == sorted((r.n, r.d) for r in got)


def test_bootstrap_of_an_estimator(spark):
    import numpy as np

    df = spark.createDataFrame([(i / 1000,) for i in range(1000)], "v double")
    got = {r.share: r.value for r in tuning.bootstrap_of(df, "v", np.median).collect()}
    assert 0.4 < got[0.025] < got[0.5] < got[0.975] < 0.6
    assert tuning.bootstrap_of(df.limit(0), "v", np.median).count() == 0


def test_slices_equal_single_summaries(spark):
    gold = "/root/testdata/sf0.001/gold_rows.parquet"
    scores = scoring.score_rows(spark.read.parquet(gold), spark.read.parquet(gold.replace("gold_rows", "parsed_rows"))).persist()
    sliced = {(r.slice, r.value): r for r in scoring.by_slice(scores).collect()}
    total = scoring.summarise(scores).first()
    assert sliced["all", ""].rows == total.rows and sliced["all", ""].authors_f1 == pytest.approx(total.authors_f1)
    for r in scoring.summarise(scores, "publisher_domain").collect():
        assert sliced["publisher", r.publisher_domain].rows == r.rows


def test_registered_functions(spark):
    from sievewright.functions import register

    assert "sw_linked_people" in register.register(spark)
    row = spark.sql("select sw_normal_name('DOE, Jané') as n, sw_unescape('a &amp; b') as u, sw_normal_words(null) as w").first()
    assert (row.n, row.u, row.w) == ("doe jane", "a & b", None)
    block = '{"@graph": [{"author": {"givenName": "Ann", "familyName": "Lee", "affiliation": "Uni"}}]}'
    spark.createDataFrame([(1, block), (2, None), (3, "{broken")], "k int, block string").createOrReplaceTempView("blocks")
    assert [tuple(r) for r in spark.sql("select k, p.* from blocks, lateral sw_linked_people(block) p").collect()] == [(1, "Ann Lee", "Uni")]


def test_types_and_names_of_columns(spark):
    df = spark.createDataFrame([(1, "Note"), (2, None), (3, "paper")], "k int, kind string")
    assert {r.k for r in records.without_types(df, "kind", ("note",)).collect()} == {2, 3}
    names = {"k": "No", "kind": "Type"}
    assert records.renamed(records.renamed(df, names), names, back=True).columns == df.columns
    with pytest.raises(ValueError):
        records.renamed(df, {"k": "x", "kind": "x"})
    with pytest.raises(ValueError):
        records.input_rows(df, ("doi",), "k")
    assert [r.k for r in records.batch_rows(df, "k", 2, 2).collect()] == [3]
