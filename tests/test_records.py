import random
import statistics

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import extract, merge, monitor, records, tuning
from sievewright.plans import pages
from sievewright.sources import records as src
from sievewright.sources import sinks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize(("cell", "quality"), [
    ('[{"name":"Jane Doe","rasses":"MIT","corresponding_author":true}]', "ok"), ("N/A", "ok"), (None, "ok"), ("[]", "ok"), ('[{"name":"A"},]', "ok"),
    ('"[{""name"": ""A""}]"', "ok"), ("Journal of Things", "journal-title-leaked"), ('[{"name":', "broken-json"),
])
def test_authors_quality(spark, cell, quality):
    got = one(spark, records.authors_quality, cell)
    assert got.quality == quality and got.scored == (quality == "ok")


def test_authors_typed(spark):
    got = one(spark, records.authors_of, '[{"name":"A","rasses":" x ","corresponding_author":true},{"name":"B","affiliations":["p","","q"]},{"name":"C"}]')
    assert [(a.name, a.affiliations, a.is_corresponding) for a in got] == [("A", ["x"], True), ("B", ["p", "q"], None), ("C", [], None)]
    assert one(spark, records.authors_of, "Journal of Things") == []


def test_completeness(spark):
    kind = "array<struct<name:string,affiliations:array<string>>>"
    assert [one(spark, records.completeness, v, kind) for v in ([], [("A", [" "])], [("A", []), ("B", ["x"])], [(" ", ["x"])])] == ["no_authors", "no_affiliations", "good", "no_authors"]


@pytest.mark.parametrize(("value", "want"), [("N/A`", True), ("n/a.", True), ("none", True), ("x", False), (None, True), ("  ", True), ("[]", True), ("a]", False)])
def test_absent(spark, value, want):
    assert one(spark, tx.absent, value) is want


def test_failure_modes(spark):
    assert one(spark, records.failure_modes, "paywall, sign-in and an image") == ["paywall", "login", "image_only"]
    assert not one(spark, records.failure_modes, None)


def test_merge_fills_only_what_may_be_filled(spark):
    base = spark.createDataFrame([(1, None, "u"), (2, "N/A", None), (3, "x", "v"), (4, None, None)], "k long, abstract string, pdf_url string")
    delta = spark.createDataFrame([(1, "new", "w"), (2, "new", "w"), (3, "new", None)], "k long, abstract string, pdf_url string")
    gold = spark.createDataFrame([(2, "N/A", "known")], "k long, abstract string, pdf_url string")
    got = {r.k: (r.abstract, r.pdf_url, r.filled, r.held_back) for r in merge.merge_filled(base, delta, gold, "k", ["abstract", "pdf_url"]).collect()}
    assert got == {1: ("new", "u", 1, 0), 2: ("N/A", "w", 1, 1), 3: ("x", "v", 0, 0), 4: (None, None, 0, 0)}


def test_reruns_and_overlay(spark):
    runs = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 1, "c"), (2, None, "z")], "k long, n int, src string")
    assert {(r.k, r.src) for r in merge.best_rerun(runs, "k", "n", "src").collect()} == {(1, "a"), (2, "z")}
    parts = [spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string"), spark.createDataFrame([(1, None)], "k long, v string")]
    assert {(r.k, r.v) for r in merge.overlay(parts, "k").collect()} == {(1, None), (2, "old")}


def test_named_map(spark):
    got = one(spark, merge.named_map, "A::x || B::y || A::z || C")
    assert [(e.name, e.affiliations) for e in got][:2] == [("A", ["x", "z"]), ("B", ["y"])]


def test_estimators_against_definitions(spark):
    rng = random.Random(4)
    values = [min(1.0, max(0.0, rng.gauss(m, 0.06))) for m in (0.25, 0.85) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    counts = [0] * tuning.BINS
    for v in values:
        counts[min(tuning.BINS - 1, int(v * tuning.BINS))] += 1
    best, at = -1.0, None
    for b in range(tuning.BINS):
        w0, w1 = sum(counts[: b + 1]), sum(counts[b + 1 :])
        if w0 and w1:
            m0 = sum(i * c for i, c in enumerate(counts[: b + 1])) / w0
            m1 = sum(i * c for i, c in enumerate(counts) if i > b) / w1
            if w0 * w1 * (m0 - m1) ** 2 > best + 1e-9:
                best, at = w0 * w1 * (m0 - m1) ** 2, (b + 0.5) / tuning.BINS
    assert tuning.otsu(df, "v").collect()[0].threshold == pytest.approx(at, abs=0.0051)
    ranked = sorted(values)
    for r in tuning.nearest_rank(df, "v", [0.1, 0.5, 0.9]).collect():
        assert r.value == ranked[round(r.share * (len(ranked) - 1))]
    valley = tuning.kde_valley(df, "v").collect()[0]
    assert valley.peak_low < valley.threshold < valley.peak_high and 0.35 < valley.threshold < 0.75
    assert {r.threshold: r.n_at_least for r in tuning.sweep(df, "v", [0.5]).collect()} == {0.5: sum(v >= 0.5 for v in values)}
    boot = {r.share: r.value for r in tuning.bootstrap(df, "v").collect()}
    assert boot[0.025] < statistics.mean(values) < boot[0.975]


@pytest.mark.parametrize(("values", "want"), [([0.01, 0.02, 0.55, 0.90, 0.92], (0.725, 0.55, 0.90)), ([0.1], (0.5, 0.5, 1.0)), ([0.7], (0.7, 0.7, 0.7))])
def test_largest_gap(spark, values, want):
    got = tuning.largest_gap(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()[0]
    assert (got.threshold, got.low, got.high) == pytest.approx(want)


def test_latency(spark):
    values = [5, 1, 9, 7, 3, 3]
    got = monitor.latency(spark.createDataFrame([("a", v) for v in values] + [("a", None)], "s string, v long"), "v", "s").collect()[0]
    assert (got.n, got.lo, got.median, got.hi, got.avg) == (6, 1, statistics.median(values), 9, pytest.approx(28 / 6, abs=1e-6))
    assert got.p95 == sorted(values)[int(0.95 * 6) - 1]


def test_sources_and_sinks(spark, tmp_path):
    csv = tmp_path / "x.csv"
    header = ",".join(src.COLUMNS)
    csv.write_text(header + '\n1,10.1/a,,"[{""name"": ""A"",\n ""rasses"": """"}]",t,,TRUE,,,,,\n,,,,,,,,,,,\n')
    rows = src.read_csv(spark, str(csv)).collect()
    assert len(rows) == 1 and rows[0].Authors.startswith('[{"name": "A",\n')
    with pytest.raises(ValueError):
        src.read_csv(spark, str(csv), ("nope",))
    lines = tmp_path / "log.jsonl"
    lines.write_text('{"doi":"a","n":1}\nbroken\n{"doi":"a","n":2}\n{"doi":"","n":9}\n')
    schema = spark.createDataFrame([], "doi string, n long").schema
    assert [(r.doi, r.n) for r in src.read_lines(spark, str(lines), schema, "doi").collect()] == [("a", 2)]
    assert src.sniff(" [", "x.txt") == "json" and src.sniff("a,b", "x") == "csv" and src.sniff("", "X.CSV") == "csv"
    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "i long, p string")
    sinks.write_shards(df, str(tmp_path / "shards"), F.col("p"), files=2)
    back = spark.read.json(str(tmp_path / "shards"))
    assert back.count() == 30 and {r.shard for r in back.select("shard").distinct().collect()} == {"p0", "p1", "p2"}
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 60
    picked = src.alias(spark.createDataFrame([("", "b")], "DOI string, doi2 string"), {"doi": ("DOI", "doi2"), "none": ("zz",)}).collect()[0]
    assert picked.doi == "b" and picked.none is None


PAGE = (
    '<meta name="citation_title" content="A &amp; B"><meta name="citation_author" content="Jane Doe"><meta name="citation_author" content="Max Roe">'
    '<meta name="citation_author_institution" content="MIT"><meta name="citation_author_institution" content="ETH"><meta name="citation_author_institution" content="EPFL">'
    '<meta name="citation_abstract" content="Short..."><span class="x corresponding"><a class="author">Max Roe<i></i></a></span>'
    '<script type="application/ld+json">{"abstract": "' + "Long text. " * 30 + '"}</script>'
)


def test_extraction_and_repairs(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<html>nothing</html>"), (3, None)], "k long, html string")
    meta = extract.from_meta(pages, "k", "html")
    row = meta.collect()[0]
    assert meta.count() == 1 and row.title == "A & B"
    assert [(a.name, a.affiliation, a.is_corresponding) for a in row.authors] == [("Jane Doe", "MIT", True), ("Max Roe", "ETH; EPFL", False)]
    fixed = extract.repair(meta.withColumn("authors", extract._flags(F.col("authors"), lambda a: F.lit(False)))).collect()[0]
    assert fixed.abstract.startswith("Long text. Long") and [a.is_corresponding for a in fixed.authors] == [False, True]


def test_streams(spark, tmp_path):
    from sievewright.streaming import logs

    df = spark.createDataFrame([("a", "ok", 1), ("b", "ok", 2), ("c", "error", 5)], "doi string, status string, attempts long")
    df.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = logs.log_stream(spark, str(tmp_path / "log"), df.schema, per_trigger=1)
    got = {r.status: (r.n, r.attempts) for r in logs.run_to_end(logs.status_counts(stream, "status")).collect()}
    assert got == {"ok": (2, 3), "error": (1, 5)}
    out = str(tmp_path / "out")
    logs.drain(logs.log_stream(spark, str(tmp_path / "log"), df.schema), out)
    df.write.mode("append").parquet(str(tmp_path / "log"))
    logs.drain(logs.log_stream(spark, str(tmp_path / "log"), df.schema), out)
    assert spark.read.parquet(out).count() == 6


def test_ordered_computations_by_blocks(spark):
    rng = random.Random(6)
    rows, per = [], {}
    for g in "ab":
        ids = sorted(rng.sample(range(400), 150))
        per[g] = [(i, rng.choice([None, 1, 2]), rng.random() < 0.4) for i in ids]
        rows += [(g, *r) for r in per[g]]
    df = spark.createDataFrame(rows, "g string, i long, v long, bad boolean")
    total = {(r.g, r.i): r.total for r in monitor.running_sum(df, "v", "g", "i", width=17).collect()}
    last = {(r.g, r.i): r.carried for r in monitor.carried(df, "v", "g", "i", width=17).collect()}
    share = {(r.g, r.i): r.share for r in monitor.rolling_share(df, F.col("bad"), "g", "i", size=5, width=7).collect()}
    assert len(total) == len(last) == len(share) == 300
    for g, seen in per.items():
        for k, (i, _, _) in enumerate(seen):
            values = [v for _, v, _ in seen[: k + 1] if v is not None]
            assert total[g, i] == (sum(values) if values else None)
            assert last[g, i] == (values[-1] if values else None)
            window = [b for _, _, b in seen[max(0, k - 4) : k + 1]]
            assert share[g, i] == (pytest.approx(sum(window) / 5) if k >= 4 else None)


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, None, "z"), (2, None, "q")], "k long, t long, v string")
    assert {(r.k, r.v) for r in records.one_per_key(df, "k", F.col("t"), greatest=True).collect()} == {(1, "y"), (2, "q")}
    assert records.one_per_key(df, "k", -F.coalesce("t", F.lit(0))).columns == ["k", "t", "v"]


def test_missing_batches_beyond_the_least_range(spark):
    df = spark.createDataFrame([(1,), (41,), (15,)], "n long")
    assert {r.batch_no for r in records.missing_batches(df, "n", 10, 3).collect()} == {3, 4}
    assert {r.batch_no for r in records.missing_batches(df.limit(0), "n", 10, 2).collect()} == {1, 2}


def test_pages_give_back_whole_abstracts(spark, tmp_path):
    abstract = "A sentence of some length that goes on. " * 4
    spark.createDataFrame(
        [(1, "10.1/a", [("Ann Lee", ["Here"])], abstract, "http://x/a.pdf")],
        "rec_no long, doi string, authors array<struct<name:string,affiliations:array<string>>>, abstract string, pdf_url string",
    ).write.parquet(f"{tmp_path}/gold_rows.parquet")
    row = pages.extracted(spark, str(tmp_path)).first()
    assert (row.abstract, row.pdf_url) == (abstract.strip(), "http://x/a.pdf")


REPAIRED = [
    # page, names, then for each author (affiliation, flagged)
    ('<a class="x author">Ann  Lee<i></i></a>\n<span class="overlay">Uni &amp; Co<a>more</a></span><a class=author>Bo Ek</a>', ["Ann Lee", "Bo Ek"], [("Uni & Co", False), ("", False)]),
    ('<script type="application/ld+json">{"@graph": [{"author": [{"name": "Lee, Ann", "affiliation": [{"name": "A"}, {"name": "", "address": {"name": "B"}}]}]}]}</script>', ["Ann Lee"], [("A; B", False)]),
    ('<script type="application/json" data-iso-key="_0">{"authors":{"content":[{"#name":"author-group","$$":[{"#name":"author","$$":[{"#name":"given-name","_":"Ann"},{"#name":"surname","_":"Lee"},{"#name":"cross-ref","$":{"refid":"AC1"}},{"#name":"cross-ref","$":{"refid":"AF2"}}]},{"#name":"affiliation","$":{"id":"AF2"},"$$":[{"#name":"textfn","$$":[{"#name":"__text__","_":"Uni"},{"#name":"footnote","_":"note"}]}]}]}]}}</script>', ["ann lee"], [("Uni", False)]),
    ('<span class="sciprofiles-link__name">Ann Lee</span> <sup>1,*</sup><span class="sciprofiles-link__name">Bo Ek</span><sup>2</sup>', ["Ann Lee", "Bo Ek"], [("1,*", True), ("2", False)]),
    ("<p><b>Corresponding author</b>: write to <a href='mailto:j.vanDam@x.org'>us</a>", ["Bo Ek", "Jan van Dam"], [("", False), ("", True)]),
    ("Correspondence to Dr P.M. White, Dept of Law", ["Ann Lee", "P. M. White"], [("", False), ("", True)]),
    ("no marks at all <script type=\"application/ld+json\">{broken</script>", ["Ann Lee"], [("", False)]),
    (None, ["Ann Lee"], [("", False)]),
]


def test_each_repair(spark):
    rows = [(i, page, [(n, "", False) for n in names]) for i, (page, names, _) in enumerate(REPAIRED)]
    df = spark.createDataFrame(rows, f"k int, page string, authors array<{extract.AUTHOR}>").selectExpr("*", "'T' as title", "'' as abstract", "'' as pdf_url", "1 as metas")
    got = {r.k: [(a.affiliation, a.is_corresponding) for a in r.authors] for r in extract.repair(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(REPAIRED)}
    assert extract.repair(df.limit(0)).count() == 0


def test_sections_labels_and_hosts(spark):
    long = "A paragraph of the section that goes on. " * 6
    latin = "Latin text of the abstract that is long enough. " * 4
    rows = [(1, f'<div class="category-section content-section"><p>{long}</p></div>', "short"), (2, f"<b>Abstract:</b> {latin}<br>", "Исследование было повторено в долине"), (3, '"/doi/epdf/10.1/A" "/doi/pdf/10.1/a"', "x" * 300)]
    df = spark.createDataFrame(rows, "k int, page string, abstract string").selectExpr("*", "'T' as title", "'https://doi.org/10.1/a' as pdf_url", "'10.1/a' as doi", "'https://pub.example/x' as resolved_url", f"cast(array() as array<{extract.AUTHOR}>) as authors")
    got = {r.k: r for r in extract.repair(df).collect()}
    assert got[1].abstract == long.strip() and got[2].abstract == latin.strip() and got[3].pdf_url == "https://pub.example/doi/pdf/10.1/a"


def test_meta_mail_and_encoding(spark):
    page = '<meta content="T" name=citation_title><meta name="citation_author" content="H. Kari"><meta name="citation_author" content="D. S. Robinson"><meta name="citation_author_institution" content="Lab, E-mail: d.s.robinson@x.uk"><meta name="citation_abstract" content="CafÃ© in the valley.">'
    meta = extract.from_meta(spark.createDataFrame([(1, page)], "k long, html string"), "k", "html")
    row = extract.flag_from_meta_mail(meta.withColumn("authors", extract._flags(F.col("authors"), lambda a: F.lit(False)))).first()
    assert [a.is_corresponding for a in row.authors] == [False, True] and row.abstract == "Café in the valley."


def test_corrections(spark):
    v = "array<struct<field:string,verdict:string,text:string,by_name:map<string,string>>>"
    rows = [(1, [("Ann", "", False), ("Bo", "x", True)], "a", "p", [("abstract", "fail", "new", None), ("pdf_url", "pass", "zz", None), ("affiliation", "fail", None, {"Ann": "Uni"}), ("is_corresponding", "fail", None, {"Ann": "true", "Bo": "no"})]), (2, [], "a", "p", [("abstract", "uncertain", "q", None)])]
    got = {r.k: r for r in extract.corrected(spark.createDataFrame(rows, f"k int, authors array<{extract.AUTHOR}>, abstract string, pdf_url string, verdicts {v}")).collect()}
    assert (got[1].abstract, got[1].pdf_url, got[1].again) == ("new", "p", True) and [(a.affiliation, a.is_corresponding) for a in got[1].authors] == [("Uni", True), ("x", False)]
    assert (got[2].abstract, got[2].again) == ("a", False)
