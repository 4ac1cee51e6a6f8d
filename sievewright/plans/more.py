"""Further record queries with their SQL: links, buckets, reports, set operations, carried values, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import monitor
from sievewright.plans.tables import _LIST_EMPTY
from sievewright.session import small, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("publisher_links", r"""select publisher_domain, count(*) as n from delta where regexp_matches(trim(link), '^https?://', 'i')
and regexp_replace(lower(regexp_extract(trim(link), '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') not in ('doi.example', 'doi.org', '') and length(regexp_replace(regexp_extract(trim(link), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) > 0 group by 1""")
def publisher_links(spark: SparkSession, d: str) -> DataFrame:
    """Absolute links that lead to a publisher's page: not to a resolver, not to a front page."""
    link = F.trim("link")
    path = F.regexp_replace(F.regexp_extract(link, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    ok = link.rlike("(?i)^https?://") & ~tx.domain(F.col("link")).isin("doi.example", "doi.org", "") & (F.length(path) > 0)
    return table(spark, d, "delta").where(ok).groupBy("publisher_domain").agg(F.count("*").alias("n"))


@query("affiliation_buckets", r"""with g as (select rec_no, lower(trim(a.name)) as k, array_to_string(a.affiliations, ' | ') as x from (select rec_no, unnest(authors) as a from gold_rows)),
p as (select parse_id, rec_no, lower(trim(a.name)) as k, array_to_string([z.name for z in a.affiliations], ' | ') as y from (select parse_id, rec_no, unnest(parsed.authors) as a from parsed_rows)),
j as (select g.rec_no, parse_id, k, coalesce(x, '') as x, coalesce(y, '') as y from g join p using (rec_no, k) where k <> ''),
t as (select *, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) as tx, list_distinct(regexp_extract_all(lower(y), '[a-z0-9]+')) as ty, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') as cx, regexp_replace(lower(y), '[^a-z0-9]+', '', 'g') as cy from j where x <> y)
select case when trim(y) = '' then 'empty' when cx = cy then 'punctuation' when len(ty) = 0 or len(tx) = 0 then 'other' when len(list_intersect(ty, tx)) = len(ty) and length(y) < length(x) then 'dropped detail' else 'other' end as bucket, count(*) as n from t group by 1""")
def affiliation_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How affiliation texts of authors with one name differ."""
    g = table(spark, d, "gold_rows").select("rec_no", F.explode("authors").alias("a")).select("rec_no", F.lower(F.trim("a.name")).alias("k"), F.coalesce(F.array_join("a.affiliations", " | "), F.lit("")).alias("x"))
    p = table(spark, d, "parsed_rows").select("rec_no", F.explode("parsed.authors").alias("a")).select("rec_no", F.lower(F.trim("a.name")).alias("k"), F.coalesce(F.array_join("a.affiliations.name", " | "), F.lit("")).alias("y"))
    j = g.join(p, ["rec_no", "k"]).where("k <> '' AND x <> y")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    t = j.select("x", "y", words("x").alias("tx"), words("y").alias("ty"))
    inside = (F.size(F.array_except("ty", "tx")) == 0) & (F.length("y") < F.length("x"))
    bucket = F.when(F.trim("y") == "", "empty").when(bare("x") == bare("y"), "punctuation").when((F.size("ty") == 0) | (F.size("tx") == 0), "other").when(inside, "dropped detail").otherwise("other")
    return t.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("attempt_totals", "select rec_no, count(*) as n_fetches, sum(attempts)::bigint as attempts, sum(duration_ms)::bigint as ms, bool_or(status = 'ok') as ever_ok from fetch_log group by 1")
def attempt_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_log").groupBy("rec_no").agg(
        F.count("*").alias("n_fetches"), F.sum("attempts").alias("attempts"), F.sum("duration_ms").alias("ms"), F.bool_or(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("ever_ok"),
    )


@query("best_extraction", "select rec_no, arg_max(parse_id, (run_at, parse_id)) as parse_id from parsed_rows where parsed is not null and (len(parsed.authors) > 0 or length(trim(parsed.abstract)) > 0) group by 1")
def best_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The latest extraction of a record that is not empty."""
    filled = F.col("parsed").isNotNull() & ((F.size("parsed.authors") > 0) | (F.length(F.trim("parsed.abstract")) > 0))
    return table(spark, d, "parsed_rows").where(filled).groupBy("rec_no").agg(F.max_by("parse_id", F.struct("run_at", "parse_id")).alias("parse_id"))


_REPORT = ["authors", "abstract", "pdf_url", "notes", "doi"]


@query("field_report", "with r as (" + " union all ".join(f"select '{f}' as field, not ({_LIST_EMPTY.format(f)}) as ok, upper(trim(status)) = 'TRUE' as fetched from delta" for f in _REPORT) + "), a as (select field, count(*) as n, round(avg(case when ok then 1 else 0 end), 6) as rate, round(avg(case when ok then 1 else 0 end) filter (fetched), 6) as rate_fetched from r group by 1) select *, round(0.85 - rate, 6) as gap, case when rate >= 0.85 then 'above' when rate >= 0.75 then 'close' else 'far' end as standing from a")
def field_report(spark: SparkSession, d: str) -> DataFrame:
    """Filled share of each field, over all rows and over fetched ones, and how far it is from 0.85."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~tx.absent_list(F.col(f))).cast("int").alias("ok")) for f in _REPORT])).alias("r")
    rows = table(spark, d, "delta").select((F.upper(F.trim("status")) == "TRUE").alias("fetched"), fields)
    a = rows.groupBy("r.field").agg(F.count("*").alias("n"), F.round(F.avg("r.ok"), 6).alias("rate"), F.round(F.avg(F.when(F.col("fetched"), F.col("r.ok"))), 6).alias("rate_fetched"))
    standing = F.when(F.col("rate") >= 0.85, "above").when(F.col("rate") >= 0.75, "close").otherwise("far")
    return a.select("*", F.round(0.85 - F.col("rate"), 6).alias("gap"), standing.alias("standing"))


@query("whole_percents", "select gold_quality, count(*) as n, (100 * count(*)) // greatest((select count(*) from gold_rows), 1) as percent from gold_rows group by 1")
def whole_percents(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_rows")
    total = g.agg(F.greatest(F.count("*"), F.lit(1)).alias("all"))
    return g.groupBy("gold_quality").agg(F.count("*").alias("n")).join(F.broadcast(total), how="cross").select("gold_quality", "n", F.floor(F.lit(100) * F.col("n") / F.col("all")).alias("percent"))


@query("publisher_order", "with c as (select publisher_name, count(*) as n from delta d join publishers p on d.publisher_domain = p.publisher_domain group by 1), k as (select *, case when publisher_name in ('Velmora Press', 'Talvin Press', 'Karnost Press') then list_position(['Velmora Press', 'Talvin Press', 'Karnost Press'], publisher_name) end as pinned from c) select publisher_name, n, row_number() over (order by pinned nulls last, n desc, publisher_name) as place from k")
def publisher_order(spark: SparkSession, d: str) -> DataFrame:
    """Pinned publishers in their order, then the rest by rows. One row a publisher, so the global order is small."""
    names = small(table(spark, d, "publishers").select("publisher_domain", "publisher_name"))
    counts = table(spark, d, "delta").select("publisher_domain").join(names, "publisher_domain").groupBy("publisher_name").agg(F.count("*").alias("n"))
    pinned = F.create_map(*[F.lit(x) for i, p in enumerate(("Velmora Press", "Talvin Press", "Karnost Press"), 1) for x in (p, i)])[F.col("publisher_name")]
    order = Window.orderBy(pinned.asc_nulls_last(), F.desc("n"), "publisher_name")
    return counts.select("publisher_name", "n", F.row_number().over(order).cast("long").alias("place"))


@query("latest_run", "select arg_max(run_id, landed_at) as run_id from delta where run_id is not null")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where(F.col("run_id").isNotNull()).agg(F.max_by("run_id", "landed_at").alias("run_id"))


@query("compact_names", r"select regexp_replace(lower(a.name), '\s+', '', 'g') as compact, count(*) as n from (select unnest(authors) as a from gold_rows) where a.name is not null group by 1")
def compact_names(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gold_rows").select(F.explode("authors").alias("a")).where("a.name IS NOT NULL")
    return a.groupBy(F.regexp_replace(F.lower("a.name"), r"\s+", "").alias("compact")).agg(F.count("*").alias("n"))


@query("short_dois", "select row_id, case when length(doi) > 28 then concat(left(doi, 10), '…', right(doi, 14)) else doi end as short from delta where doi is not null")
def short_dois(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where(F.col("doi").isNotNull()).select("row_id", tx.short_doi(F.col("doi")).alias("short"))


@query("token_overlap", r"""with t as (select p.parse_id, list_distinct(regexp_extract_all(lower(g.abstract), '[a-z0-9]+')) as x, list_distinct(regexp_extract_all(lower(p.parsed.abstract), '[a-z0-9]+')) as y from gold_rows g join parsed_rows p using (rec_no) where g.abstract is not null and p.parsed.abstract is not null)
select parse_id, len(list_intersect(x, y)) as shared, len(x) - len(list_intersect(x, y)) as only_gold, len(y) - len(list_intersect(x, y)) as only_parsed from t""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    g = table(spark, d, "gold_rows").where(F.col("abstract").isNotNull()).select("rec_no", words("abstract").alias("x"))
    p = table(spark, d, "parsed_rows").select("rec_no", "parse_id", F.col("parsed.abstract").alias("t")).where("t IS NOT NULL").select("rec_no", "parse_id", words("t").alias("y"))
    n = lambda c: F.size(c).cast("long")
    return g.join(p, "rec_no").select("parse_id", n(F.array_intersect("x", "y")).alias("shared"), n(F.array_except("x", "y")).alias("only_gold"), n(F.array_except("y", "x")).alias("only_parsed"))


@query("doi_sets", "select 'intersect' as op, count(*) as n from (select lower(doi) from gold_rows where doi is not null intersect select lower(doi) from fetch_log where doi is not null) union all select 'except', count(*) from (select lower(doi) from fetch_log where doi is not null except select lower(doi) from gold_rows where doi is not null) union all select 'union', count(*) from (select lower(doi) from gold_rows where doi is not null union select lower(doi) from fetch_log where doi is not null)")
def doi_sets(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t: table(spark, d, t).where("doi IS NOT NULL").select(F.lower("doi").alias("doi"))
    g, f = side("gold_rows"), side("fetch_log")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(g.intersect(f), "intersect").unionByName(count(f.subtract(g), "except")).unionByName(count(g.union(f).distinct(), "union"))


@query("carried_errors", "select fetch_id, last_value(error ignore nulls) over (partition by shard order by fetch_id rows unbounded preceding) as last_error from fetch_log")
def carried_errors(spark: SparkSession, d: str) -> DataFrame:
    """The last error seen so far in a shard, carried forward over lines without one."""
    return monitor.carried(table(spark, d, "fetch_log"), "error", "shard", "fetch_id").select("fetch_id", F.col("carried").alias("last_error"))


@query("note_labels", r"select regexp_extract(notes, '^\W*(\w+)', 1) as label, count(*) as n from delta where notes is not null group by 1")
def note_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where(F.col("notes").isNotNull()).groupBy(F.regexp_extract("notes", r"^\W*(\w+)", 1).alias("label")).agg(F.count("*").alias("n"))


@query("quality_by_tag", "with t as (select gold_quality, unnest(case when len(failure_modes) = 0 then ['clean'] else failure_modes end) as tag from gold_rows) select tag, count(*) filter (gold_quality = 'ok') as ok, count(*) filter (gold_quality = 'broken-json') as broken, count(*) filter (gold_quality = 'journal-title-leaked') as leaked from t group by 1")
def quality_by_tag(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.size("failure_modes") == 0, F.array(F.lit("clean"))).otherwise(F.col("failure_modes"))
    t = table(spark, d, "gold_rows").select("gold_quality", F.explode(tags).alias("tag"))
    is_ = lambda v: F.count_if(F.coalesce(F.col("gold_quality") == v, F.lit(False)))
    return t.groupBy("tag").agg(is_("ok").alias("ok"), is_("broken-json").alias("broken"), is_("journal-title-leaked").alias("leaked"))


@query("summary_sets", "select publisher_domain, run_id, count(*) as n, count(error) as errors, round(avg(duration_ms), 6) as mean_ms from parsed_rows where publisher_domain is not null and run_id is not null group by grouping sets ((publisher_domain), (run_id), ())")
def summary_sets(spark: SparkSession, d: str) -> DataFrame:
    """Overall, publisher and run summaries in one pass over the rows."""
    table(spark, d, "parsed_rows").select("publisher_domain", "run_id", "error", "duration_ms").createOrReplaceTempView("sievewright_parsed")
    return spark.sql("SELECT publisher_domain, run_id, count(*) AS n, count(error) AS errors, round(avg(duration_ms), 6) AS mean_ms FROM sievewright_parsed WHERE publisher_domain IS NOT NULL AND run_id IS NOT NULL GROUP BY GROUPING SETS ((publisher_domain), (run_id), ())")


@query("sampled_dois", "select doi from (select distinct lower(doi) as doi from delta where doi is not null) order by md5(doi), doi limit 100")
def sampled_dois(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of 100 identifiers, the same for the same table: sampling is the feature."""
    return table(spark, d, "delta").where("doi IS NOT NULL").select(F.lower("doi").alias("doi")).distinct().orderBy(F.md5("doi"), "doi").limit(100)


@query("repeated_rows", "select copies, count(*) as n from (select count(*) as copies from delta group by rec_no, doi, link, publisher_domain, authors, abstract, pdf_url, status, notes, has_bot_check, resolves_to_pdf, broken_doi, no_english) group by 1")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    """How often whole records were landed without change. Rows are grouped by a 128-bit digest, so texts are not shuffled."""
    fields = ["rec_no", "doi", "link", "publisher_domain", "authors", "abstract", "pdf_url", "status", "notes", "has_bot_check", "resolves_to_pdf", "broken_doi", "no_english"]
    print_ = F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    return table(spark, d, "delta").groupBy(print_.alias("p")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("n"))


@query("licences", "select coalesce(parsed.license, 'none') as license, coalesce(parsed.version, 'none') as version, count(*) as n, count(*) filter (len(parsed.urls) > 0) as with_urls from parsed_rows where parsed is not null group by 1, 2")
def licences(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_rows").where("parsed IS NOT NULL")
    return p.groupBy(F.coalesce("parsed.license", F.lit("none")).alias("license"), F.coalesce("parsed.version", F.lit("none")).alias("version")).agg(F.count("*").alias("n"), F.count_if(F.size("parsed.urls") > 0).alias("with_urls"))


@query("landing_gaps", "with w as (select rec_no, date_diff('day', lag(landed_at) over (partition by rec_no order by landed_at, row_id)::date, landed_at::date) as days from delta where landed_at is not null) select days, count(*) as n from w where days is not null group by 1")
def landing_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("rec_no").orderBy("landed_at", "row_id")
    rows = table(spark, d, "delta").where("landed_at IS NOT NULL").select("rec_no", "row_id", "landed_at")
    gaps = rows.select(F.datediff("landed_at", F.lag("landed_at").over(w)).cast("long").alias("days")).where("days IS NOT NULL")
    return gaps.groupBy("days").agg(F.count("*").alias("n"))


@query("late_landings", "select run_id, count(*) filter (landed_at > fetched_at + interval 7 day) as n_late, count(*) as n from delta where landed_at is not null and fetched_at is not null group by 1")
def late_landings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "delta").where("landed_at IS NOT NULL AND fetched_at IS NOT NULL")
    return rows.groupBy("run_id").agg(F.count_if(F.expr("landed_at > fetched_at + INTERVAL 7 DAYS")).alias("n_late"), F.count("*").alias("n"))


@query("heat", "with e as (select publisher_domain, count(error) / count(*) as x from parsed_rows where publisher_domain is not null group by 1) select publisher_domain, round(case when x < 0.5 then 2 * x * 255 else 255 end, 3) as red, round(case when x < 0.5 then 255 else (2 - 2 * x) * 255 end, 3) as green from e")
def heat(spark: SparkSession, d: str) -> DataFrame:
    """A share as a colour between two ends over a middle: piecewise linear."""
    e = table(spark, d, "parsed_rows").where("publisher_domain IS NOT NULL").groupBy("publisher_domain").agg((F.count("error") / F.count("*")).alias("x"))
    x = F.col("x")
    return e.select("publisher_domain", F.round(F.when(x < 0.5, 2 * x * 255).otherwise(255.0), 3).alias("red"), F.round(F.when(x < 0.5, 255.0).otherwise((2 - 2 * x) * 255), 3).alias("green"))


@query("named_pairs", "select a.name as name, count(*) as n, count(distinct rec_no) as n_records, sum(len(a.affiliations))::bigint as n_affiliations from (select rec_no, unnest(authors) as a from gold_rows) where coalesce(a.name, '') <> '' group by 1")
def named_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gold_rows").select("rec_no", F.explode("authors").alias("a")).where("coalesce(a.name, '') <> ''")
    return a.groupBy("a.name").agg(F.count("*").alias("n"), F.countDistinct("rec_no").alias("n_records"), F.sum(F.size("a.affiliations")).alias("n_affiliations"))


@query("ordered_zip", "select g.rec_no, i.i as pos, g.authors[i.i + 1].name as gold_name, p.parsed.authors[i.i + 1].name as parsed_name from gold_rows g join parsed_rows p using (rec_no) cross join range(0, (select max(len(authors)) from gold_rows)) i where i.i < least(len(g.authors), len(p.parsed.authors)) and len(g.authors) = len(p.parsed.authors)")
def ordered_zip(spark: SparkSession, d: str) -> DataFrame:
    """Author lists of equal length side by side, by position."""
    g = table(spark, d, "gold_rows").select("rec_no", F.col("authors.name").alias("x"))
    p = table(spark, d, "parsed_rows").select("rec_no", F.col("parsed.authors.name").alias("y"))
    both = g.join(p, "rec_no").where((F.size("x") == F.size("y")) & (F.size("x") > 0))
    return both.select("rec_no", F.posexplode(F.arrays_zip("x", "y")).alias("pos", "z")).select("rec_no", F.col("pos").cast("long").alias("pos"), F.col("z.x").alias("gold_name"), F.col("z.y").alias("parsed_name"))
