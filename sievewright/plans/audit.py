"""Labels, routes, audits, row shapes and logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import audit, records
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


def _case(pairs, column: str, make) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{make(x)}'" for p, x in pairs) + " end"


def _miss(*fields: str) -> str:
    return "(" + " or ".join(_LIST_EMPTY.format(f) for f in fields) + ")"


_LATEST = "(select * from (select *, row_number() over (partition by rec_no order by landed_at desc nulls last, parse_id desc) as r from parsed_rows) where r = 1)"
_PLAIN = r"coalesce(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')), '')"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return records.latest_rows(table(spark, d, "parsed_rows"), "rec_no", "landed_at", "parse_id")


@query("structural_labels", f"""with u as (select *, coalesce(link, '') as u from delta),
l as (select case when {_miss('authors', 'abstract', 'pdf_url')} then coalesce({_case(audit.BOT_HOSTS, 'u', 'bot-check:{}'.format)}, case when regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) like '%.pdf' then 'pdf-redirect' end, {_case(audit.PAYWALLS, 'u', 'paywalled={}'.format)}, 'extraction-miss') end as label from u)
select label, count(*) as n from l group by 1""")
def structural_labels(spark: SparkSession, d: str) -> DataFrame:
    label = audit.structural_label([F.col("authors"), F.col("abstract"), F.col("pdf_url")], F.coalesce("link", F.lit("")))
    return table(spark, d, "delta").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("paid_files", "select publisher_domain, count(*) as n, count(*) filter (" + " or ".join(f"regexp_matches(pdf_url, '^https?://(?:{p})', 'i')" for p in audit.PAID_FILES) + ") as n_paid from delta where pdf_url is not null group by 1")
def paid_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where("pdf_url IS NOT NULL").groupBy("publisher_domain").agg(F.count("*").alias("n"), F.count_if(audit.paid_file(F.col("pdf_url"))).alias("n_paid"))


@query("page_states", "with t as (select abstract, lower(substr(abstract, 1, 8000)) as h, coalesce(lower(link), '') as u from delta where abstract is not null), b as (select (" + " or ".join(f"contains(h, '{s}')" for s in audit.BOT_SIGNS) + " or contains(u, 'captcha') or contains(u, 'challenge')) as blocked, length(abstract) > 2000 as long from t) select blocked, not blocked and long as ok, count(*) as n from b group by 1, 2")
def page_states(spark: SparkSession, d: str) -> DataFrame:
    """The page assessment over landed texts: how many show signs of a bot check, and how many are long enough."""
    state = audit.page_state(F.col("abstract"), F.col("link"))
    return table(spark, d, "delta").where("abstract IS NOT NULL").select(state.alias("s")).groupBy("s.blocked", "s.ok").agg(F.count("*").alias("n"))


@query("routes", f"""with x as (select d.row_id, d.authors, d.abstract, d.pdf_url, p.rec_no is not null as known, {_PLAIN.format('d.abstract')} as a, {_PLAIN.format('p.parsed.abstract')} as b, {_PLAIN.format('d.pdf_url')} as c, {_PLAIN.format('p.parsed.pdf_url')} as e from delta d left join {_LATEST} p on d.rec_no = p.rec_no)
select row_id, case when {_miss('authors', 'abstract', 'pdf_url')} then 0.3 when not known then 0.6 when {{0}} then 0.4 else 0.9 end::double as confidence, case when {_miss('authors', 'abstract', 'pdf_url')} then 'livefetch' when not known then 'skip_livefetch' when {{0}} then 'human_audit' else 'skip_livefetch' end as route from x""".replace("{0}", "(a <> '' and b <> '' and not contains(a, b) and not contains(b, a) or c <> '' and e <> '' and not contains(c, e) and not contains(e, c))"))
def routes(spark: SparkSession, d: str) -> DataFrame:
    """Where each landed row goes next, by what it holds and what the parser found."""
    p = _latest(spark, d).select("rec_no", F.lit(True).alias("known"), F.col("parsed.abstract").alias("p_abstract"), F.col("parsed.pdf_url").alias("p_pdf"))
    rows = table(spark, d, "delta").select("row_id", "rec_no", "authors", "abstract", "pdf_url").join(p, "rec_no", "left")
    r = audit.route([F.col("authors"), F.col("abstract"), F.col("pdf_url")], F.coalesce("known", F.lit(False)), [(F.col("abstract"), F.col("p_abstract")), (F.col("pdf_url"), F.col("p_pdf"))])
    return rows.select("row_id", r.alias("r")).select("row_id", "r.confidence", "r.route")


_KEY = r"array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g'), ' '), ' '))), ' ')"
_WITHIN = "({0} <> '' and {1} <> '' and (contains({0}, {1}) or contains({1}, {0})))"
_STATE = f"""case when g = '' and a = '' and m = '' then 'all_empty' when a <> '' and a = g then 'found_is_gold' when a <> '' and a = m and not (g <> '' and g = m) then 'found_is_stated_not_gold'
when {_WITHIN.format('a', 'm')} and not {_WITHIN.format('g', 'm')} then 'found_within_stated_not_gold' when g <> '' and g = m then 'gold_is_stated_found_misses' when a <> '' and g = '' then 'found_gold_empty' when g <> '' and a = '' then 'gold_found_empty' else 'differ' end"""
_FIRST = "(select * from (select *, row_number() over (partition by rec_no order by landed_at nulls first, parse_id) as r from parsed_rows) where r = 1)"
_THREE = f"""with gr as (select g.rec_no, {_KEY.format('a.name')} as k, {_PLAIN.format("array_to_string(a.affiliations, ' | ')")} as g from gold_rows g, unnest(g.authors) t(a)),
lr as (select p.rec_no, p.publisher_domain, {_KEY.format('a.name')} as k, {_PLAIN.format("array_to_string([z.name for z in a.affiliations], ' | ')")} as a from {_LATEST} p, unnest(p.parsed.authors) t(a)),
fr as (select p.rec_no, {_KEY.format('a.name')} as k, {_PLAIN.format("array_to_string([z.name for z in a.affiliations], ' | ')")} as m from {_FIRST} p, unnest(p.parsed.authors) t(a)),
gk as (select rec_no, k, max(g) as g from gr where k <> '' group by all), lk as (select rec_no, k, publisher_domain, max(a) as a from lr where k <> '' group by all), fk as (select rec_no, k, max(m) as m from fr where k <> '' group by all),
s as (select rec_no, k, publisher_domain, g, a, coalesce(m, '') as m from gk join lk using (rec_no, k) left join fk using (rec_no, k))"""


def _three(spark: SparkSession, d: str) -> DataFrame:
    """Affiliations of the authors that the trusted record and the latest parse share, beside those of the first parse,
    which stands for what the page states."""
    key = lambda c: records.normal_set(c)
    join = lambda c: audit.plain(F.array_join(c, " | "))
    g = table(spark, d, "gold_rows").select("rec_no", F.explode("authors").alias("a")).groupBy("rec_no", key(F.col("a.name")).alias("k")).agg(F.max(join("a.affiliations")).alias("g")).where("k <> ''")
    rows = table(spark, d, "parsed_rows")
    last = _latest(spark, d).select("rec_no", "publisher_domain", F.explode("parsed.authors").alias("a")).groupBy("rec_no", key(F.col("a.name")).alias("k"), "publisher_domain").agg(F.max(join("a.affiliations.name")).alias("a")).where("k <> ''")
    first = rows.groupBy("rec_no").agg(F.min(F.struct("landed_at", "parse_id")).alias("b")).select("b.parse_id")
    stated = rows.join(first, "parse_id", "left_semi").select("rec_no", F.explode("parsed.authors").alias("a")).groupBy("rec_no", key(F.col("a.name")).alias("k")).agg(F.max(join("a.affiliations.name")).alias("m")).where("k <> ''")
    return g.join(last, ["rec_no", "k"]).join(stated, ["rec_no", "k"], "left").withColumn("m", F.coalesce("m", F.lit("")))


@query("source_audit", f"{_THREE} select publisher_domain, {_STATE} as state, count(*) as n from s group by 1, 2")
def source_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per publisher, which of trusted, found and stated affiliations agree."""
    return _three(spark, d).groupBy("publisher_domain", audit.three_sources(F.col("g"), F.col("a"), F.col("m")).alias("state")).agg(F.count("*").alias("n"))


@query("audit_yield", f"{_THREE}, v as (select rec_no, bool_and((g = a) or {_WITHIN.format('g', 'a')}) as passes, bool_and((g = a) or {_WITHIN.format('g', 'a')} or (a <> '' and m <> '' and a = m) or {_WITHIN.format('a', 'm')}) as would_pass from s group by 1) select count(*) as n_records, count(*) filter (passes) as n_pass, count(*) filter (would_pass) as n_would_pass from v")
def audit_yield(spark: SparkSession, d: str) -> DataFrame:
    """Records of which every shared author passes now, and would pass if the trusted side took what the page states."""
    g, a, m = F.col("g"), F.col("a"), F.col("m")
    now = (g == a) | audit.within(g, a)
    per = _three(spark, d).groupBy("rec_no").agg(F.bool_and(now).alias("now"), F.bool_and(now | audit.within(a, m)).alias("then"))
    return per.agg(F.count("*").alias("n_records"), F.count_if("now").alias("n_pass"), F.count_if("then").alias("n_would_pass"))


_ADDRESS = "case when " + _LIST_EMPTY + r" then '' else lower(regexp_replace(trim({0}, ' '), '/+$', '')) end"


@query("file_verdicts", f"""with x as (select {_ADDRESS.format('g.pdf_url')} as g, {_ADDRESS.format('f.parsed.pdf_url')} as b, {_ADDRESS.format('l.parsed.pdf_url')} as c from gold_rows g join {_FIRST} f using (rec_no) join {_LATEST} l using (rec_no))
select case when g = '' and b = '' and c = '' then 'joint_absent' when b = g and c = g then 'match' when c = g then 'candidate_win' when b = g then 'regression' else 'both_differ' end as verdict, count(*) as n from x group by 1""")
def file_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The latest parse as a candidate beside the first one as a baseline."""
    rows = table(spark, d, "parsed_rows").select("rec_no", "parse_id", "landed_at", F.col("parsed.pdf_url").alias("u"))
    ends = rows.groupBy("rec_no").agg(F.min(F.struct("landed_at", "parse_id", "u")).alias("a"), F.max(F.struct("landed_at", "parse_id", "u")).alias("b"))
    both = table(spark, d, "gold_rows").select("rec_no", "pdf_url").join(ends, "rec_no")
    return both.groupBy(audit.file_verdict(F.col("pdf_url"), F.col("a.u"), F.col("b.u")).alias("verdict")).agg(F.count("*").alias("n"))


@query("affiliation_differences", rf"""with x as (select g.rec_no, a.name as k, array_to_string(a.affiliations, ' | ') as g, array_to_string([z.name for z in b.affiliations], ' | ') as p from gold_rows g, unnest(g.authors) t(a), {_LATEST} l, unnest(l.parsed.authors) u(b) where g.rec_no = l.rec_no and a.name = b.name),
y as (select coalesce(g, '') as go, coalesce(p, '') as po, {_PLAIN.format('g')} as g, {_PLAIN.format('p')} as p from x),
z as (select *, list_distinct(regexp_extract_all(g, '[a-z0-9]+')) as tg, list_distinct(regexp_extract_all(p, '[a-z0-9]+')) as tp, regexp_replace(g, '[^a-z0-9]+', '', 'g') as bg, regexp_replace(p, '[^a-z0-9]+', '', 'g') as bp from y)
select case when g = p then null when p = '' then 1 when bg = bp and bg <> '' then 2 when len(tg) = 0 or len(tp) = 0 then 4 when len(list_intersect(tg, tp)) = len(tp) and length(po) < length(go) then 3
when len(list_intersect(tg, tp)) / greatest(len(tp), 1) >= 0.9 and len(tp) - len(list_intersect(tg, tp)) <= 1 and length(po) < 0.85 * length(go) then 3 else 4 end as bucket, count(*) as n from z group by 1""")
def affiliation_differences(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_rows").select("rec_no", F.explode("authors").alias("a")).select("rec_no", F.col("a.name").alias("k"), F.array_join("a.affiliations", " | ").alias("g"))
    p = _latest(spark, d).select("rec_no", F.explode("parsed.authors").alias("a")).select("rec_no", F.col("a.name").alias("k"), F.array_join("a.affiliations.name", " | ").alias("p"))
    return g.join(p, ["rec_no", "k"]).groupBy(audit.affiliation_bucket(F.col("g"), F.col("p")).alias("bucket")).agg(F.count("*").alias("n"))


@query("checkpoint_rows", "select i.rec_no, i.doi, coalesce(l.parsed.abstract, '') as abstract, case when l.rec_no is null then 'missing_from_checkpoint' else coalesce(l.error, '') end as notes from (select rec_no, min(doi) as doi from delta group by 1) i left join " + _LATEST + " l on i.rec_no = l.rec_no")
def checkpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per input record: what landed for it, or a blank row that says so."""
    inputs = table(spark, d, "delta").groupBy("rec_no").agg(F.min("doi").alias("doi"))
    landed = _latest(spark, d).select("rec_no", F.lit(True).alias("here"), "error", F.col("parsed.abstract").alias("abstract"))
    note = F.when(F.col("here").isNull(), "missing_from_checkpoint").otherwise(F.coalesce("error", F.lit("")))
    return inputs.join(landed, "rec_no", "left").select("rec_no", "doi", F.coalesce("abstract", F.lit("")).alias("abstract"), note.alias("notes"))


def _gold_cells_sql(strict: bool) -> str:
    status = "l.parsed is not null and l.error is null" if strict else "l.parsed is not null"
    empty, flag = ("''", "case when l.parsed is null then '' else 'FALSE' end") if strict else ("'[]'", "'FALSE'")
    return f"select l.rec_no, l.doi, case when coalesce(len(l.parsed.authors), 0) = 0 then {empty} else 'filled' end as authors_cell, coalesce(l.parsed.abstract, '') as abstract, coalesce(l.parsed.pdf_url, '') as pdf_url, case when {status} then 'TRUE' else 'FALSE' end as status, coalesce(l.error, '') as notes, {flag} as has_bot_check from {_LATEST} l"


def _gold_cells(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    p = _latest(spark, d).select("rec_no", "doi", F.col("parsed.authors").alias("authors"), F.col("parsed.abstract").alias("abstract"), F.col("parsed.pdf_url").alias("pdf_url"), F.lit("").alias("notes"), "error", F.lit(None).cast("boolean").alias("has_bot_check"), F.col("parsed").isNotNull().alias("filled"))
    cells = audit.gold_cells(p, strict)
    return cells.withColumn("authors_cell", F.when(F.col("authors_cell").isin("", "[]"), F.col("authors_cell")).otherwise("filled"))  # JSON is spelt differently in SQL


@query("record_cells_strict", _gold_cells_sql(True))
def record_cells_strict(spark: SparkSession, d: str) -> DataFrame:
    return _gold_cells(spark, d, True)


@query("record_cells_lenient", _gold_cells_sql(False))
def record_cells_lenient(spark: SparkSession, d: str) -> DataFrame:
    return _gold_cells(spark, d, False)


@query("parsed_shape", "select parse_id, coalesce(len(parsed.authors), 0) as n_authors, coalesce(len(parsed.urls), 0) as n_urls, parsed.abstract as abstract, parsed.license as license, parsed.version as version from parsed_rows where parsed is not null")
def parsed_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape the scorers read: absent lists are empty ones."""
    p = table(spark, d, "parsed_rows").where("parsed IS NOT NULL")
    n = lambda c: F.size(F.coalesce(c, F.array())).cast("long")
    return p.select("parse_id", n(F.col("parsed.authors")).alias("n_authors"), n(F.col("parsed.urls")).alias("n_urls"), "parsed.abstract", "parsed.license", "parsed.version")


@query("renumbered", "select row_number() over (order by rec_no, doi) as no, rec_no, doi from gold_rows")
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    return audit.numbered(table(spark, d, "gold_rows").select("rec_no", "doi"), "rec_no", "doi").select(F.col("no").cast("long").alias("no"), "rec_no", "doi")


@query("batch_window", "select rec_no, doi, status from gold_rows where rec_no between 201 and 300")
def batch_window(spark: SparkSession, d: str) -> DataFrame:
    """The rows of batch 3 of 100 numbers each; a batch is the feature."""
    return records.batch_rows(table(spark, d, "gold_rows"), "rec_no", 3).select("rec_no", "doi", "status")


@query("input_window", "select row_id, doi from delta where coalesce(trim(doi), '') <> '' and split_part(doi, '/', 1) = (select min(split_part(doi, '/', 1)) from delta where coalesce(trim(doi), '') <> '') order by row_id limit 50 offset 10")
def input_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one prefix from the eleventh on, fifty at most: a window of the input is the feature."""
    rows = records.input_rows(table(spark, d, "delta"), ("row_id", "doi"), "doi")
    first = rows.agg(F.min(tx.doi_prefix(F.col("doi"))).alias("p"))
    return rows.join(F.broadcast(first), tx.doi_prefix(F.col("doi")) == F.col("p")).orderBy("row_id").offset(10).limit(50).select("row_id", "doi")


@query("cached_pages", "select l.fetch_id, d.row_id from fetch_log l join (select doi, max(row_id) as row_id from delta where doi is not null group by 1) d on sha1(lower(l.doi)) = sha1(lower(d.doi)) where l.doi is not null")
def cached_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fetches beside the pages kept under the digest of their identifier."""
    kept = table(spark, d, "delta").where("doi IS NOT NULL").groupBy("doi").agg(F.max("row_id").alias("row_id")).select(F.sha1(F.lower("doi")).alias("key"), "row_id")
    return table(spark, d, "fetch_log").where("doi IS NOT NULL").select("fetch_id", F.sha1(F.lower("doi")).alias("key")).join(kept, "key").select("fetch_id", "row_id")


_LINE = "case when fetch_id % 50 = 0 then concat('Batch ', (fetch_id // 50), ' starting') when error is not null then concat('Error: ', error) else concat('row ', rec_no, ': ', status, ' (', duration_ms, 'ms)') end"


@query("log_events", f"""with l as (select fetch_id, shard, {_LINE} as line from fetch_log),
e as (select fetch_id, shard, case when regexp_matches(line, 'Batch\\s+\\d+\\s+starting') then 'batch' when regexp_matches(line, 'row\\s+\\d+:\\s+\\S+\\s+\\([\\d.]+ms\\)') then 'row' when regexp_matches(line, '^Error:', 'i') then 'trace' end as kind, line from l)
select fetch_id, kind, case kind when 'batch' then regexp_extract(line, 'Batch\\s+(\\d+)', 1) when 'row' then regexp_extract(line, 'row\\s+(\\d+):', 1) end::bigint as number, case when kind = 'row' then regexp_extract(line, 'row\\s+\\d+:\\s+(\\S+)', 1) end as status,
last_value(case when kind = 'batch' then regexp_extract(line, 'Batch\\s+(\\d+)', 1)::bigint end ignore nulls) over (partition by shard order by fetch_id rows unbounded preceding) as batch from e where kind is not null""")
def log_events(spark: SparkSession, d: str) -> DataFrame:
    """A log written from the fetches and read again: each row belongs to the batch whose start came last before it."""
    from sievewright.operators import monitor

    line = F.when(F.col("fetch_id") % 50 == 0, F.concat(F.lit("Batch "), F.floor(F.col("fetch_id") / 50), F.lit(" starting"))).when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
    line = line.otherwise(F.concat(F.lit("row "), F.col("rec_no"), F.lit(": "), F.col("status"), F.lit(" ("), F.col("duration_ms"), F.lit("ms)")))
    events = audit.log_events(table(spark, d, "fetch_log").select("fetch_id", "shard", line.alias("line")), "line")
    batches = events.withColumn("b", F.when(F.col("kind") == "batch", F.col("number")))
    carried = monitor.carried(batches, "b", "shard", "fetch_id").select("fetch_id", F.col("carried").alias("batch"))
    return events.select("fetch_id", "kind", "number", "status").join(carried, "fetch_id")


@query("all_empty_rows", f"select publisher_domain, count(*) as n from delta where {_LIST_EMPTY.format('authors')} and {_LIST_EMPTY.format('pdf_url')} and coalesce(trim(abstract), '') = '' group by 1")
def all_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which nothing was filled; an abstract that says N/A counts as present."""
    nothing = tx.absent_list(F.col("authors")) & tx.absent_list(F.col("pdf_url")) & (F.coalesce(F.trim("abstract"), F.lit("")) == "")
    return table(spark, d, "delta").where(nothing).groupBy("publisher_domain").agg(F.count("*").alias("n"))


@query("appended_notes", f"""with x as (select row_id, coalesce(trim(notes), '') as had, case when {_miss('abstract')} then 'no abstract' end as label from delta)
select row_id, case when label is null or contains(had, label) then had when had = '' then label else concat(had, ' | ', label) end as notes from x""")
def appended_notes(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(tx.absent_list(F.col("abstract")), "no abstract")
    return table(spark, d, "delta").select("row_id", audit.appended(F.col("notes"), label).alias("notes"))


@query("run_trend", "with r as (select run_id, min(run_at) as started, avg(duration_ms) as fresh, avg(parseland_duration_ms) as legacy from parsed_rows group by 1) select run_id, row_number() over (order by started, run_id) as place, round(coalesce(fresh, legacy, 0), 6) as value from r where (select count(*) from r) >= 2")
def run_trend(spark: SparkSession, d: str) -> DataFrame:
    """A metric from the oldest run to the newest; a missing one is taken from the older metric, else 0. Runs are few."""
    from pyspark.sql import Window

    r = table(spark, d, "parsed_rows").groupBy("run_id").agg(F.min("run_at").alias("started"), F.coalesce(F.avg("duration_ms"), F.avg("parseland_duration_ms"), F.lit(0.0)).alias("v"))
    placed = r.withColumn("place", F.row_number().over(Window.orderBy("started", "run_id")).cast("long")).withColumn("all", F.count("*").over(Window.partitionBy()))
    return placed.where("all >= 2").select("run_id", "place", F.round("v", 6).alias("value"))


@query("run_summary", f"select run_id, count(*) as n_rows, count(*) filter (parsed is not null and not (coalesce(len(parsed.authors), 0) = 0 and {_LIST_EMPTY.format('parsed.abstract')} and {_LIST_EMPTY.format('parsed.pdf_url')})) as fetched, round(count(*) filter (parsed is not null and not (coalesce(len(parsed.authors), 0) = 0 and {_LIST_EMPTY.format('parsed.abstract')} and {_LIST_EMPTY.format('parsed.pdf_url')})) / count(*), 4) as rate from parsed_rows group by 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    some = F.col("parsed").isNotNull() & ~((F.size(F.coalesce("parsed.authors", F.array())) == 0) & tx.absent_list(F.col("parsed.abstract")) & tx.absent_list(F.col("parsed.pdf_url")))
    return table(spark, d, "parsed_rows").groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_if(some).alias("fetched"), F.round(F.count_if(some) / F.count("*"), 4).alias("rate"))


@query("field_report_joined", f"""with j as (select g.abstract as ga, g.pdf_url as gp, l.parsed.abstract as pa, l.parsed.pdf_url as pp from gold_rows g join {_LATEST} l using (rec_no)),
r as (select 'abstract' as field, ga as g, pa as p from j union all select 'pdf_url', gp, pp from j),
n as (select field, case when {_LIST_EMPTY.format('g')} then '' else {_PLAIN.format('g')} end as g, case when {_LIST_EMPTY.format('p')} then '' else {_PLAIN.format('p')} end as p from r)
select field, count(*) as n, count(*) filter (g = p) as n_ok, count(*) filter (g = '' and p <> '') as hallucination, count(*) filter (p = '' and g <> '') as empty, count(*) filter (g <> '' and p <> '' and g <> p) as dropped_detail from n group by 1""")
def field_report_joined(spark: SparkSession, d: str) -> DataFrame:
    """Trusted rows joined with the latest parse: agreement of each field in plain form, and what the misses are."""
    g = table(spark, d, "gold_rows").select("rec_no", F.col("abstract").alias("ga"), F.col("pdf_url").alias("gp"))
    p = _latest(spark, d).select("rec_no", F.col("parsed.abstract").alias("pa"), F.col("parsed.pdf_url").alias("pp"))
    form = lambda c: F.when(tx.absent_list(F.col(c)), "").otherwise(audit.plain(F.col(c)))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), form(a).alias("g"), form(b).alias("p")) for n, a, b in (("abstract", "ga", "pa"), ("pdf_url", "gp", "pp"))])).alias("x")
    x, y = F.col("x.g"), F.col("x.p")
    return g.join(p, "rec_no").select(pairs).groupBy("x.field").agg(
        F.count("*").alias("n"), F.count_if(x == y).alias("n_ok"), F.count_if((x == "") & (y != "")).alias("hallucination"), F.count_if((y == "") & (x != "")).alias("empty"), F.count_if((x != "") & (y != "") & (x != y)).alias("dropped_detail"),
    )


@query("shard_digests", "with h as (select shard, sha256(concat_ws('|', fetch_id, coalesce(status, ''))) as h from fetch_log), p as (select shard, substr(h, 1, 4) as p, count(*) as n, sha256(array_to_string(list_sort(list(h)), '')) as s from h group by 1, 2) select shard, sum(n)::bigint as n_lines, sha256(array_to_string(list(s order by p), '')) as digest from p group by 1")
def shard_digests(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of shards: lines, and a digest of the digests of all lines, whatever their order. Lines are spread by the
    first four digits of their digest, and only one digest of each of these 65,536 parts comes together in a shard."""
    rows = table(spark, d, "fetch_log").select("shard", F.sha2(F.concat_ws("|", F.col("fetch_id").cast("string"), F.coalesce("status", F.lit(""))), 256).alias("h"))
    parts = rows.groupBy("shard", F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("s"))
    whole = parts.groupBy("shard").agg(F.sum("n").alias("n_lines"), F.sort_array(F.collect_list(F.struct("p", "s"))).alias("x"))
    return whole.select("shard", "n_lines", F.sha2(F.array_join("x.s", ""), 256).alias("digest"))


@query("convention_labels", "select d.row_id, p.publisher_name as label from delta d left join publishers p on split_part(d.doi, '/', 1) = p.doi_prefix")
def convention_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of a row's prefix from a table of prefixes, NULL where it has none."""
    dims = small(table(spark, d, "publishers").select(F.col("doi_prefix").alias("prefix"), F.col("publisher_name").alias("label")))
    return table(spark, d, "delta").select("row_id", tx.doi_prefix(F.col("doi")).alias("prefix")).join(dims, "prefix", "left").select("row_id", "label")


@query("display_forms", "with e as (select publisher_domain, count(error) / count(*) as x from parsed_rows where publisher_domain is not null group by 1) select publisher_domain, printf('%.1f%%', x * 100) as share, concat(case when x - 0.05 > 0 then '+' else '' end, printf('%.1f%%', (x - 0.05) * 100)) as beside from e")
def display_forms(spark: SparkSession, d: str) -> DataFrame:
    """Error shares as they are shown, and beside a mark of five per cent."""
    e = table(spark, d, "parsed_rows").where("publisher_domain IS NOT NULL").groupBy("publisher_domain").agg((F.count("error") / F.count("*")).alias("x"))
    return e.select("publisher_domain", tx.percent_text(F.col("x")).alias("share"), tx.signed_percent_text(F.col("x") - 0.05).alias("beside"))


@query("kept_types", "select doc_type, count(*) as n from documents where doc_type is null or lower(doc_type) not in ('note', 'review') group by 1")
def kept_types(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the types of a list; an unknown type is kept."""
    return records.without_types(table(spark, d, "documents"), "doc_type", ("note", "review")).groupBy("doc_type").agg(F.count("*").alias("n"))


_SETS = r"list_distinct(list_filter(list_transform({0}, lambda a: array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(a.name), '[^\pL\pN]+', ' ', 'g'), ' '), ' '))), ' ')), lambda k: coalesce(k, '') <> ''))"


@query("exact_scores", f"""with x as (select l.publisher_domain, coalesce({_SETS.format('g.authors')}, []) as g, coalesce({_SETS.format('l.parsed.authors')}, []) as p, coalesce({_SETS.format('list_filter(g.authors, lambda a: a.is_corresponding)')}, []) as cg, coalesce({_SETS.format('list_filter(l.parsed.authors, lambda a: a.is_corresponding)')}, []) as cp,
{_PLAIN.format('g.abstract')} as ga, {_PLAIN.format('l.parsed.abstract')} as pa from gold_rows g join {_LATEST} l using (rec_no)),
y as (select publisher_domain, len(list_intersect(g, p)) as tp, len(g) as ng, len(p) as np, len(list_intersect(cg, cp)) as ctp, len(cg) as nc, len(cp) as mc, ga = pa as same from x),
z as (select *, case when ng + np = 0 then 1 else 2 * tp / (ng + np) end as f1 from y)
select publisher_domain, count(*) as n, round(avg(f1), 6) as f1_mean, round(case when sum(np) = 0 then 0 else sum(tp) / sum(np) end, 6) as precision, round(case when sum(ng) = 0 then 0 else sum(tp) / sum(ng) end, 6) as recall,
sum(ctp)::bigint as flags_tp, (sum(mc) - sum(ctp))::bigint as flags_fp, (sum(nc) - sum(ctp))::bigint as flags_fn, count(*) filter (same) as abstracts_same from z group by 1""")
def exact_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores on the exact tier, native throughout: authors by their name sets, flags, abstracts in plain form, per publisher."""
    keys = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: records.normal_set(x["name"])), lambda k: F.coalesce(k, F.lit("")) != ""))
    sets = lambda a: F.coalesce(keys(a), F.array().cast("array<string>"))
    flagged = lambda a: F.filter(a, lambda x: x["is_corresponding"])
    side = lambda a, text, s: [sets(F.col(a)).alias(f"a_{s}"), sets(flagged(F.col(a))).alias(f"c_{s}"), audit.plain(F.col(text)).alias(f"t_{s}")]
    g = table(spark, d, "gold_rows").select("rec_no", *side("authors", "abstract", "g"))
    p = _latest(spark, d).select("rec_no", "publisher_domain", *side("parsed.authors", "parsed.abstract", "p"))
    shared = lambda c: F.size(F.array_intersect(f"{c}_g", f"{c}_p"))
    rows = g.join(p, "rec_no").select("publisher_domain", shared("a").alias("tp"), F.size("a_g").alias("ng"), F.size("a_p").alias("np"), shared("c").alias("ctp"), F.size("c_g").alias("nc"), F.size("c_p").alias("mc"), (F.col("t_g") == F.col("t_p")).alias("same"))
    f1 = F.when(F.col("ng") + F.col("np") == 0, 1.0).otherwise(2 * F.col("tp") / (F.col("ng") + F.col("np")))
    ratio = lambda a, b: F.round(F.when(F.sum(b) == 0, 0.0).otherwise(F.sum(a) / F.sum(b)), 6)
    return rows.groupBy("publisher_domain").agg(
        F.count("*").alias("n"), F.round(F.avg(f1), 6).alias("f1_mean"), ratio("tp", "np").alias("precision"), ratio("tp", "ng").alias("recall"), F.sum("ctp").alias("flags_tp"),
        (F.sum("mc") - F.sum("ctp")).alias("flags_fp"), (F.sum("nc") - F.sum("ctp")).alias("flags_fn"), F.count_if("same").alias("abstracts_same"),
    )
