"""Queries over the record tables whose results SQL can state: each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import merge, monitor, records, tuning
from sievewright.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


FLAGS = ("status", "has_bot_check", "resolves_to_pdf", "broken_doi", "no_english")
_ABSENT = "('', 'n/a', 'na', 'none', 'null')"
_LIST_EMPTY = "coalesce(lower(trim({0})) in ('', 'n/a', 'na', 'none', 'null', '[]'), true)"


@query("flag_values", " union all ".join(
    f"select '{f}' as flag, case upper(trim({f})) when 'TRUE' then true when 'FALSE' then false end as val, count(*) as n from delta group by 1, 2" for f in FLAGS
))
def flag_values(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), tx.flag(F.col(f)).alias("val")) for f in FLAGS])).alias("p")
    return table(spark, d, "delta").select(pairs).groupBy("p.flag", "p.val").agg(F.count("*").alias("n"))


@query("lenient_flags", "select lower(trim(no_english)) in ('true','1','yes') as val, count(*) as n from delta group by 1")
def lenient_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").groupBy(tx.lenient_flag(F.col("no_english")).alias("val")).agg(F.count("*").alias("n"))


@query("publisher_domains", r"select regexp_replace(lower(regexp_extract(trim(link), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as domain, count(*) as n from delta where link like '%://%' group by 1")
def publisher_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where(F.col("link").contains("://")).groupBy(tx.domain(F.col("link")).alias("domain")).agg(F.count("*").alias("n"))


_DOI = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(doi)), '^https://doi\.org/', ''), '^http://doi\.org/', ''), '^doi:', '')"


@query("doi_prefixes", f"select split_part({_DOI}, '/', 1) as prefix, count(*) as n, count(distinct {_DOI}) as n_dois from delta where doi is not null group by 1")
def doi_prefixes(spark: SparkSession, d: str) -> DataFrame:
    doi = tx.normal_doi(F.col("doi"))
    return table(spark, d, "delta").where(F.col("doi").isNotNull()).groupBy(tx.doi_prefix(doi).alias("prefix")).agg(F.count("*").alias("n"), F.countDistinct(doi).alias("n_dois"))


def _tag_sql(column: str) -> str:
    cases = ", ".join(f"case when regexp_matches({column}, '{p}', 'i') then '{label}' end" for label, p in records.FAILURES)
    return f"list_filter([{cases}], lambda x: x is not null)"


@query("failure_tags", f"select tag, count(*) as n from (select unnest(case when len(t) = 0 then ['clean'] else t end) as tag from (select {_tag_sql('notes')} as t from delta where notes is not null)) group by 1")
def failure_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = records.failure_modes(F.col("notes"))
    some = F.when(F.size(tags) == 0, F.array(F.lit("clean"))).otherwise(tags)
    return table(spark, d, "delta").where(F.col("notes").isNotNull()).select(F.explode(some).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("failure_tag_shares", "with t as (select unnest(case when len(failure_modes) = 0 then ['clean'] else failure_modes end) as tag from gold_rows) select tag, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from t group by 1")
def failure_tag_shares(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.size("failure_modes") == 0, F.array(F.lit("clean"))).otherwise(F.col("failure_modes"))
    counts = table(spark, d, "gold_rows").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total), how="cross").select("tag", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("empty_kinds", f"""select c.field, count(*) filter (coalesce(trim(v), '') in ('N/A','N/A`','NA','n/a','')) as gold_marker,
count(*) filter (coalesce(lower(trim(v)) in {_ABSENT} or lower(regexp_replace(trim(v), '[^\\pL\\pN_/]+$', '')) in {_ABSENT}, true)) as absent,
count(*) filter (coalesce(lower(trim(v)) in {_ABSENT}, true)) as merge_empty, count(*) filter ({_LIST_EMPTY.format('v')}) as list_empty
from (select 'abstract' as field, abstract as v from delta union all select 'authors', authors from delta union all select 'pdf_url', pdf_url from delta) c group by 1""")
def empty_kinds(spark: SparkSession, d: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("abstract", "authors", "pdf_url")])).alias("c")
    kinds = records.empties()
    return table(spark, d, "delta").select(cells).groupBy("c.field").agg(*[F.count_if(kinds[k](F.col("c.v"))).alias(k) for k in ("gold_marker", "absent", "merge_empty", "list_empty")])


_UNCOMMA = r"regexp_replace(t, ',\s*([\]}])', '\1', 'g')"
_UNQUOTE = """case when t like '"%"' then replace(regexp_replace(regexp_replace(t, '^"', ''), '"$', ''), '""', '"') end"""
_LISTS = " ".join(f"when json_valid({x}) and json_type({x}) = 'ARRAY' then {x}" for x in ("t", _UNCOMMA, _UNQUOTE))
_CELLS = f"with c as (select row_id, trim(coalesce(authors, ''), ' ') as t from delta), l as (select row_id, t, case {_LISTS} end as j from c)"


@query("authors_quality", f"{_CELLS}, q as (select case when t in ('N/A', 'N/A`', 'NA', 'n/a', '') or j is not null then 'ok' when starts_with(t, '[') then 'broken-json' else 'journal-title-leaked' end as quality from l) select quality, quality = 'ok' as scored, count(*) as n from q group by 1")
def authors_quality(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "delta").select(records.authors_quality(F.col("authors")).alias("q"))
    return q.groupBy("q.quality", "q.scored").agg(F.count("*").alias("n"))


@query("authors_typed", f"""{_CELLS}, a as (select row_id, unnest(json_extract(j, '$[*]')) as a, unnest(range(0, json_array_length(j)::bigint))::int as pos from l where j is not null)
select row_id, pos, a->>'name' as name, case when trim(coalesce(a->>'rasses', ''), ' ') <> '' then [trim(a->>'rasses', ' ')] else []::varchar[] end as affiliations, coalesce(a->>'corresponding_author', a->>'is_corresponding')::boolean as is_corresponding from a""")
def authors_typed(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "delta").select("row_id", F.posexplode(records.authors_of(F.col("authors"))).alias("pos", "a"))
    return typed.select("row_id", "pos", "a.name", "a.affiliations", "a.is_corresponding")


@query("completeness_by_prefix", """with a as (select split_part(doi, '/', 1) as prefix, list_filter(authors, lambda x: coalesce(trim(x.name), '') <> '') as named from gold_rows),
b as (select prefix, case when coalesce(len(named), 0) = 0 then 'no_authors' when len(list_filter(named, lambda x: len(list_filter(x.affiliations, lambda y: trim(y) <> '')) > 0)) = 0 then 'no_affiliations' else 'good' end as bucket from a)
select prefix, count(*) filter (bucket = 'good') as good, count(*) filter (bucket = 'no_affiliations') as no_affiliations, count(*) filter (bucket = 'no_authors') as no_authors from b group by 1""")
def completeness_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "gold_rows").select(tx.doi_prefix(F.col("doi")).alias("prefix"), records.completeness(F.coalesce("authors", F.array().cast("array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>"))).alias("bucket"))
    return b.groupBy("prefix").agg(*[F.count_if(F.col("bucket") == k).alias(k) for k in ("good", "no_affiliations", "no_authors")])


@query("truncated_meta", r"select publisher_domain, count(*) as n from delta where length(abstract) <= 250 and regexp_matches(abstract, '\.{2,}\s*$') group by 1")
def truncated_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where(records.truncated_meta(F.col("abstract"))).groupBy("publisher_domain").agg(F.count("*").alias("n"))


@query("non_latin", r"""with h as (select lang, regexp_replace(substr(text, 1, 400), '\PL', '', 'g') as l from documents where text is not null)
select lang, count(*) filter (length(l) > 0 and length(regexp_replace(l, '[\x{0000}-\x{024f}]', '', 'g')) * 2 >= length(l)) as n_non_latin, count(*) as n from h group by 1""")
def non_latin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).groupBy("lang").agg(F.count_if(records.mostly_non_latin(F.col("text"))).alias("n_non_latin"), F.count("*").alias("n"))


@query("latest_landing", "select rec_no, row_id, run_id from (select *, row_number() over (partition by rec_no order by landed_at desc nulls last, row_id desc) as r from delta) where r = 1")
def latest_landing(spark: SparkSession, d: str) -> DataFrame:
    # two aggregated structs instead of a sort of whole rows: partial maxima are taken before the shuffle
    best = F.max(F.struct("landed_at", "row_id", "run_id")).alias("b")
    return table(spark, d, "delta").groupBy("rec_no").agg(best).select("rec_no", "b.row_id", "b.run_id")


@query("first_seen_dois", "select lower(trim(doi)) as doi, min(row_id) as first_seq from delta where coalesce(trim(doi), '') <> '' group by 1")
def first_seen_dois(spark: SparkSession, d: str) -> DataFrame:
    return records.first_seen(table(spark, d, "delta"), F.lower(F.trim("doi")), "row_id", "doi")


@query("record_batches", "select (rec_no - 1) // 100 + 1 as batch_no, count(*) as n_rows from gold_rows group by 1")
def record_batches(spark: SparkSession, d: str) -> DataFrame:
    return records.batches(table(spark, d, "gold_rows"), "rec_no")


@query("missing_batches", "select i as batch_no from range(1, greatest(200, (select max(rec_no - 1) // 10 + 1 from gold_rows)) + 1) t(i) where i not in (select (rec_no - 1) // 10 + 1 from gold_rows)")
def missing_batches(spark: SparkSession, d: str) -> DataFrame:
    return records.missing_batches(table(spark, d, "gold_rows"), "rec_no", 10, 200)


@query("sides_of_records", "select 'both' as side, count(*) as n from (select distinct rec_no from gold_rows where rec_no in (select rec_no from parsed_rows)) union all select 'gold_only', count(*) from gold_rows where rec_no not in (select rec_no from parsed_rows where rec_no is not null) union all select 'parsed_only', count(distinct rec_no) from parsed_rows where rec_no not in (select rec_no from gold_rows)")
def sides_of_records(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_rows").select("rec_no").distinct().withColumn("g", F.lit(1))
    p = table(spark, d, "parsed_rows").select("rec_no").distinct().withColumn("p", F.lit(1))
    both = g.join(p, "rec_no", "full_outer")
    side = F.when(F.col("p").isNull(), "gold_only").when(F.col("g").isNull(), "parsed_only").otherwise("both")
    counts = both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("both",), ("gold_only",), ("parsed_only",)], "side string")
    return names.join(counts, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query("pending_records", "select rec_no, doi from gold_rows where rec_no not in (select rec_no from parsed_rows where parsed is not null and rec_no is not null)")
def pending_records(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "parsed_rows").where(F.col("parsed").isNotNull()).select("rec_no")
    return table(spark, d, "gold_rows").select("rec_no", "doi").join(done, "rec_no", "left_anti")


@query("error_stages", "select case when error is null then 'ok' when error like 'HTTP%' then 'http' when error = 'no harvest' then 'harvest' else 'other' end as stage, count(*) as n, count(parsed) as n_parsed, round(avg(coalesce(taxicab_duration_ms, 0) + coalesce(parseland_duration_ms, 0)), 6) as mean_ms from parsed_rows group by 1")
def error_stages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("error")
    stage = F.when(e.isNull(), "ok").when(e.startswith("HTTP"), "http").when(e == "no harvest", "harvest").otherwise("other")
    ms = F.coalesce("taxicab_duration_ms", F.lit(0.0)) + F.coalesce("parseland_duration_ms", F.lit(0.0))
    return table(spark, d, "parsed_rows").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.count("parsed").alias("n_parsed"), F.round(F.avg(ms), 6).alias("mean_ms"))


_RUNS = "select run_id, min(run_at) as started, count(*) as n_rows, count(error) as errors, round(count(error) / count(*), 6) as error_rate, round(avg(duration_ms), 6) as mean_ms from parsed_rows group by 1"


@query("runs", f"select run_id, n_rows, errors, error_rate, mean_ms from ({_RUNS})")
def runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).drop("started")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_rows").groupBy("run_id").agg(
        F.min("run_at").alias("started"), F.count("*").alias("n_rows"), F.count("error").alias("errors"),
        F.round(F.count("error") / F.count("*"), 6).alias("error_rate"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
    )


@query("run_deltas", f"with r as ({_RUNS}), w as (select *, lag(error_rate) over (order by started) as previous from r) select run_id, error_rate, previous, round(error_rate - previous, 6) as delta, case when previous is null then null when abs(error_rate - previous) <= 0.002 then 'flat' when error_rate > previous then 'up' else 'down' end as direction from w")
def run_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.run_deltas(_runs(spark, d), "error_rate", "started")
    return out.select("run_id", "error_rate", "previous", F.round("delta", 6).alias("delta"), "direction")


@query("fetch_status", "select status, count(*) as n, count(distinct doi) as n_dois, sum(attempts)::bigint as attempts from (select *, row_number() over (partition by rec_no order by fetched_at desc nulls last, fetch_id desc) as r from fetch_log) where r = 1 group by 1")
def fetch_status(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("fetched_at", "fetch_id", "status", "doi", "attempts")).alias("b")
    final = table(spark, d, "fetch_log").groupBy("rec_no").agg(last)
    return final.groupBy("b.status").agg(F.count("*").alias("n"), F.countDistinct("b.doi").alias("n_dois"), F.sum("b.attempts").alias("attempts"))


@query("fetch_latency", "with s as (select shard, duration_ms as v, row_number() over (partition by shard order by duration_ms) - 1 as i, count(*) over (partition by shard) as n from fetch_log where duration_ms is not null) select shard, max(n) as n, min(v) as lo, round(sum(v) / max(n), 6) as avg, (min(v) filter (i >= (n - 1) // 2) + min(v) filter (i >= n // 2)) / 2 as median, min(v) filter (i >= greatest(floor(n * 0.95) - 1, 0)) as p95, max(v) as hi from s group by 1")
def fetch_latency(spark: SparkSession, d: str) -> DataFrame:
    return monitor.latency(table(spark, d, "fetch_log"), "duration_ms", "shard")


@query("rolling_failures", "with w as (select shard, fetch_id, count(*) over p as c, avg(case when status <> 'ok' then 1 else 0 end) over p as s from fetch_log window p as (partition by shard order by fetch_id rows between 19 preceding and current row)) select shard, fetch_id, round(s, 6) as share from w where c = 20 and s >= 0.1")
def rolling_failures(spark: SparkSession, d: str) -> DataFrame:
    shares = monitor.rolling_share(table(spark, d, "fetch_log"), F.col("status") != "ok", "shard", "fetch_id")
    return shares.where("share >= 0.1").select("shard", "fetch_id", F.round("share", 6).alias("share"))


@query("running_attempts", "select shard, fetch_id, (sum(attempts) over (partition by shard order by fetch_id rows unbounded preceding))::bigint as total from fetch_log")
def running_attempts(spark: SparkSession, d: str) -> DataFrame:
    return monitor.running_sum(table(spark, d, "fetch_log"), "attempts", "shard", "fetch_id").select("shard", "fetch_id", "total")


@query("shard_routes", "with c as (select split_part(doi, '/', 1) as prefix, count(*) as n from delta where doi is not null group by 1) select case when n >= 10 then prefix else '_other' end as shard, sum(n)::bigint as n_rows, count(*) as n_prefixes from c group by 1")
def shard_routes(spark: SparkSession, d: str) -> DataFrame:
    return monitor.shard_routes(table(spark, d, "delta").where(F.col("doi").isNotNull()), tx.doi_prefix(F.col("doi")))


@query("manifest", "select shard, count(*) as n_lines, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'not_found') as n_not_found, count(*) filter (status not in ('ok', 'not_found')) as n_error, count(*) = count(*) filter (status = 'ok') + count(*) filter (status = 'not_found') + count(*) filter (status not in ('ok', 'not_found')) as conserved from fetch_log group by 1")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    counts = table(spark, d, "fetch_log").groupBy("shard").agg(F.count("*").alias("n_lines"), F.count_if(s == "ok").alias("n_ok"), F.count_if(s == "not_found").alias("n_not_found"), F.count_if(~s.isin("ok", "not_found")).alias("n_error"))
    return counts.withColumn("conserved", F.col("n_lines") == F.col("n_ok") + F.col("n_not_found") + F.col("n_error"))


@query("seed_and_holdout", "select case when rec_no <= 50 then 'seed' else 'holdout' end as part, count(*) as n from gold_rows group by 1")
def seed_and_holdout(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_rows").groupBy(F.when(F.col("rec_no") <= 50, "seed").otherwise("holdout").alias("part")).agg(F.count("*").alias("n"))


@query("top_publishers", "select publisher_domain, count(*) as n from delta where publisher_domain is not null group by 1 having count(*) >= 2 order by 2 desc, 1 limit 18")
def top_publishers(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "delta").where(F.col("publisher_domain").isNotNull()).groupBy("publisher_domain").agg(F.count("*").alias("n"))
    return counts.where("n >= 2").orderBy(F.desc("n"), "publisher_domain").limit(18)  # a top list is the feature


@query("publisher_rollup", "select coalesce(p.publisher_name, q.publisher_name, 'Other / Unknown') as publisher, count(*) as n, count(*) filter (d.abstract is not null) as n_abstract from delta d left join publishers p on split_part(d.doi, '/', 1) = p.doi_prefix left join publishers q on d.publisher_domain = q.publisher_domain group by 1")
def publisher_rollup(spark: SparkSession, d: str) -> DataFrame:
    from sievewright.session import small

    dim = table(spark, d, "publishers")
    by_prefix = small(dim.select(F.col("doi_prefix").alias("prefix"), F.col("publisher_name").alias("a")))
    by_domain = small(dim.select("publisher_domain", F.col("publisher_name").alias("b")))
    rows = table(spark, d, "delta").select(tx.doi_prefix(F.col("doi")).alias("prefix"), "publisher_domain", F.col("abstract").isNotNull().alias("has"))
    joined = rows.join(by_prefix, "prefix", "left").join(by_domain, "publisher_domain", "left")
    return joined.groupBy(F.coalesce("a", "b", F.lit("Other / Unknown")).alias("publisher")).agg(F.count("*").alias("n"), F.count_if("has").alias("n_abstract"))


@query("diverse_pick", "select prefix, row_id from (select split_part(doi, '/', 1) as prefix, row_id, row_number() over (partition by split_part(doi, '/', 1) order by row_id) as r from delta where doi is not null) where r = 1 order by row_id limit 10")
def diverse_pick(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "delta").where(F.col("doi").isNotNull()).groupBy(tx.doi_prefix(F.col("doi")).alias("prefix")).agg(F.min("row_id").alias("row_id"))
    return first.orderBy("row_id").limit(10)  # ten examples are the feature


@query("name_sets", r"""with n as (select rec_no, unnest(authors).name as name from gold_rows), t as (select rec_no, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(name), '[^\pL\pN]+', ' ', 'g')), ' '))), ' ') as name_set from n)
select name_set, count(*) as n, count(distinct rec_no) as n_records from t group by 1""")
def name_sets(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "gold_rows").select("rec_no", F.explode("authors").alias("a")).select("rec_no", records.normal_set(F.col("a.name")).alias("name_set"))
    return names.groupBy("name_set").agg(F.count("*").alias("n"), F.countDistinct("rec_no").alias("n_records"))


@query("shared_names", r"""with g as (select distinct rec_no, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(name), '[^\pL\pN]+', ' ', 'g')), ' '))), ' ') as k from (select rec_no, unnest(authors).name as name from gold_rows)),
p as (select distinct rec_no, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(name), '[^\pL\pN]+', ' ', 'g')), ' '))), ' ') as k from (select rec_no, unnest(parsed.authors).name as name from parsed_rows))
select rec_no, count(*) as n_shared from g join p using (rec_no, k) group by 1""")
def shared_names(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_rows").select("rec_no", F.explode("authors").alias("a")).select("rec_no", records.normal_set(F.col("a.name")).alias("k")).distinct()
    p = table(spark, d, "parsed_rows").select("rec_no", F.explode("parsed.authors").alias("a")).select("rec_no", records.normal_set(F.col("a.name")).alias("k")).distinct()
    return g.join(p, ["rec_no", "k"]).groupBy("rec_no").agg(F.count("*").alias("n_shared"))


@query("corresponding_counts", "select rec_no, len(authors) as n_authors, len(list_filter(authors, lambda x: x.is_corresponding)) as n_corresponding from gold_rows where authors is not null")
def corresponding_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_rows").where(F.col("authors").isNotNull()).select("rec_no", F.size("authors").cast("long").alias("n_authors"), F.size(F.filter("authors", lambda a: a["is_corresponding"])).cast("long").alias("n_corresponding"))


@query("fingerprints", "select row_id, substr(sha256(abstract), 1, 16) as print from delta where abstract is not null")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "delta").where(F.col("abstract").isNotNull()).select("row_id", tx.fingerprint(F.col("abstract")).alias("print"))


@query("pdf_agreement", f"""with p as (select *, row_number() over (partition by rec_no order by landed_at desc nulls last, parse_id desc) as r from parsed_rows),
u as (select p.publisher_domain, g.pdf_url as gu, case when len(list_filter(p.parsed.urls, lambda x: x.content_type = 'pdf')) > 0 then list_filter(p.parsed.urls, lambda x: x.content_type = 'pdf')[1].url else p.parsed.pdf_url end as pu from gold_rows g join p using (rec_no) where r = 1),
c as (select publisher_domain, case when {_LIST_EMPTY.format('gu')} then '' else lower(rtrim(trim(gu), '/')) end as a, case when {_LIST_EMPTY.format('pu')} then '' else lower(rtrim(trim(pu), '/')) end as b from u)
select publisher_domain, count(*) filter (a = b and a <> '') as tp, count(*) filter (b <> '' and a <> b) as fp, count(*) filter (a <> '' and a <> b) as fn from c group by 1""")
def pdf_agreement(spark: SparkSession, d: str) -> DataFrame:
    best = F.max(F.struct("landed_at", "parse_id", "publisher_domain", "parsed")).alias("b")
    p = table(spark, d, "parsed_rows").select("rec_no", "landed_at", "parse_id", "publisher_domain", F.struct("parsed.urls", "parsed.pdf_url").alias("parsed")).groupBy("rec_no").agg(best)
    pdfs = F.filter("b.parsed.urls", lambda u: u["content_type"] == "pdf")
    found = F.when(F.size(pdfs) > 0, F.element_at(pdfs, 1)["url"]).otherwise(F.col("b.parsed.pdf_url"))
    form = lambda c: F.when(tx.absent_list(c), "").otherwise(F.lower(F.regexp_replace(F.trim(c), "/+$", "")))
    rows = table(spark, d, "gold_rows").select("rec_no", form(F.col("pdf_url")).alias("x")).join(p.select("rec_no", F.col("b.publisher_domain").alias("publisher_domain"), form(found).alias("y")), "rec_no")
    x, y = F.col("x"), F.col("y")
    return rows.groupBy("publisher_domain").agg(F.count_if((x == y) & (x != "")).alias("tp"), F.count_if((y != "") & (x != y)).alias("fp"), F.count_if((x != "") & (x != y)).alias("fn"))


FIELDS = ["authors", "abstract", "pdf_url"]


@query("fill_rates", """with k as (select *, split_part(doi, '/', 1) as prefix from delta where doi is not null), a as (select *, row_number() over (partition by rec_no order by row_id) as f, row_number() over (partition by rec_no order by row_id desc) as l from k),
b as (select prefix, count(*) as n_before, """ + ", ".join(f"avg(case when {_LIST_EMPTY.format(f)} then 0 else 1 end) as {f}_b" for f in FIELDS) + """ from a where f = 1 group by 1),
c as (select prefix, """ + ", ".join(f"avg(case when {_LIST_EMPTY.format(f)} then 0 else 1 end) as {f}_a" for f in FIELDS) + """ from a where l = 1 group by 1)
select prefix, n_before, """ + ", ".join(f"round({f}_b, 6) as {f}_before, round({f}_a, 6) as {f}_after, round({f}_a - {f}_b, 6) as {f}_delta" for f in FIELDS) + " from b join c using (prefix) where n_before >= 10")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "delta").where(F.col("doi").isNotNull()).select("rec_no", "row_id", tx.doi_prefix(F.col("doi")).alias("prefix"), *FIELDS)
    ends = rows.groupBy("rec_no").agg(*[F.struct(f(F.struct("row_id", "prefix", *[(~tx.absent_list(F.col(x))).alias(x) for x in FIELDS]))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    side = lambda n: ends.select("rec_no", f"{n}.col1.*")
    rate = lambda df, s: df.groupBy("prefix").agg(F.count("*").alias(f"n_{s}"), *[F.avg(F.col(f).cast("int")).alias(f"{f}_{s}") for f in FIELDS])
    both = rate(side("first"), "before").join(rate(side("last"), "after"), "prefix").where("n_before >= 10")
    r = lambda c: F.round(c, 6)
    return both.select("prefix", "n_before", *[x for f in FIELDS for x in (r(f"{f}_before").alias(f"{f}_before"), r(f"{f}_after").alias(f"{f}_after"), r(F.col(f"{f}_after") - F.col(f"{f}_before")).alias(f"{f}_delta"))])


@query("merged_fields", f"""with a as (select *, row_number() over (partition by rec_no order by row_id) as f, row_number() over (partition by rec_no order by row_id desc) as l from delta),
j as (select b.rec_no, b.abstract, b.pdf_url, e.abstract as d_abstract, e.pdf_url as d_pdf_url, g.rec_no as has, g.abstract as g_abstract, g.pdf_url as g_pdf_url from a b join a e on b.rec_no = e.rec_no and b.f = 1 and e.l = 1 left join gold_rows g on g.rec_no = b.rec_no),
w as (select *, """ + ", ".join(f"({_LIST_EMPTY.format(f)}) and not ({_LIST_EMPTY.format('d_' + f)}) as can_{f}, has is not null and ({_LIST_EMPTY.format('g_' + f)}) as no_{f}" for f in ("abstract", "pdf_url")) + """ from j)
select rec_no, case when can_abstract and not no_abstract then d_abstract else abstract end as abstract, case when can_pdf_url and not no_pdf_url then d_pdf_url else pdf_url end as pdf_url,
(case when can_abstract and not no_abstract then 1 else 0 end + case when can_pdf_url and not no_pdf_url then 1 else 0 end)::int as filled, (case when can_abstract and no_abstract then 1 else 0 end + case when can_pdf_url and no_pdf_url then 1 else 0 end)::int as held_back from w""")
def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "delta").select("rec_no", "row_id", "abstract", "pdf_url")
    # only row numbers are aggregated; the rows themselves are fetched by them
    ends = rows.groupBy("rec_no").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"))
    end = lambda c: rows.join(ends.select(F.col(c).alias("row_id")), "row_id", "left_semi").drop("row_id")
    return merge.merge_filled(end("a"), end("b"), table(spark, d, "gold_rows"), "rec_no", ["abstract", "pdf_url"])


@query("best_parse", "select rec_no, parse_id, n_authors from (select rec_no, parse_id, run_id, len(list_filter(parsed.authors, lambda x: coalesce(trim(x.name), '') <> '')) as n_authors, row_number() over (partition by rec_no order by len(list_filter(parsed.authors, lambda x: coalesce(trim(x.name), '') <> '')) desc nulls last, run_id, parse_id) as r from parsed_rows) where r = 1")
def best_parse(spark: SparkSession, d: str) -> DataFrame:
    named = F.filter("parsed.authors", lambda a: F.coalesce(F.trim(a["name"]), F.lit("")) != "")
    runs = table(spark, d, "parsed_rows").select("rec_no", "parse_id", "run_id", F.when(F.col("parsed.authors").isNotNull(), F.size(named)).cast("long").alias("n_authors"))
    return records.one_per_key(runs, "rec_no", -F.coalesce("n_authors", F.lit(-1)), F.col("run_id"), F.col("parse_id")).select("rec_no", "parse_id", "n_authors")


@query("label_changes", "with a as (select *, row_number() over (partition by rec_no order by row_id) as f, row_number() over (partition by rec_no order by row_id desc) as l from delta), b as (select coalesce(status, '') as label, count(*) as n from a where f = 1 group by 1), c as (select coalesce(status, '') as label, count(*) as n from a where l = 1 group by 1) select coalesce(b.label, c.label) as label, coalesce(b.n, 0) as n_before, coalesce(c.n, 0) as n_after from b full join c on b.label = c.label")
def label_changes(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "delta").groupBy("rec_no").agg(F.min(F.struct("row_id", "status")).alias("a"), F.max(F.struct("row_id", "status")).alias("b"))
    side = lambda c: ends.select(F.coalesce(f"{c}.status", F.lit("")).alias("label"))
    return merge.label_changes(side("a"), side("b"), "label")


@query("explained_rows", f"select split_part(doi, '/', 1) as prefix, count(*) as n, round(100 * avg(case when not {_LIST_EMPTY.format('abstract')} and not {_LIST_EMPTY.format('authors')} or len({_tag_sql('notes')}) > 0 then 1 else 0 end), 2) as percent from delta where doi is not null group by 1")
def explained_rows(spark: SparkSession, d: str) -> DataFrame:
    filled = ~tx.absent_list(F.col("abstract")) & ~tx.absent_list(F.col("authors"))
    tagged = F.size(records.failure_modes(F.col("notes"))) > 0
    ok = F.coalesce(filled | F.coalesce(tagged, F.lit(False)), F.lit(False))
    return table(spark, d, "delta").where(F.col("doi").isNotNull()).groupBy(tx.doi_prefix(F.col("doi")).alias("prefix")).agg(F.count("*").alias("n"), F.round(100 * F.avg(ok.cast("int")), 2).alias("percent"))


_RATIO = "with v as (select length(p.parsed.abstract) / length(g.abstract) as x from gold_rows g join parsed_rows p using (rec_no) where length(p.parsed.abstract) > 0 and length(g.abstract) > 0), r as (select case when x > 1 then 1 / x else x end as v from v)"


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_rows").select("rec_no", F.length("abstract").alias("a")).where("a > 0")
    p = table(spark, d, "parsed_rows").select("rec_no", F.length("parsed.abstract").alias("b")).where("b > 0")
    x = F.col("b") / F.col("a")
    return g.join(p, "rec_no").select(F.when(x > 1, 1 / x).otherwise(x).alias("v"))


THRESHOLDS = [0.5, 0.6, 0.7, 0.74, 0.85, 0.95]


@query("threshold_sweep", _RATIO + ", t as (select unnest([" + ", ".join(map(str, THRESHOLDS)) + "]::double[]) as threshold) select threshold, count(*) filter (v >= threshold) as n_at_least, count(*) as n from r, t group by 1")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return tuning.sweep(_ratios(spark, d), "v", THRESHOLDS)


@query("threshold_otsu", _RATIO + ", h as (select least(199, floor(v * 200))::int as bin, count(*) as n from r group by 1), s as (select bin, sum(n) over (order by bin) as w0, sum(n * bin) over (order by bin) as s0, sum(n) over () as w, sum(n * bin) over () as s from h), b as (select bin, (w0::double * (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) as q from s where w0 < w) select (bin + 0.5::double) / 200 as threshold from b order by q desc, bin limit 1")
def threshold_otsu(spark: SparkSession, d: str) -> DataFrame:
    return tuning.otsu(_ratios(spark, d), "v")


@query("threshold_gap", _RATIO + ", u as (select distinct v from r where v >= 0.5), n as (select v, lead(v) over (order by v) as nx from u) select (v + nx) / 2 as threshold, v as low, nx as high from n where nx is not null order by nx - v desc, v limit 1")
def threshold_gap(spark: SparkSession, d: str) -> DataFrame:
    return tuning.largest_gap(_ratios(spark, d), "v")


@query("threshold_valley", _RATIO + """, c as (select round(v * 1000)::int as x, count(*) as k from r group by 1), m as (select count(v) as n, stddev(v) as sd from r),
d as (select i / 1000 as y, sum(k * exp(-pow((i / 1000 - x / 1000) / (1.06 * sd * pow(n, -0.2)), 2) / 2)) as d from range(0, 1001) t(i), c, m where n >= 4 and sd > 0 group by 1),
p as (select y, d, lag(d) over (order by y) as a, lead(d) over (order by y) as b from d), k as (select y from p where d > a and d > b order by d desc, y limit 2), e as (select min(y) as lo, max(y) as hi from k having count(*) = 2)
select y as threshold, lo as peak_low, hi as peak_high from d, e where y between lo and hi order by d, y limit 1""")
def threshold_valley(spark: SparkSession, d: str) -> DataFrame:
    return tuning.kde_valley(_ratios(spark, d), "v")


SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("ratio_quantiles", _RATIO + ", o as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from r), q as (select unnest([" + ", ".join(map(str, SHARES)) + "]::double[]) as share) select share, v as value from o, q where i = round_even(share * (n - 1), 0)")
def ratio_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return tuning.nearest_rank(_ratios(spark, d), "v", SHARES)


@query("ratio_bootstrap")
def ratio_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return tuning.bootstrap(_ratios(spark, d), "v")
