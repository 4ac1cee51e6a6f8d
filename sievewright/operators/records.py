"""Normalising, classifying and de-duplicating landed records; all native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text as tx

#: Tags of notes and the patterns that give them, in order; a note can have several (fixed values).
FAILURES = (
    ("paywall", r"\bpay(?:wall|.{0,6}view|.{0,6}access|.{0,6}subscription)\b|subscription based|need to pay|need to buy"),
    ("login", r"login|institution|sign[-\s]?in|subscription"),
    ("bot_check", r"bot|captcha|cloudflare|security"),
    ("no_abstract", r"no abstract|abstract.*image|abstract.*not available"),
    ("broken_url", r"broken|seems broken|not found|unspecified server error"),
    ("non_article", r"obituary|dataset|video|journal\b|chapter|grant"),
    ("image_only", r"image|screenshot"),
    ("login_screen", r"thank[s]? for visit(?:i)?ng|oxford dictionary"),
)
AUTHOR = "array<struct<name:string,rasses:string,affiliations:array<string>,corresponding_author:boolean,is_corresponding:boolean>>"


def failure_modes(notes: Column) -> Column:
    """Tags of a note in table order; none for NULL."""
    tags = F.array(*[F.when(notes.rlike(f"(?i){p}"), F.lit(label)) for label, p in FAILURES])
    return F.filter(tags, lambda t: t.isNotNull())


def author_list(cell: Column) -> Column:
    """The author list of a cell as variant: as it is, without stray commas, or with its doubled quotes undone; else NULL."""
    text = F.trim(cell)
    no_commas = F.regexp_replace(text, r",\s*([\]}])", "$1")
    unquoted = F.when(text.rlike(r'^".*"$'), F.regexp_replace(F.regexp_replace(text, r'^"|"$', ""), '""', '"'))
    tries = [F.try_parse_json(c) for c in (text, no_commas, unquoted)]
    return F.coalesce(*[F.when(F.schema_of_variant(t).startswith("ARRAY"), t) for t in tries])


def authors_quality(cell: Column) -> Column:
    """(quality, scored): a list or nothing is ok; broken lists and leaked titles are not scored."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    nothing = text.isin("N/A", "N/A`", "NA", "n/a", "")
    quality = F.when(nothing | author_list(cell).isNotNull(), "ok").when(text.startswith("["), "broken-json").otherwise("journal-title-leaked")
    return F.struct(quality.alias("quality"), (quality == "ok").alias("scored"))


def authors_of(cell: Column) -> Column:
    """Typed authors of a cell: name, affiliations (the first filled alternative), whether corresponding; empty if unreadable."""
    typed = F.from_json(F.to_json(author_list(cell)), AUTHOR)
    filled = lambda a: F.when(F.coalesce(F.trim(a["rasses"]), F.lit("")) != "", F.array(F.trim(a["rasses"])))
    several = lambda a: F.filter(F.transform(a["affiliations"], lambda x: F.trim(x)), lambda x: x != "")
    shaped = lambda a: F.struct(
        a["name"].alias("name"),
        F.coalesce(F.when(F.size(several(a)) > 0, several(a)), filled(a), F.array().cast("array<string>")).alias("affiliations"),
        F.coalesce(a["corresponding_author"], a["is_corresponding"]).alias("is_corresponding"),
    )
    return F.coalesce(F.transform(typed, shaped), F.array().cast("array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>"))


def completeness(authors: Column) -> Column:
    """good, without affiliations, or without authors; named authors count."""
    named = F.filter(authors, lambda a: F.coalesce(F.trim(a["name"]), F.lit("")) != "")
    bare = F.forall(named, lambda a: F.size(F.filter(a["affiliations"], lambda x: F.trim(x) != "")) == 0)
    return F.when(F.size(named) == 0, "no_authors").when(bare, "no_affiliations").otherwise("good")


def one_per_key(df: DataFrame, key: str, *order: Column, greatest: bool = False) -> DataFrame:
    """The row of each key whose order expressions are least, or greatest; NULL counts as least.

    An aggregation, not a window: each task keeps one row a key before the shuffle, so a key with very many landings
    is no burden. Ties of all expressions keep one of the equal rows.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg((F.max_by if greatest else F.min_by)(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(key, *[F.col(f"__b.`{c}`").alias(c) for c in rest]).select(*df.columns)


def latest_rows(df: DataFrame, key: str, at: str, row_id: str) -> DataFrame:
    """The row of each key with the latest `at` (NULL is earliest), of equal ones the greatest row_id, which is unique.

    Only key, time and row number are aggregated (fixed-size values, hashed map-side); whole rows are fetched by a
    semi-join on their number, so texts are never sorted.
    """
    best = df.groupBy(key).agg(F.max(F.struct(at, row_id)).alias("b")).select(F.col(f"b.{row_id}").alias(row_id))
    return df.join(best, row_id, "left_semi")


def first_seen(df: DataFrame, value: Column, seq: str, name: str) -> DataFrame:
    """Distinct values with the sequence number of their first sight: an aggregation, no window."""
    return df.select(value.alias(name), seq).where(F.coalesce(F.trim(name), F.lit("")) != "").groupBy(name).agg(F.min(seq).alias("first_seq"))


def batches(df: DataFrame, number: str, size: int = 100) -> DataFrame:
    """Rows per batch of consecutive numbers from 1; numbers that are no positive integers are left out."""
    n = F.try_to_number(F.col(number).cast("string"), F.lit("999999999999999999")).cast("long")
    return df.select((F.floor((n - 1) / size) + 1).alias("batch_no")).where("batch_no >= 1").groupBy("batch_no").agg(F.count("*").alias("n_rows"))


def missing_batches(df: DataFrame, number: str, size: int, last: int) -> DataFrame:
    """Batch numbers without any row, from 1 to last or to the last batch of the rows, whichever is higher."""
    have = batches(df, number, size).select("batch_no")
    last = max(last, have.agg(F.max("batch_no").alias("b")).first()["b"] or 0)
    return df.sparkSession.range(1, last + 1).select(F.col("id").alias("batch_no")).join(have, "batch_no", "left_anti")


def empties() -> dict[str, object]:
    """The different notions of an empty cell that the operators use, by name."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    unreadable = lambda c: F.try_parse_json(c).isNull()
    return {
        "gold_marker": lambda c: blank(c).isin("N/A", "N/A`", "NA", "n/a", ""),
        "absent": tx.absent,
        "merge_empty": lambda c: F.coalesce(F.lower(F.trim(c)).isin(*tx.ABSENT), F.lit(True)),
        "list_empty": tx.absent_list,
        "authors_empty_merge": lambda c: tx.absent_list(c) | unreadable(c),
        "authors_empty_fallback": tx.absent_list,
    }


def truncated_meta(text: Column) -> Column:
    """A page description in place of an abstract: short, ending with two or more full stops."""
    return (F.length(text) <= 250) & text.rlike(r"\.{2,}\s*$")


def mostly_non_latin(text: Column) -> Column:
    """Half or more of the letters among the first 400 characters lie above U+024F."""
    head = F.substring(text, 1, 400)
    letters = F.length(F.regexp_replace(head, r"\P{L}", ""))
    high = F.length(F.regexp_replace(F.regexp_replace(head, r"\P{L}", ""), "[\u0000-ɏ]", ""))
    return (letters > 0) & (high * 2 >= letters)


def normal_set(names: Column) -> Column:
    """Sorted distinct lower-case tokens of a name: the key of joins that do not heed the order of name parts."""
    words = F.split(F.trim(F.regexp_replace(F.lower(names), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def batch_rows(df: DataFrame, number: str, batch: int, size: int = 100) -> DataFrame:
    """The rows of one batch of consecutive numbers from 1; numbers that are no positive integers are in none."""
    n = F.try_to_number(F.col(number).cast("string"), F.lit("999999999999999999")).cast("long")
    return df.where(n.between((batch - 1) * size + 1, batch * size))


def input_rows(df: DataFrame, required: tuple[str, ...], key: str) -> DataFrame:
    """Rows with a key; missing columns are refused. Rows without a key are dropped before any limit is taken."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.where(F.coalesce(F.trim(key), F.lit("")) != "")


def without_types(df: DataFrame, kind: str, dropped: tuple[str, ...]) -> DataFrame:
    """Rows whose type is not in a list, without regard to case; rows without a type stay."""
    return df.where(~F.coalesce(F.lower(kind).isin(*[t.lower() for t in dropped]), F.lit(False)))


def renamed(df: DataFrame, names: dict[str, str], back: bool = False) -> DataFrame:
    """Columns under other names, or back under their own: nothing else changes."""
    pairs = {v: k for k, v in names.items()} if back else names
    if len(set(pairs.values())) < len(pairs):
        raise ValueError("two columns would have one name")
    return df.withColumnsRenamed(pairs)
