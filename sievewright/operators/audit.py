"""What became of a record: labels, routes, audits of three sources, row shapes. All native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text as tx

#: Hosts that ask for payment, with the label they give (fixed values).
PAYWALLS = (
    (r"linkinghub\.elsevier\.com|sciencedirect\.com", "elsevier"), (r"link\.springer\.com", "springer"), (r"onlinelibrary\.wiley\.com", "wiley"),
    (r"tandfonline\.com", "taylor-francis"), (r"journals\.sagepub\.com", "sage"), (r"link\.aps\.org|journals\.aps\.org", "aps"), (r"academic\.oup\.com", "oup"),
    (r"karger\.com", "karger"), (r"thieme\.com|thieme-connect\.com", "thieme"), (r"ieeexplore\.ieee\.org", "ieee"), (r"jstor\.org", "jstor"), (r"degruyter(?:brill)?\.com", "degruyter"),
)
#: Hosts of bot checks (fixed values).
BOT_HOSTS = ((r"validate\.perfdrive\.com", "perimeterx"), (r"challenges\.cloudflare\.com", "cloudflare"))
#: Addresses of files behind a paywall (fixed values).
PAID_FILES = (
    r"link\.springer\.com/content/pdf/", r"academic\.oup\.com/[^/]+/article-pdf/", r"link\.aps\.org/pdf/", r"onlinelibrary\.wiley\.com/doi/(?:e?pdf|pdfdirect)/",
    r"(?:www\.)?thieme-connect\.de/products/ejournals/pdf/", r"(?:www\.)?emerald\.com/[^/]+/(?:edited-volume/)?chapter-pdf/", r"(?:www\.)?jove\.com/pdf/",
    r"revistas\.[^/]+/[^/]+/index\.php/[^/]+/article/download/", r"(?:www\.)?brill\.com/downloadpdf/(?:display/)?book/", r"journals\.plos\.org/[^/]+/article/file",
    r"(?:www\.)?nature\.com/articles/[^/]+\.pdf$", r"pubs\.rsc\.org/en/content/articlepdf/", r"iopscience\.iop\.org/article/.+/pdf$", r"(?:[\w-]+\.)?adsabs\.harvard\.edu/(?:link_gateway|abs)/",
)
#: Signs of a bot check in the first part of a page (fixed values), and how much of it is looked at.
BOT_SIGNS, HEAD = ("captcha", "cloudflare", "are you a robot", "just a moment", "access denied"), 8000


def _first(pairs, value: Column, make) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(pairs):
        out = F.when(value.rlike(pattern), F.lit(make(label))).otherwise(out)
    return out


def structural_label(fields: list[Column], resolved: Column) -> Column:
    """Why fields may be empty, by where the identifier led: NULL if all are filled; else the bot check, a file, a
    paywall, in this order, or a miss of the extraction."""
    empty = F.lit(False)
    for f in fields:
        empty = empty | tx.absent_list(f)
    path = F.regexp_extract(F.lower(resolved), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    file = F.when(F.endswith(path, F.lit(".pdf")), "pdf-redirect")
    label = F.coalesce(_first(BOT_HOSTS, resolved, lambda x: f"bot-check:{x}"), file, _first(PAYWALLS, resolved, lambda x: f"paywalled={x}"), F.lit("extraction-miss"))
    return F.when(empty, label)


def paid_file(url: Column) -> Column:
    """Addresses of files that a reader without access does not get."""
    return F.coalesce(url.rlike("(?i)^https?://(?:" + "|".join(PAID_FILES) + ")"), F.lit(False))


def page_state(page: Column, url: Column) -> Column:
    """blocked, ok (long enough and not blocked) and useful (states its article in tags) of a fetched page."""
    head, address = F.lower(F.substring(page, 1, HEAD)), F.lower(F.coalesce(url, F.lit("")))
    blocked = F.contains(address, F.lit("captcha")) | F.contains(address, F.lit("challenge"))
    for sign in BOT_SIGNS:
        blocked = blocked | F.contains(head, F.lit(sign))
    blocked = F.coalesce(blocked, F.lit(False))
    useful = F.coalesce(F.contains(F.lower(page), F.lit("citation_author")) | F.contains(F.lower(page), F.lit("citation_title")), F.lit(False))
    return F.struct(blocked.alias("blocked"), (~blocked & (F.coalesce(F.length(page), F.lit(0)) > 2000)).alias("ok"), useful.alias("useful"))


def within(a: Column, b: Column) -> Column:
    """Neither is empty, and one holds the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def plain(c: Column) -> Column:
    return F.coalesce(F.lower(tx.spaces(c)), F.lit(""))


def route(filled: list[Column], known: Column, pairs: list[tuple[Column, Column]]) -> Column:
    """(confidence, route): something missing is fetched again; without a second source it passes with less confidence;
    values of which neither holds the other go to a person."""
    missing, differ = F.lit(False), F.lit(False)
    for f in filled:
        missing = missing | tx.absent_list(f)
    for a, b in pairs:
        x, y = plain(a), plain(b)
        differ = differ | ((x != "") & (y != "") & ~within(x, y))
    verdict = lambda p, r: F.struct(F.lit(p).alias("confidence"), F.lit(r).alias("route"))
    return F.when(missing, verdict(0.3, "livefetch")).when(~known, verdict(0.6, "skip_livefetch")).when(differ, verdict(0.4, "human_audit")).otherwise(verdict(0.9, "skip_livefetch"))


def three_sources(gold: Column, found: Column, stated: Column) -> Column:
    """Which of three texts of one thing agree: trusted, extracted, and stated by the page."""
    g, a, m = plain(gold), plain(found), plain(stated)
    same = lambda x, y: (x != "") & (x == y)
    return (
        F.when((g == "") & (a == "") & (m == ""), "all_empty").when(same(a, g), "found_is_gold").when(same(a, m) & ~same(g, m), "found_is_stated_not_gold")
        .when(within(a, m) & ~within(g, m), "found_within_stated_not_gold").when(same(g, m), "gold_is_stated_found_misses")
        .when((a != "") & (g == ""), "found_gold_empty").when((g != "") & (a == ""), "gold_found_empty").otherwise("differ")
    )


def file_verdict(gold: Column, base: Column, candidate: Column) -> Column:
    """A candidate's address beside a baseline's, against the trusted one; both absent where none is expected counts apart."""
    g, b, c = (F.when(tx.absent_list(x), "").otherwise(F.lower(F.regexp_replace(F.trim(x), "/+$", ""))) for x in (gold, base, candidate))
    return F.when((g == "") & (b == "") & (c == ""), "joint_absent").when((b == g) & (c == g), "match").when(c == g, "candidate_win").when(b == g, "regression").otherwise("both_differ")


def affiliation_bucket(gold: Column, found: Column) -> Column:
    """How two affiliation texts differ: NULL if they do not; 1 empty, 2 marks only, 3 detail left out, 4 other."""
    g, p = plain(gold), plain(found)
    bare = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1)))
    tg, tp = words(g), words(p)
    extra, shared = F.size(F.array_except(tp, tg)), F.size(F.array_intersect(tp, tg))
    n, m = F.length(F.coalesce(found, F.lit(""))), F.length(F.coalesce(gold, F.lit("")))
    detail = (extra == 0) & (n < m) | (shared / F.greatest(F.size(tp), F.lit(1)) >= 0.9) & (extra <= 1) & (n < 0.85 * m)
    return F.when(g == p, None).when(p == "", 1).when((bare(g) == bare(p)) & (bare(g) != ""), 2).when((F.size(tg) == 0) | (F.size(tp) == 0), 4).when(detail, 3).otherwise(4)


def gold_cells(df: DataFrame, strict: bool = True) -> DataFrame:
    """The cells of a record file from an extraction (authors, abstract, pdf_url, notes, error, has_bot_check, filled).

    strict: the status is TRUE only without a bot check and an error, cells of a failed extraction stay blank; else it is
    TRUE for any extraction, an empty author list is [] and flags are FALSE.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    people = F.when(F.size(F.coalesce("authors", F.array())) > 0, F.to_json("authors")).otherwise("" if strict else "[]")
    ok = F.col("filled") & ~F.coalesce("has_bot_check", F.lit(False)) & F.col("error").isNull() if strict else F.col("filled")
    flag = F.upper(F.coalesce("has_bot_check", F.lit(False)).cast("string"))
    return df.select(
        "rec_no", "doi", people.alias("authors_cell"), text("abstract").alias("abstract"), text("pdf_url").alias("pdf_url"), F.upper(ok.cast("string")).alias("status"),
        F.coalesce(F.nullif("notes", F.lit("")), "error", F.lit("")).alias("notes"), F.when(F.col("filled") | F.lit(not strict), flag).otherwise("").alias("has_bot_check"),
    )


def appended(notes: Column, label: Column) -> Column:
    """A label after what the notes already hold, once."""
    had = F.coalesce(F.trim(notes), F.lit(""))
    return F.when(label.isNull() | F.contains(had, label), had).when(had == "", label).otherwise(F.concat_ws(" | ", had, label))


def numbered(df: DataFrame, *order: str, name: str = "no", width: int = 50_000) -> DataFrame:
    """Consecutive numbers from 1 in the order of a whole-number column and ties: counted by blocks of its numbers, so
    no task sorts all rows."""
    from pyspark.sql import Window

    block = F.floor(F.col(order[0]) / width)
    counts = df.groupBy(block.alias("__b")).agg(F.count("*").alias("k"))
    before = counts.select("__b", F.coalesce(F.sum("k").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))  # one row a block
    rows = df.withColumn("__b", block).join(before, "__b")
    return rows.withColumn(name, F.col("__s") + F.row_number().over(Window.partitionBy("__b").orderBy(*order))).drop("__b", "__s")


#: Lines of a run's log (fixed values): a batch begins, a row is done, a file is written, something broke.
LOG_LINES = {"batch": r"Batch\s+(\d+)\s+starting", "row": r"row\s+(\d+):\s+(\S+)\s+\(([\d.]+)ms\)", "wrote": r"^wrote\s+(.+\.json)\s*$", "trace": r"^(Traceback|\s+File\s|Error:)"}


def log_events(lines: DataFrame, line: str) -> DataFrame:
    """kind, number, status and milliseconds of each line that is one of LOG_LINES; further columns stay."""
    c = F.col(line)
    kind = F.when(c.rlike(LOG_LINES["batch"]), "batch").when(c.rlike(LOG_LINES["row"]), "row").when(c.rlike(LOG_LINES["wrote"]), "wrote").when(c.rlike("(?i)" + LOG_LINES["trace"]), "trace")
    part = lambda k: F.regexp_extract(c, LOG_LINES["row"], k)
    number = F.when(kind == "batch", F.regexp_extract(c, LOG_LINES["batch"], 1)).when(kind == "row", part(1))
    out = lines.withColumns({"kind": kind, "number": number.cast("long"), "status": F.when(kind == "row", part(2)), "ms": F.when(kind == "row", part(3)).cast("double")})
    return out.where("kind IS NOT NULL")


def without_scripts(page: Column, most: int) -> Column:
    """A page without scripts, styles and comments: its head, and its body up to `most` characters (for a reader with a limit)."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1>", ""), r"(?s)<!--.*?-->", "")
    head = F.regexp_extract(bare, r"(?is)<head\b.*?</head>", 0)
    return F.concat(head, F.substring(F.replace(bare, head, F.lit("")), 1, most))
