"""Pages made from gold records in several layouts, and what is recovered from them: exact round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import extract
from sievewright.session import table


def _escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f'<meta name="{name}" content="'), _escape(c), F.lit('">\n'))


def _json(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per gold record that has authors and an abstract, with its metadata as tags and as linked data."""
    authors = F.array_join(F.transform("authors", lambda a: F.concat(_tag("citation_author", a["name"]), _tag("citation_author_institution", F.array_join(a["affiliations"], "; ")))), "")
    head = F.concat(_tag("citation_title", F.concat(F.lit("Record "), F.col("doi"))), authors, _tag("citation_abstract", F.col("abstract")), _tag("citation_pdf_url", F.coalesce("pdf_url", F.lit(""))))
    data = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct("abstract")), F.lit("</script>"))
    rows = table(spark, d, "gold_rows").where((F.size("authors") > 0) & (F.length(F.trim("abstract")) > 3))
    return rows.select("rec_no", "authors", "abstract", "pdf_url", F.concat(F.lit("<html><head>\n"), head, data, F.lit("</head></html>")).alias("page"))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Every author of every page, with what the page states about its article."""
    out = extract.repair(extract.from_meta(pages(spark, d), "rec_no", "page"))
    rows = out.select("rec_no", "title", F.posexplode("authors").alias("pos", "a"), "abstract", "pdf_url")
    return rows.select("rec_no", "title", "pos", "a.name", "a.affiliation", "a.is_corresponding", "abstract", "pdf_url")


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many records give back the names, affiliations and number of their authors, their abstract and the address of their file."""
    made = F.transform("known.authors", lambda a: F.struct(F.trim(a["name"]).alias("n"), F.trim(F.array_join(a["affiliations"], "; ")).alias("p")))
    # each page carries what it was made from, so that nothing is joined: no side is broadcast or shuffled
    rows = pages(spark, d).select(F.struct("authors", "abstract", "pdf_url").alias("known"), "page")
    out = extract.repair(extract.from_meta(rows, "known", "page"))
    found = F.transform("authors", lambda a: F.struct(a["name"].alias("n"), a["affiliation"].alias("p")))
    place = F.trim(F.coalesce("known.pdf_url", F.lit("")))
    same = (made == found) & (F.trim("known.abstract") == F.trim("abstract")) & (place == F.trim("pdf_url"))
    return pages(spark, d).agg(F.count("*").alias("n_pages")).crossJoin(out.agg(F.count_if(same).alias("n_same")))


LAYOUTS = ("tags", "overlay", "typed data", "linked data", "raised marks")


def _layouts() -> Column:
    """The same authors and affiliations written down in the layouts that publishers use, as (layout, page)."""
    place = lambda a: F.coalesce(F.array_join(a["affiliations"], "; "), F.lit(""))
    join = lambda f, by="": F.array_join(F.transform("authors", f), by)
    given = lambda a: F.trim(F.regexp_replace(a["name"], r"\S+\s*$", ""))
    surname = lambda a: F.regexp_extract(a["name"], r"(\S+)\s*$", 1)
    part = lambda kind, c: F.concat(F.lit('{"#name":"' + kind + '","_":'), _json(c), F.lit("}"))
    ref = lambda i: F.concat(F.lit("AF"), i.cast("string"))
    person = lambda a, i: F.concat(F.lit('{"#name":"author","$$":['), part("given-name", given(a)), F.lit(","), part("surname", surname(a)), F.lit(',{"#name":"cross-ref","$":{"refid":"'), ref(i), F.lit('"}}]}'))
    where = lambda a, i: F.concat(F.lit('{"#name":"affiliation","$":{"id":"'), ref(i), F.lit('"},"$$":['), part("textfn", place(a)), F.lit("]}"))
    typed = F.concat(F.lit('<script type="application/json" data-iso-key="_0">{"authors":{"content":[{"#name":"author-group","$$":['), join(person, ","), F.lit(","), join(where, ","), F.lit("]}]}}</script>"))
    linked = lambda a: F.concat(F.lit('{"name":'), _json(a["name"]), F.lit(',"affiliation":{"name":'), _json(place(a)), F.lit("}}"))
    anchor = lambda a: F.concat(F.lit('<a href="#" class="entry author">'), _escape(a["name"]), F.lit('<i class="fa"></i></a> <span class="overlay">'), _escape(place(a)), F.lit("<a>more</a></span>"))
    mark = lambda a, i: F.concat(F.lit('<span class="sciprofiles-link__name">'), _escape(a["name"]), F.lit("</span> <sup>"), (i + 1).cast("string"), F.lit("</sup>"))
    tags = join(lambda a: F.concat(_tag("citation_author", a["name"]), _tag("citation_author_institution", place(a))))
    graph = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"author":['), join(linked, ","), F.lit("]}]}</script>"))
    made = (tags, join(anchor), typed, graph, join(mark))
    return F.explode(F.array(*[F.struct(F.lit(n).alias("layout"), p.alias("page")) for n, p in zip(LAYOUTS, made, strict=True)]))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Per layout: authors with an affiliation, and those who get theirs back from the page (of raised marks: their mark).

    Records that name two authors alike are left out, as names are the key of the repair."""
    key = F.transform("authors", lambda a: F.lower(F.trim(F.regexp_replace(a["name"], r"\s+", " "))))
    rows = table(spark, d, "gold_rows").where((F.size("authors") > 0) & ~F.exists("authors", lambda a: F.coalesce(F.trim(a["name"]), F.lit("")) == ""))
    made = rows.where(F.size(F.array_distinct(key)) == F.size(key)).select("rec_no", "authors", _layouts().alias("x")).select("rec_no", "x.layout", "x.page", F.col("authors").alias("known"))
    bare = F.transform("known", lambda a: extract.author(a["name"], F.lit(""), F.lit(False)))
    out = extract.repair(made.select("layout", "page", "known", bare.alias("authors"), F.lit("").alias("title"), F.lit("").alias("abstract"), F.lit("").alias("pdf_url")))
    both = out.select("layout", F.posexplode(F.arrays_zip("known", "authors")).alias("pos", "z"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    want = tidy(F.array_join("z.known.affiliations", "; "))
    right = F.when(F.col("layout") == "raised marks", F.col("z.authors.affiliation") == (F.col("pos") + 1).cast("string")).otherwise(tidy(F.col("z.authors.affiliation")) == want)
    return both.where(want != "").groupBy("layout").agg(F.count("*").alias("n_authors"), F.count_if(right).alias("n_back"))


_FILLED = "gold_rows where len(authors) > 0 and length(trim(abstract)) > 3 and doi is not null"
QUERIES = {"pages_extracted": extracted, "pages_round_trip": round_trip, "page_places": places}
ORACLE = {
    "pages_round_trip": "select count(*) as n_pages, count(*) as n_same from gold_rows where len(authors) > 0 and length(trim(abstract)) > 3",
    "pages_extracted": f"""with g as (select rec_no, concat('Record ', doi) as title, unnest(authors) as a, unnest(range(0, len(authors)))::int as pos, trim(abstract, ' ') as abstract, trim(coalesce(pdf_url, ''), ' ') as pdf_url from {_FILLED})
select rec_no, title, pos, trim(a.name) as name, trim(coalesce(array_to_string(a.affiliations, '; '), '')) as affiliation, pos = 0 as is_corresponding, abstract, pdf_url from g""",
    "page_places": r"""with g as (select authors, list_transform(authors, lambda a: lower(trim(regexp_replace(a.name, '\s+', ' ', 'g')))) as k from gold_rows where len(authors) > 0 and len(list_filter(authors, lambda a: coalesce(trim(a.name), '') = '')) = 0),
a as (select unnest(authors) as a from g where len(list_distinct(k)) = len(k)), n as (select count(*) as n from a where trim(regexp_replace(array_to_string(a.affiliations, '; '), '\s+', ' ', 'g')) <> '')
select unnest(['tags', 'overlay', 'typed data', 'linked data', 'raised marks']) as layout, n as n_authors, n as n_back from n""",
}
