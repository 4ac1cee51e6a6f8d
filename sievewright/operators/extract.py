"""What a page states about its article, and ordered repairs of an extraction; pages stay in the JVM.

A page is cut once into the few kinds of elements that matter (`facts`): meta tags, data blocks, author anchors with
what follows them, raised marks, mail links with what stands before them. Repairs are columns over these facts; each
leaves a row as it is unless its own condition holds, and their order matters (REPAIRS). Only short extracted values
and data blocks pass through Python, to resolve entities and to walk nested data.

Defined cases: a page without an element gives empty lists; attributes may stand in any order, in double, single or no
quotes; several equal names of a page take the statement that comes last; null pages give no facts and stay unrepaired.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sievewright.operators.records import mostly_non_latin

AUTHOR = "struct<name:string,affiliation:string,is_corresponding:boolean>"
PLACED = "array<struct<name:string,affiliation:string>>"


# ---- entities and nested data ----------------------------------------------


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All named and numbered character entities."""
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


@F.pandas_udf(ArrayType(StringType()))
def unescape_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda values: None if values is None else [html.unescape(v) if v is not None and "&" in v else v for v in values])


def walk(node: object) -> Iterator[dict]:
    """All objects of a nested document, the outer ones first."""
    if isinstance(node, dict):
        yield node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from walk(child)


def _read(text: str | None) -> object:
    try:
        return json.loads(html.unescape(text) if text and text.lstrip().startswith("&") else text or "null")
    except ValueError:
        return None


def _tidy(value: object) -> str:
    return " ".join(value.split()) if isinstance(value, str) else ""


def _stated_place(value: object) -> str:
    """An affiliation given as text, as an object with a name or an address, or as a list of either."""
    if isinstance(value, list):
        return "; ".join(filter(None, map(_stated_place, value)))
    if isinstance(value, dict):
        return _tidy(value.get("name")) or _stated_place(value.get("address"))
    return _tidy(value)


def linked_people(block: str | None) -> list[tuple[str, str]]:
    """Names and affiliations of a linked-data block, whatever wraps the article; "Last, First" also the other way round."""
    best: dict[str, str] = {}
    for node in walk(_read(block)):
        people = node.get("author")
        for person in people if isinstance(people, list) else [people]:
            if not isinstance(person, dict):
                continue
            name = _tidy(person.get("name")) or _tidy(f"{_tidy(person.get('givenName'))} {_tidy(person.get('familyName'))}")
            place = _stated_place(person.get("affiliation"))
            last, comma, first = name.partition(",")
            for form in (name, f"{first.strip()} {last.strip()}" if comma and first.strip() else ""):
                if form and len(place) > len(best.get(form, "")):
                    best[form] = place
    return list(best.items())


def _visible(node: object) -> str:
    """The text of a typed tree ("#name", "_", "$$"), without its notes and references."""
    if not isinstance(node, dict) or node.get("#name") in ("footnote", "cross-ref"):
        return node if isinstance(node, str) else ""
    return _tidy(" ".join([str(node.get("_") or ""), *map(_visible, node.get("$$") or [])]))


def typed_people(block: str | None) -> list[tuple[str, str]]:
    """Names and affiliations of a typed data block: authors refer to the affiliations of the document by identifiers."""
    places: dict[str, str] = {}
    people: list[tuple[str, list[str]]] = []
    for node in walk(_read(block)):
        parts = [c for c in node.get("$$") or [] if isinstance(c, dict)]
        if node.get("#name") == "affiliation":
            texts = [_visible(c) for c in parts if c.get("#name") == "textfn"]
            if texts and texts[0]:
                places[(node.get("$") or {}).get("id", "")] = texts[0]
        elif node.get("#name") == "author":
            name = _tidy(" ".join(str(c.get("_") or "") for kind in ("given-name", "surname") for c in parts if c.get("#name") == kind))
            refs = [(c.get("$") or {}).get("refid") or "" for c in parts if c.get("#name") == "cross-ref"]
            people.append((name, [r for r in refs if r.startswith("A") and not r.startswith("AC")]))
    return [(name, "; ".join(places[r] for r in refs if r in places)) for name, refs in people if name and any(r in places for r in refs)]


def _people_udf(reader):
    @F.pandas_udf(PLACED)
    def read(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda values: [{"name": n, "affiliation": p} for v in (values if values is not None else []) for n, p in reader(v)])

    return read


#: Words and marks by which a page shows its corresponding author (fixed values).
MARKS = ("corresponding", "correspondence", 'class="corresp', "fa-envelope", "<sup>*</sup>", "penulis korespondensi", "корреспондирующий", "yazışma adresi")


# ---- elements --------------------------------------------------------------


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, in any quotes; the empty text without it."""
    found = F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'])(?:{name})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    return F.regexp_replace(F.regexp_replace(found, r"(?s)^[^=]*=\s*", ""), r"""^["']|["']$""", "")


def _has_class(word: str) -> str:
    return rf"""(?=[^>]*\bclass\s*=\s*["']?[^"'>]*\b{word})"""


def text_of(markup: Column) -> Column:
    """Markup without tags, in single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, r"<[^>]*>", " "), r"\s+", " "))


def facts(page: Column) -> Column:
    """metas (name, content), blocks of linked and of typed data, authors (anchor or the place that follows it, in order),
    raised marks after names, mails with what stands before them, first labelled paragraphs, links to files."""
    metas = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1)), lambda t: F.struct(F.lower(attribute(t, "name|property")).alias("name"), attribute(t, "content").alias("content")))
    scripts = F.regexp_extract_all(page, F.lit(r"(?is)<script\b([^>]*\bjson\b[^>]*>.*?)</script>"), F.lit(1))
    body = lambda s: F.regexp_replace(s, r"(?s)^[^>]*>", "")
    linked = F.transform(F.filter(scripts, lambda s: F.contains(F.lower(F.substring_index(s, ">", 1)), F.lit("ld+json"))), body)
    typed = F.transform(F.filter(scripts, lambda s: F.contains(F.lower(F.substring_index(s, ">", 1)), F.lit("data-iso-key"))), body)
    people = F.regexp_extract_all(page, F.lit(rf"(?is)(<a\b{_has_class('author')}[^>]*>.*?</a>|<span\b{_has_class('overlay')}[^>]*>[^<]*)"), F.lit(1))
    marks = F.regexp_extract_all(page, F.lit(rf"(?is)(<span\b{_has_class('sciprofiles-link__name')}[^>]*>[^<]*|<sup\b[^>]*>[^<]*</sup>)"), F.lit(1))
    # the search costs 500 steps a character, so only pages that hold such a link are searched
    mails = F.when(F.contains(F.lower(page), F.lit("mailto:")), F.regexp_extract_all(page, F.lit(r"""(?is)(.{0,500}\bhref\s*=\s*["']?mailto:[^"'@\s]+)@"""), F.lit(1))).when(page.isNotNull(), F.array().cast("array<string>"))
    labelled = F.regexp_extract_all(page, F.lit(rf"(?is)<div\b{_has_class('content-section')}[^>]*>.*?<p\b[^>]*>(.*?)</p>"), F.lit(1))
    latin = F.trim(F.regexp_extract(F.get(F.split(page, r"(?i)<b>\s*abstract\s*:?\s*</b>"), F.lit(1)), r"^\s*(?:<[^>]*>\s*)?([^<]*)", 1))
    low = F.regexp_replace(F.lower(page), r"\s+", " ")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    after = F.slice(F.split(page, r"""(?i)class\s*=\s*["'][^"'>]*\bcorresp(?:onding)?\b[^>]*>"""), 2, 1_000_000)
    near = F.flatten(F.transform(after, lambda part: F.regexp_extract_all(F.substring(part, 1, 600), F.lit(rf"(?is)<a\b{_has_class('author')}[^>]*>(.*?)</a>"), F.lit(1))))
    letter_to = F.regexp_extract(page, r"(?i:correspondence\s+to|corresponding\s+author)\s*:?\s*(?:Dr\.?\s+|Prof\.?\s+)?((?:[A-Z][\w.'-]*\s+){0,3}[A-Z][\w'-]+)", 1)
    files = F.regexp_extract_all(page, F.lit(r"""["'](/doi/e?pdf/[^"'\s<>]+)"""), F.lit(1))
    parts = {"metas": metas, "linked": linked, "typed": typed, "people": people, "marks": marks, "mails": mails, "labelled": labelled, "latin": latin, "marked": marked, "near": near, "letter_to": letter_to, "files": files}
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often later columns use it: the optimizer does not copy its
    expression into theirs, as it does with projections."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def meta_all(f: Column, name: str) -> Column:
    """Contents of all meta tags of a name, entities unresolved, in the order of the page."""
    return F.transform(F.filter(f["metas"], lambda m: m["name"] == name.lower()), lambda m: m["content"])


def meta_first(f: Column, *names: str) -> Column:
    """The first content that is not blank, over several names in order; the empty text without any."""
    filled = [F.filter(F.transform(meta_all(f, n), lambda v: F.trim(v)), lambda v: v != "") for n in names]
    return F.coalesce(*[F.try_element_at(v, F.lit(1)) for v in filled], F.lit(""))


def author(name: Column, place: Column, flag: Column) -> Column:
    return F.struct(name.alias("name"), place.alias("affiliation"), flag.alias("is_corresponding"))


def distribute(names: Column, places: Column) -> Column:
    """Authors with affiliations: place k belongs to author k, or, of more places, to author k / share (the last takes
    the rest); authors without one have a blank."""
    n, m = F.size(names), F.size(places)
    share = F.greatest(F.lit(1), F.floor(m / F.greatest(n, F.lit(1)))).cast("int")
    owner = lambda k: F.least((k / share).cast("int"), n - 1)
    own = lambda i: F.array_join(F.filter(places, lambda p, k: owner(k) == i), "; ")
    return F.transform(names, lambda name, i: author(F.trim(name), F.trim(own(i)), i == 0))


def _encoding(c: Column) -> Column:
    """Latin-1 readings of UTF-8 undone, where the whole text can be read so."""
    raw = F.encode(c, "ISO-8859-1").cast("string")
    garbled = c.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]") & ~c.rlike(r"[^\x{00}-\x{FF}]")
    return F.when(garbled, F.when(F.is_valid_utf8(raw), raw).otherwise(c)).otherwise(c)


def from_meta(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, page, f (facts), title, authors, abstract, pdf_url of pages that state a title and at least one author."""
    raw = held(pages.select(key, F.col(page).alias("page")), "f", facts(F.col("page")))
    f = F.col("f")
    raw = raw.select(
        key, "page", "f", meta_first(f, "citation_title", "DC.title", "og:title").alias("title"), meta_all(f, "citation_author").alias("names"),
        meta_all(f, "citation_author_institution").alias("places"), meta_first(f, "citation_abstract", "dc.description", "og:description").alias("abstract"),
        meta_first(f, "citation_pdf_url", "citation_full_html_url").alias("pdf_url"),
    ).where((F.col("title") != "") & (F.size("names") > 0))
    clean = raw.select(key, "page", "f", unescape("title").alias("title"), unescape_all("names").alias("names"), unescape_all("places").alias("places"), unescape("abstract").alias("abstract"), "pdf_url")
    whole = lambda c: F.transform(c, _encoding)
    return clean.select(key, "page", "f", _encoding(F.col("title")).alias("title"), distribute(whole(F.col("names")), whole(F.col("places"))).alias("authors"), _encoding(F.col("abstract")).alias("abstract"), "pdf_url")


def looks_cut(text: Column) -> Column:
    """Empty, or short and ending with an ellipsis or without a closing mark."""
    t = F.trim(F.coalesce(text, F.lit("")))
    last = F.right(t, F.lit(1))
    return (t == "") | (F.length(t) < 400) & (~last.isin(".", "?", "!", "。") | F.endswith(t, F.lit("...")))


# ---- repairs ---------------------------------------------------------------


def _key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def fill_places(df: DataFrame, people: Column) -> DataFrame:
    """Empty affiliations of authors from `people` (name, affiliation): the last one of a name, without regard to case."""
    df = held(df, "__p", people)

    found = lambda a: F.try_element_at(F.filter(F.col("__p"), lambda p: (_key(p["name"]) == _key(a["name"])) & (F.trim(p["affiliation"]) != "")), F.lit(-1))["affiliation"]
    empty = lambda a: F.coalesce(F.trim(a["affiliation"]), F.lit("")) == ""
    filled = F.transform("authors", lambda a: author(a["name"], F.when(empty(a), F.coalesce(found(a), a["affiliation"])).otherwise(a["affiliation"]), a["is_corresponding"]))
    return df.withColumn("authors", F.when(F.size("__p") > 0, filled).otherwise(F.col("authors"))).drop("__p")


def places_from_meta(df: DataFrame) -> DataFrame:
    """Empty affiliations from the page's tags by name; an empty address from its tag."""
    f = F.col("f")
    read = df.withColumn("__n", unescape_all(meta_all(f, "citation_author"))).withColumn("__i", unescape_all(meta_all(f, "citation_author_institution")))
    out = fill_places(read, F.transform(distribute(F.col("__n"), F.col("__i")), lambda a: F.struct(a["name"], a["affiliation"]))).drop("__n", "__i")
    return out.withColumn("pdf_url", F.when(F.coalesce(F.trim("pdf_url"), F.lit("")) == "", meta_first(f, "citation_pdf_url")).otherwise(F.col("pdf_url")))


def abstract_from_linked_data(df: DataFrame) -> DataFrame:
    """A cut abstract is replaced by the longest one of the linked data, if that is half as long again and over 200 characters."""
    quoted = F.flatten(F.transform(F.col("f.linked"), lambda b: F.regexp_extract_all(b, F.lit(r'(?i)"abstract"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))))
    read = F.transform(quoted, lambda q: F.from_json(F.concat(F.lit('{"v":'), q, F.lit("}")), "v string")["v"])
    best = F.array_max(F.transform(read, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    limit = F.greatest(F.floor(F.length(F.coalesce("abstract", F.lit(""))) * 3 / 2), F.lit(200))
    return df.withColumn("abstract", F.when(looks_cut(F.col("abstract")) & (best["n"] > limit), F.trim(best["v"])).otherwise(F.col("abstract")))


def abstract_is_title(df: DataFrame) -> DataFrame:
    """A short abstract that repeats the title is dropped."""
    same = (F.length(F.trim("abstract")) <= 200) & (F.lower(F.trim("abstract")) == F.lower(F.trim("title")))
    return df.withColumn("abstract", F.when(same, "").otherwise(F.col("abstract")))


def abstract_in_latin(df: DataFrame) -> DataFrame:
    """Where the abstract is in another script: the text after a bold label "Abstract", if it begins with a Latin letter
    and has 120 characters or more."""
    text = F.coalesce("f.latin", F.lit(""))
    fits = mostly_non_latin(F.col("abstract")) & text.rlike("^[A-Za-z]") & (F.length(text) > 120)
    return df.withColumn("abstract", F.when(fits, text).otherwise(F.col("abstract")))


def _flags(authors: Column, value) -> Column:
    return F.transform(authors, lambda a: author(a["name"], a["affiliation"], value(a)))


def _none_flagged() -> Column:
    return (F.size("authors") > 0) & ~F.exists("authors", lambda a: F.coalesce(a["is_corresponding"], F.lit(False)))


def flags_need_a_mark(df: DataFrame) -> DataFrame:
    """All of several authors flagged and no mark on the page: none is."""
    doubtful = (F.size("authors") > 1) & F.forall("authors", lambda a: F.coalesce(a["is_corresponding"], F.lit(False))) & ~F.coalesce("f.marked", F.lit(False))
    return df.withColumn("authors", F.when(doubtful, _flags(F.col("authors"), lambda a: F.lit(False))).otherwise(F.col("authors")))


def flags_from_class(df: DataFrame) -> DataFrame:
    """No author flagged: those whose names, whole or in part, stand in an author anchor soon after a corresponding-author element."""
    out = df.withColumn("__t", F.filter(F.transform("f.near", lambda n: _key(text_of(n))), lambda t: t != ""))
    within = lambda x, y: (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    hit = lambda a: F.exists(F.col("__t"), lambda t: within(t, _key(a["name"])))
    return out.withColumn("authors", F.when(_none_flagged() & (F.size("__t") > 0), _flags(F.col("authors"), hit)).otherwise(F.col("authors"))).drop("__t")


def places_from_overlay(df: DataFrame) -> DataFrame:
    """Empty affiliations from the place that follows an author anchor."""
    seq = F.col("f.people")
    is_place = lambda s: F.startswith(F.lower(s), F.lit("<span"))
    pairs = F.transform(seq, lambda s, i: F.struct(text_of(s).alias("name"), F.when(~is_place(s) & is_place(F.coalesce(F.get(seq, i + 1), F.lit(""))), text_of(F.get(seq, i + 1))).otherwise("").alias("affiliation")))
    out = df.withColumn("__o", F.filter(pairs, lambda p: p["affiliation"] != ""))
    clean = held(out, "__o", F.col("__o")).withColumn("__n", unescape_all(F.col("__o.name"))).withColumn("__a", unescape_all(F.col("__o.affiliation")))
    return fill_places(clean, F.zip_with("__n", "__a", lambda n, a: F.struct(n.alias("name"), _encoding(a).alias("affiliation")))).drop("__o", "__n", "__a")


def places_from_typed_data(df: DataFrame) -> DataFrame:
    """Empty affiliations from the page's typed data, by the identifiers that authors refer to."""
    return fill_places(df, _people_udf(typed_people)(F.col("f.typed")))


def places_from_linked_data(df: DataFrame) -> DataFrame:
    """Empty affiliations from the page's linked data; of several for a name the longest."""
    people = _people_udf(linked_people)(F.col("f.linked"))
    longest = F.array_sort(people, lambda a, b: F.length(a["affiliation"]) - F.length(b["affiliation"]))
    return fill_places(df, longest)


def abstract_from_section(df: DataFrame) -> DataFrame:
    """An abstract under 200 characters is replaced by the first paragraph of a content section of 200 or more."""
    text = F.coalesce(text_of(F.try_element_at(F.col("f.labelled"), F.lit(1))), F.lit(""))
    out = df.withColumn("__s", unescape(text))
    fits = (F.length(F.coalesce(F.trim("abstract"), F.lit(""))) < 200) & (F.length("__s") >= 200)
    return out.withColumn("abstract", F.when(fits, _encoding(F.col("__s"))).otherwise(F.col("abstract"))).drop("__s")


def surname_of_mail(local: Column) -> Column:
    """The letters at the end of the local part of a mail address, if they are three or more; else the empty text."""
    run = F.regexp_extract(local, "([A-Za-z]*)$", 1)
    return F.when(F.length(run) > 2, F.lower(run)).otherwise("")


def _flag_by_mail(df: DataFrame, local: Column) -> DataFrame:
    """No author flagged: the first one whose name holds the surname of a mail address, or all of it but an initial."""
    out = df.withColumn("__l", surname_of_mail(local))
    bare = lambda a: F.regexp_replace(F.lower(a["name"]), r"[\s.]+", "")
    fits = lambda a: F.contains(bare(a), F.col("__l")) | (F.length("__l") > 4) & F.contains(bare(a), F.substring("__l", 2, 1000))
    first = F.array_position(F.transform("authors", lambda a: F.coalesce(fits(a), F.lit(False))), True)
    hit = F.transform("authors", lambda a, i: author(a["name"], a["affiliation"], (i == first - 1) | F.coalesce(a["is_corresponding"], F.lit(False))))
    return out.withColumn("authors", F.when(_none_flagged() & (F.col("__l") != "") & (first > 0), hit).otherwise(F.col("authors"))).drop("__l")


def flag_from_mail(df: DataFrame) -> DataFrame:
    """By the mail link after a label of correspondence, or, without one, by the name that follows such a label."""
    after = r"(?is).*(?:author\s+for\s+correspondence|corresponding\s+author|correspondence\s+to|author-correspondence)"
    labelled = F.filter(F.col("f.mails"), lambda m: m.rlike(after))
    local = F.regexp_extract(F.try_element_at(labelled, F.lit(1)), r"(?is)mailto:(.+)$", 1)
    last = F.regexp_replace(F.substring_index("f.letter_to", " ", -1), "[^A-Za-z]", "")
    return _flag_by_mail(df, F.coalesce(F.nullif(local, F.lit("")), last))


def flag_from_meta_mail(df: DataFrame) -> DataFrame:
    """By a mail address within the affiliation tags."""
    stated = F.transform(meta_all(F.col("f"), "citation_author_institution"), lambda p: F.regexp_extract(p, r"(?i)e-?mail\s*:\s*([\w.%+-]+)@", 1))
    return _flag_by_mail(df, F.coalesce(F.try_element_at(F.filter(stated, lambda m: m != ""), F.lit(1)), F.lit("")))


def marks_from_names(df: DataFrame) -> DataFrame:
    """Raised marks after the names of a page, by position, where there are as many as authors: an empty affiliation takes
    the mark itself, and a star flags; flags are never taken away."""
    seq = F.col("f.marks")
    is_name = lambda s: F.startswith(F.lower(s), F.lit("<span"))
    after = F.transform(seq, lambda s, i: F.when(is_name(s) & F.startswith(F.lower(F.coalesce(F.get(seq, i + 1), F.lit(""))), F.lit("<sup")), text_of(F.get(seq, i + 1))))
    out = df.withColumn("__k", F.filter(after, lambda k: k.isNotNull()))
    mark = lambda i: F.get(F.col("__k"), i)
    empty = lambda a: F.coalesce(F.trim(a["affiliation"]), F.lit("")) == ""
    made = F.transform("authors", lambda a, i: author(a["name"], F.when(empty(a), mark(i)).otherwise(a["affiliation"]), F.coalesce(a["is_corresponding"], F.lit(False)) | F.contains(mark(i), F.lit("*"))))
    return out.withColumn("authors", F.when((F.size("__k") > 0) & (F.size("__k") == F.size("authors")), made).otherwise(F.col("authors"))).drop("__k")


def address_on_host(df: DataFrame) -> DataFrame:
    """An address of the identifier resolver is replaced by the page's own link to the file, on the page's host. Needs columns doi and resolved_url."""
    if not {"doi", "resolved_url"} <= set(df.columns):
        return df
    links = F.filter("f.files", lambda u: F.contains(F.lower(u), F.lower(F.col("doi"))))
    first = F.coalesce(F.try_element_at(F.filter(links, lambda u: F.contains(F.lower(u), F.lit("/doi/pdf/"))), F.lit(1)), F.try_element_at(links, F.lit(1)))
    host = F.lower(F.try_parse_url("resolved_url", F.lit("HOST")))
    resolver = F.lower(F.try_parse_url("pdf_url", F.lit("HOST"))).isin("doi.org", "dx.doi.org", "www.doi.org")
    return df.withColumn("pdf_url", F.when(resolver & first.isNotNull() & host.isNotNull(), F.concat(F.lit("https://"), host, first)).otherwise(F.col("pdf_url")))


REPAIRS = (
    places_from_meta, abstract_from_linked_data, abstract_is_title, abstract_in_latin, flags_need_a_mark, flags_from_class, places_from_overlay, places_from_typed_data,
    places_from_linked_data, abstract_from_section, flag_from_mail, marks_from_names, address_on_host,
)


def repair(df: DataFrame) -> DataFrame:
    """All repairs in order; df has the columns of from_meta."""
    if "f" not in df.columns:
        df = held(df, "f", facts(F.col("page")))
    df = df.drop("page")
    for step in REPAIRS:
        df = held(step(df), "authors", F.col("authors"))
    return df.drop("f")


# ---- corrections -----------------------------------------------------------


def corrected(df: DataFrame) -> DataFrame:
    """Rows with `verdicts` (array of field, verdict, text, by_name map<string,string>) applied: a failed field takes its
    text; failed affiliations and flags take their values by the author's name. `again` tells whether another round may
    help: some field failed, and not all passed."""
    failed = lambda field: F.try_element_at(F.filter("verdicts", lambda v: (v["field"] == field) & (v["verdict"] == "fail")), F.lit(1))
    text = lambda field: F.coalesce(failed(field)["text"], F.col(field))
    named = lambda a, field: failed(field)["by_name"][a["name"]]
    flag = lambda a: F.coalesce(F.lower(named(a, "is_corresponding")).isin("true", "1", "yes"), a["is_corresponding"])
    people = F.transform("authors", lambda a: author(a["name"], F.coalesce(named(a, "affiliation"), a["affiliation"]), flag(a)))
    again = F.exists("verdicts", lambda v: v["verdict"] == "fail")
    return df.withColumns({"authors": people, "abstract": text("abstract"), "pdf_url": text("pdf_url"), "again": again})
