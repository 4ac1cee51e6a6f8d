"""Variant spellings of names typed by people: entries of one person, and affiliations of one organisation, are linked.

One similarity join serves persons and organisations. A name is a set of tokens; a token is posted under its PREFIX
rarest q-grams only, which is enough for two tokens that are one typing slip apart to meet (a slip spoils at most Q + 1
q-grams). Names that meet are verified by soft weighted token similarity: every token of one name is matched with an
equal token of the other, with one that is a slip away, or with its initial, and counts by its rarity, so that a rare
token decides and a common one hardly matters.

- Organisations: the rarest token of a registered name is searched in the affiliation texts; all its tokens must be
  found in the text, and the similarity must reach LEAST_ORG. No token is too short: tokens of up to three letters are
  matched as they are.
- Persons: names meet within an organisation, posted under a token's q-grams and the first letter of another token, so
  neither the order of the parts nor which of them is the surname matters. Full spellings that are linked form a
  person, however long the chain; an abbreviated spelling belongs to the person of its most similar full spelling.

Everything works on distinct spellings (of a place): copies are aggregated away before any join, and come back only
when members of a person are paired.

Defined cases: null and blank names are nobody; entries without any affiliation are linked to the one person of their
name if all that is known of the name is one person, else, if nothing is known of the name, to each other; an
abbreviation that fits several people of a place equally well is linked to none of them; a name of one token is linked
to the same name only; several organisations in one entry all come out; repeated records are linked like others;
empty tables give no rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.packed import split_packed
from sievewright.session import cut, small

Q, PREFIX = 3, 5
#: Least soft weighted similarity of an organisation, and of two spellings of a person.
LEAST_ORG, LEAST_PERSON = 0.8, 0.6
#: Members of a person are paired in blocks of about this many.
PAIR_BLOCK = 500
#: Short forms of given names (fixed values: short form, name).
SHORT_FORMS = """
abdul abdurrahman, alex alexander, sasha alexander, andy andrew, ben benjamin, bella isabella, beppe giuseppe, beth elizabeth, betty elizabeth, bill william,
bob robert, charlie charles, chris christine, dan daniel, danny daniel, dave david, deb deborah, debbie deborah, dick richard, dima dmitri, ed edward, eddie edward,
fred frederik, greg gregory, hans johannes, harry harald, jim james, joe joseph, jon jonathan, kate katherine, kathy katherine, katya ekaterina, kolya nikolai,
leo leonardo, lisa elizabeth, liz elizabeth, lotte charlotte, maggie margaret, matt matthew, memo guillermo, meg margaret, mike michael, misha mikhail, nacho ignacio,
nick nicholas, olu olumide, olya olga, paco francisco, pat patricia, peggy margaret, pepe jose, phil philippe, rich richard, rick richard, rob robert, becky rebecca,
sam samuel, stefi stefania, steve stephen, sue susan, susi susanne, ted edward, tom thomas, tommy thomas, tony anthony, trish patricia, uschi ursula, valya valentina,
vicky victoria, volodya vladimir, will william, willi wilhelm, xavi xavier, zhenya yevgenia
"""
#: Short and foreign forms of the kinds of organisations (fixed values: pattern, word).
KINDS = (
    (r"\bu of\b", "university of"), (r"\buniv(?:ersitat|ersite|ersidad|ersita|ersidade)?\b", "university"), (r"\binst\b", "institute"),
    (r"\btech(?:nol)?\b", "technology"), (r"\bgen\b", "general"), (r"\bhosp\b", "hospital"), (r"\bacad\b", "academy"), (r"\bsci\b", "sciences"),
    (r"\bgeol\b", "geological"), (r"\bsurv\b", "survey"), (r"\b(?:polytech|politecnico|polytechnique)\b", "polytechnic"), (r"\bcoll\b", "college"), (r"\bmed\b", "medical"),
)
#: Words of organisations' names that tell nothing (fixed values).
FUNCTION_WORDS = "of the for and in at de di da do del dei der des du la le el et und von van y e".split()
#: Written in capitals without a full stop these may be initials.
TITLES = r"^\s*(?:(?:[Dd]r|[Pp]rof|[Mm]rs?|[Mm]s|DR(?=\.)|PROF|MRS?(?=\.)|MS(?=\.))\.?\s+)+"
SUFFIXES = r"[,\s]+(?:[Pp][Hh]\.?\s?[Dd]|M\.?D|M\.?[Ss]c|[Jj]r|[Ss]r)\.?\s*$"


def fold(c: Column) -> Column:
    """Latin letters without their marks; a rule of the character database, applied in the JVM."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)[0]
        base = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ħ": "h"}.get(ch, base)
        if base != ch and base.isascii():
            source.append(ch)
            target.append(base)
    marks = "".join(map(chr, range(0x300, 0x370)))
    plain = F.translate(c, "".join(source) + marks, "".join(target))
    return F.replace(F.replace(plain, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))


def _grams(token: Column) -> Column:
    """q-grams of a token; a token of up to three letters is its own, as no slip is allowed in it. Four letters of which
    two are exchanged may have no q-gram in common, so a token of four has its sorted letters besides: PREFIX in all."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    cut_up = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (Q - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(Q))))
    four = F.concat(cut_up, F.array(F.concat(F.lit("~"), F.array_join(_letters(token), ""))))
    return F.when(F.length(token) == 4, four).when(F.length(token) > 3, cut_up).otherwise(F.array(F.concat(F.lit("="), token)))


def _letters(token: Column) -> Column:
    return F.sort_array(F.split(token, ""))


def slip(a: Column, b: Column) -> Column:
    """Exactly one typing slip apart: one letter more, less or another, or two neighbours exchanged; both longer than three letters."""
    edits = F.levenshtein(a, b, 2)
    swapped = (edits == 2) & (F.length(a) == F.length(b)) & (_letters(a) == _letters(b))
    return (F.least(F.length(a), F.length(b)) > 3) & ((edits == 1) | swapped)


def nearness(a: Column, b: Column) -> Column:
    """1 for equal tokens, 1 - 1 / length for a slip, else 0."""
    return F.when(a == b, 1.0).when(slip(a, b), 1 - 1 / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def prefixes(tokens: DataFrame, order: DataFrame) -> DataFrame:
    """(`t`, `p`) of distinct tokens `t`: the PREFIX rarest q-grams by the counts `order` (g, df); q-grams it lacks come first."""
    spread = tokens.select("t", F.explode(_grams(F.col("t"))).alias("g")).join(small(order), "g", "left")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))), 1, PREFIX)  # bounded by the length of a token
    return spread.groupBy("t").agg(rarest["g"].alias("p"))


def gram_counts(tokens: DataFrame) -> DataFrame:
    """In how many of the distinct tokens `t` each q-gram occurs."""
    return cut(tokens.select(F.explode(_grams(F.col("t"))).alias("g")).groupBy("g").agg(F.count("*").alias("df")))


def similar_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(`a`, `b`): tokens of left (`t`) and of right (`t`), equal or one slip apart, by the prefix-filtered join on q-grams."""
    a, b = cut(left.select("t").distinct()), cut(right.select("t").distinct())
    order = gram_counts(b)  # rarest first in the vocabulary that is searched
    posted = lambda df, name: prefixes(df, order).select(F.col("t").alias(name), F.explode("p").alias("g"))
    # a q-gram's list holds the distinct tokens that have it among their rarest, so lists follow the vocabulary, not the rows
    near = F.abs(F.length("a") - F.length("b")) < 2
    return posted(a, "a").join(small(cut(posted(b, "b"))), "g").where(near & (nearness(F.col("a"), F.col("b")) > 0)).select("a", "b").distinct()


# ---- organisations ---------------------------------------------------------


def _words(c: Column) -> Column:
    """Tokens of an organisation's name, kinds in one form, what stands in brackets left out."""
    text = F.regexp_replace(F.lower(fold(c)), r"\([^()]*\)|&\w+;", " ")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    for pattern, word in KINDS:
        text = F.regexp_replace(text, pattern, word)
    return F.filter(F.array_distinct(F.split(text, " ")), lambda t: (t != "") & ~t.isin(*FUNCTION_WORDS))


def link_organisations(values: DataFrame, value: str, orgs: DataFrame, org_key: str, org_name: str) -> DataFrame:
    """(`value`, `org`, `score`): the registered organisations that each distinct text names best; of equal ones all."""
    registry = cut(orgs.select(F.col(org_key).alias("org"), _words(F.col(org_name)).alias("tokens")).where(F.size("tokens") > 0))
    n = registry.count()
    spread = registry.select("org", F.explode("tokens").alias("t"))
    weights = spread.groupBy("t").agg(F.log(1 + F.lit(n) / F.count("*")).alias("w"))
    # every registered name by its rarest token, with all its tokens and their weights
    names = spread.join(weights, "t").groupBy("org").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "t"))).alias("x"))
    names = cut(names.select("org", F.element_at("x.t", 1).alias("b"), F.transform("x", lambda x: F.struct(x["t"].alias("t"), (-x["w"]).alias("w"))).alias("x")))
    texts = cut(values.select(F.col(value).alias("value")).where(F.trim("value") != "").distinct().select("value", _words(F.col("value")).alias("tokens")))
    words = texts.select(F.explode("tokens").alias("t"))
    alike = cut(similar_tokens(words, names.select(F.col("b").alias("t"))))
    # vocabulary and registry are broadcast if they are small, so that the texts stay where they are
    met = texts.select("value", "tokens", F.explode("tokens").alias("a")).join(small(alike), "a").join(small(names), "b")
    found = F.transform("x", lambda x: F.struct(x["w"].alias("w"), F.array_max(F.transform("tokens", lambda t: nearness(x["t"], t))).alias("s")))
    total = lambda c, part: F.aggregate(c, F.lit(0.0), lambda s, x: s + part(x))
    scored = met.select("value", "org", found.alias("f")).where(F.forall("f", lambda f: f["s"] > 0))
    scored = scored.select("value", "org", (total("f", lambda f: f["w"] * f["s"]) / total("f", lambda f: f["w"])).alias("score")).where(F.col("score") >= LEAST_ORG)
    # a text has as many candidates as organisations share the rare tokens it names
    best = scored.groupBy("value").agg(F.collect_set(F.struct("score", "org")).alias("c")).withColumn("top", F.array_max("c.score"))
    return best.select("value", "top", F.explode("c").alias("c")).where("c.score = top").select("value", "c.org", "c.score")


# ---- persons ---------------------------------------------------------------


def name_parts(name: Column) -> tuple[Column, Column]:
    """Full tokens and initials of a name, each sorted and distinct: case, marks, titles, suffixes and the order of parts left out, short forms written out."""
    short = F.create_map(*[F.lit(x) for pair in SHORT_FORMS.replace("\n", " ").strip().split(",") for x in pair.split()])
    raw = F.regexp_replace(F.regexp_replace(fold(name), TITLES, ""), SUFFIXES, "")
    tokens = F.filter(F.split(raw, r"[^\p{L}\-]+"), lambda t: F.length(F.replace(t, F.lit("-"), F.lit(""))) > 0)
    mixed = raw != F.upper(raw)
    initial = lambda t: (F.length(t) == 1) | ((F.length(t) < 4) & (t == F.upper(t)) & mixed)
    full = F.transform(F.filter(tokens, lambda t: ~initial(t)), lambda t: F.coalesce(short[F.lower(t)], F.lower(t)))
    letters = F.filter(F.split(F.lower(F.array_join(F.filter(tokens, initial), "")), ""), lambda t: t.rlike(r"\p{L}"))
    return F.array_sort(F.array_distinct(full)), F.array_sort(F.array_distinct(letters))


def postings(nodes: DataFrame, place: Column) -> DataFrame:
    """(`key`, `node`): every name under the hash of its place, the q-grams of a full token and the first letter of another one."""
    other = lambda t: F.when(F.size("full") > 1, F.transform(F.filter("full", lambda x: x != t), lambda x: F.substring(x, 1, 1))).when(F.size("ini") > 0, F.col("ini")).otherwise(F.array(F.lit("")))
    keys = F.transform("posted", lambda p: F.flatten(F.transform(other(p["t"]), lambda letter: F.transform(p["p"], lambda g: F.xxhash64(place, letter, g)))))
    return nodes.select(F.explode(F.array_distinct(F.flatten(keys))).alias("key"), F.struct("place", "sid", "full", "ini", "w").alias("node"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def similarity(x: Column, y: Column) -> Column:
    """Soft weighted token similarity of two name structs (full, ini, w: the weights of both in order), and which tokens met their initials (`score`,
    `given`); NULL where the names cannot be one person.

    At most one token differs by a slip; a token without partner must have its initial on the other side; initials may
    be left over on one side only; two tokens at least must have partners. Of two spellings of a token the commoner one
    tells how rare it is.
    """
    weight = lambda side, t: F.get(side["w"], (F.array_position(F.concat(side["full"], side["ini"]), t) - 1).cast("int")).cast("double")
    mass = lambda c, side: F.aggregate(c, F.lit(0.0), lambda a, t: a + F.coalesce(weight(side, t), F.lit(0.0)))

    def oriented(p: Column) -> Column:
        longer, shorter = p["l"], p["s"]
        rests = F.struct(F.array_except(longer["full"], shorter["full"]).alias("l"), F.array_except(shorter["full"], longer["full"]).alias("s"))

        def partners(r: Column) -> Column:
            odd = F.get(r["s"], F.lit(0))
            slipped = F.struct(F.get(F.filter(r["l"], lambda t: slip(t, odd)), F.lit(0)).alias("t"))
            return F.when((F.size(r["s"]) < 2) & (F.size(r["l"]) - F.size(r["s"]) <= F.size(shorter["ini"])), _let(slipped, lambda m: initials(r, odd, m["t"])))

        def initials(r: Column, odd: Column, m: Column) -> Column:
            given = F.filter(r["l"], lambda t: ~t.eqNullSafe(m))
            short = F.struct(given.alias("g"), F.transform(given, lambda t: F.substring(t, 1, 1)).alias("h"))
            left = lambda h: F.struct(h["g"].alias("given"), h["h"].alias("short"), F.array_except(shorter["ini"], h["h"]).alias("i"))
            return F.when((F.size(r["s"]) == 0) | m.isNotNull(), _let(short, lambda h: F.when(F.size(F.array_except(h["h"], shorter["ini"])) == 0, _let(left(h), lambda q: judged(q, odd, m)))))

        def judged(q: Column, odd: Column, m: Column) -> Column:
            only_l, only_s = F.array_except(longer["ini"], q["i"]), F.array_except(q["i"], longer["ini"])
            equal, both = F.array_intersect(longer["full"], shorter["full"]), F.array_intersect(longer["ini"], q["i"])
            sure = mass(F.concat(equal, q["short"], both), shorter)
            rarity = F.when(m.isNull(), 0.0).otherwise(F.least(weight(longer, m), weight(shorter, odd)))
            like = F.when(m.isNull(), 0.0).otherwise(1 - 1 / F.greatest(F.length(m), F.length(odd)))
            over = mass(only_l, longer) + mass(only_s, shorter)
            several = F.size(equal) + F.size(q["short"]) + F.size(both) + F.when(m.isNull(), 0).otherwise(1) > 1
            score = F.struct(((sure + rarity * like) / (sure + rarity + over)).alias("score"), F.concat_ws(" ", q["given"]).alias("given"))
            return F.when(several & ((F.size(only_l) == 0) | (F.size(only_s) == 0)), score)

        return _let(rests, partners)

    turned = F.when(F.size(y["full"]) > F.size(x["full"]), F.struct(y.alias("l"), x.alias("s"))).otherwise(F.struct(x.alias("l"), y.alias("s")))
    return _let(turned, oriented)


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs of name structs `x`, `y` that are spellings of one person, with `v`: their `score` and `given`."""
    return pairs.select("x", "y", F.explode(F.filter(F.array(similarity(F.col("x"), F.col("y"))), lambda v: v["score"] >= LEAST_PERSON)).alias("v"))


def links_within(posted: DataFrame) -> DataFrame:
    """(`place`, `a`, `b`, `score`, `given`, `fa`, `fb`): linked names of a place, and whether each is a full spelling. Posted must be held."""
    met = posted.select("key", F.col("node").alias("x")).join(posted.select("key", F.col("node").alias("y")), "key").where("x.sid < y.sid AND x.place = y.place").select("x", "y")
    whole = lambda n: (F.size(f"{n}.full") > 1)
    found = verified(met).select(F.col("x.place").alias("place"), F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.round("v.score", 6).alias("score"), "v.given", whole("x").alias("fa"), whole("y").alias("fb"))
    return cut(found.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(`place`, `sid`, `root`) of all ends of edges (`place`, `a`, `b`): the least number that links connect with each.

    Every node takes the least root among its neighbours' and then the root of that root, so the rounds follow the
    logarithm of the longest chain of spellings.
    """
    one = edges.select("place", "a", "b")
    both = cut(one.unionByName(one.select("place", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy("place", F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(now.select("place", F.col("sid").alias("b"), "root"), ["place", "b"]).select("place", F.col("a").alias("sid"), "root").unionByName(now)
        best = cut(seen.groupBy("place", "sid").agg(F.min("root").alias("root"), F.max(F.struct("root")).alias("most")))
        on = best.select("place", F.col("sid").alias("root"), F.col("root").alias("further"))
        after = cut(best.join(on, ["place", "root"], "left").select("place", "sid", F.least("root", "further").alias("root"), (F.col("most.root") != F.coalesce("further", "root")).alias("open")))
        now = after.select("place", "sid", "root")
        if not after.where("open").limit(1).count():
            return now


def people(entries: DataFrame) -> DataFrame:
    """Membership (`person`, `key`) of entries: key, name, places (list of organisations, empty if none is known)."""
    full, ini = name_parts(F.col("name"))
    named = entries.select("key", full.alias("full"), ini.alias("ini"), F.when(F.size("places") > 0, F.col("places")).otherwise(F.array(F.lit(""))).alias("places")).where(F.size("full") > 0)
    spelt = F.concat_ws("|", F.concat_ws(" ", "full"), F.concat_ws(" ", "ini"))
    member = cut(named.select("key", spelt.alias("spelt"), "full", "ini", F.explode("places").alias("place")))
    # distinct spellings of a place; their number follows spelling, not the number of records
    spellings = cut(member.groupBy("place", "spelt").agg(F.min("key").alias("sid"), F.first("full").alias("full"), F.first("ini").alias("ini")))
    final = _persons(_weighted(spellings))
    placed = cut(member.select("key", "place", "spelt").join(final.select("place", "spelt", "root", F.concat_ws(" ", "full").alias("f"), (F.size("full") > 1).alias("whole")), ["place", "spelt"]))
    at = placed.where("place <> '' AND root IS NOT NULL").select(F.concat_ws("|", "place", "root").alias("person"), "key")
    return at.unionByName(_without_place(final.where("place = ''"), final.where("place <> '' AND size(full) > 1"), placed)).distinct()


def _persons(nodes: DataFrame) -> DataFrame:
    """Names of places with `root`, the person's least number; NULL for an abbreviation that fits several people equally
    well. Names without a place come through with themselves as root."""
    links = links_within(cut(postings(nodes.where("place <> ''"), F.col("place"))))
    return cut(rooted(nodes, links))


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Names with their `root`. Links of full spellings, and of abbreviations that meet one given name only, connect; an
    abbreviation that meets several belongs to its most similar full spellings, if they are one person."""
    up = links.where("fa <> fb").select("place", F.when(F.col("fa"), F.col("b")).otherwise(F.col("a")).alias("sid"), F.when(F.col("fa"), F.col("a")).otherwise(F.col("b")).alias("of"), "score", "given")
    several = cut(up.groupBy("place", "sid").agg(F.count_distinct("given").alias("k")).where("k > 1").select("place", "sid"))
    end = lambda c: several.withColumnRenamed("sid", c)
    firm = links.join(end("a"), ["place", "a"], "left_anti").join(end("b"), ["place", "b"], "left_anti")
    of = cut(nodes.join(components(firm), ["place", "sid"], "left").withColumn("root", F.coalesce("root", "sid")))
    reached = up.join(several, ["place", "sid"]).join(of.select("place", F.col("sid").alias("of"), F.col("root").alias("r")), ["place", "of"])
    per = reached.groupBy("place", "sid").agg(F.max(F.struct("score", "r")).alias("hi"), F.max(F.struct("score", (-F.col("r")).alias("r"))).alias("lo"))
    per = per.select("place", "sid", F.when(F.col("hi.r") == -F.col("lo.r"), F.col("hi.r")).alias("person_of"), F.lit(True).alias("short"))
    return of.join(per, ["place", "sid"], "left").withColumn("root", F.when(F.col("short"), F.col("person_of")).otherwise(F.col("root"))).drop("short", "person_of")


def _weighted(spellings: DataFrame) -> DataFrame:
    """Spellings with `w`, the weights of their tokens, and `posted`, their full tokens with the rarest q-grams of each."""
    n = spellings.count()
    spread = spellings.select("place", "sid", F.explode(F.concat("full", "ini")).alias("t"))
    rarity = F.when(F.length("t") > 1, F.log(1 + F.lit(n) / F.count("*"))).otherwise(F.log(F.lit(2.0)))  # an initial tells as little as a token all names have
    vocabulary = cut(spread.groupBy("t").agg(rarity.alias("w")))
    tokens = cut(vocabulary.join(prefixes(vocabulary, gram_counts(vocabulary)), "t"))
    made = spread.join(small(tokens), "t").groupBy("place", "sid").agg(F.map_from_entries(F.collect_set(F.struct("t", "w"))).alias("w"), F.collect_set(F.struct("t", "p")).alias("posted"))
    joined = spellings.join(made, ["place", "sid"]).withColumn("w", F.transform(F.concat("full", "ini"), lambda t: F.col("w")[t].cast("float")))
    return cut(joined.withColumn("posted", F.filter("posted", lambda p: F.array_contains("full", p["t"]))))


def _without_place(lone: DataFrame, known: DataFrame, placed: DataFrame) -> DataFrame:
    """Members among the entries without an organisation. Of an entry's name everything known with it is looked up first
    as it is spelt, then a slip away; it is one person if one organisation holds all entries so named."""
    joined = F.concat_ws(" ", "full")
    whole = placed.where("place <> '' AND whole AND root IS NOT NULL")
    sizes = placed.where("place <> '' AND root IS NOT NULL").groupBy("place", "root").agg(F.count("*").alias("members"))
    per = whole.groupBy("f", "place", "root").agg(F.count_distinct("key").alias("n")).join(sizes, ["place", "root"])
    per = per.groupBy("f").agg(F.max_by(F.concat_ws("|", "place", "root"), F.struct("n", "members", "root")).alias("person"), F.max("n").alias("n"))
    every = whole.groupBy("f").agg(F.count_distinct("key").alias("all"))
    one = cut(per.join(every, "f").select("f", F.when(F.col("n") == F.col("all"), F.col("person")).alias("person")))
    mine = cut(lone.select("sid", "spelt", "place", "full", "ini", "w", "posted", "root", joined.alias("f"), (F.size("full") > 1).alias("whole")))
    # full names as they are spelt
    exact = mine.where("whole").join(one.withColumn("known", F.lit(True)), "f", "left").select("sid", "person", F.coalesce("known", F.lit(False)).alias("known"))
    # abbreviations: a full token and the first letter of another one, among full names with an organisation
    pair = lambda t, letter: F.concat_ws("|", t, letter)
    forms = one.select("person", F.split("f", " ").alias("full")).select("person", F.explode("full").alias("t"), "full")
    forms = forms.select("person", F.explode(F.transform(F.filter("full", lambda x: x != F.col("t")), lambda x: pair(F.col("t"), F.substring(x, 1, 1)))).alias("k"))
    letter = forms.groupBy("k").agg(F.count_distinct("person").alias("persons"), F.count_if(F.col("person").isNull()).alias("open"), F.min("person").alias("person"))
    short = mine.where("NOT whole AND size(ini) > 0").select("sid", F.explode("ini").alias("i"), F.get("full", F.lit(0)).alias("t")).select("sid", pair(F.col("t"), F.col("i")).alias("k"))
    fits = short.join(letter, "k").groupBy("sid").agg(F.max("persons").alias("persons"), F.sum("open").alias("open"), F.min("person").alias("person"), F.count_distinct("person").alias("d"))
    fits = fits.select("sid", F.when((F.col("persons") == 1) & (F.col("open") == 0) & (F.col("d") == 1), F.col("person")).alias("person"), F.lit(True).alias("known"))
    seen = cut(exact.where("known").unionByName(fits))
    # names of which nothing is known as they are spelt: what is known a slip away
    odd = cut(mine.join(seen.select("sid"), "sid", "left_anti").drop("f", "whole", "root"))
    strange = cut(postings(odd, F.lit("")))
    far = postings(known, F.lit("")).select("key", F.col("node").alias("y")).join(small(strange.select("key", F.col("node").alias("x"))), "key").select("x", "y")
    near = verified(far).select(F.col("x.sid").alias("sid"), F.concat_ws(" ", "y.full").alias("f")).distinct().join(one, "f")
    meant = near.groupBy("sid").agg(F.count_distinct("person").alias("persons"), F.count_if(F.col("person").isNull()).alias("open"), F.min("person").alias("person"))
    found = seen.select("sid", "person").unionByName(meant.select("sid", F.when((F.col("persons") == 1) & (F.col("open") == 0), F.col("person")).alias("person")))
    # what is left is known from such entries only: they are linked among themselves
    among = rooted(odd, links_within(strange)).select("spelt", "sid", "root")
    own = among.join(found.select("sid"), "sid", "left_anti").where("root IS NOT NULL").select("spelt", F.concat_ws("|", F.lit(""), "root").alias("person"))
    own = own.unionByName(mine.join(found.where("person IS NOT NULL"), "sid").select("spelt", "person"))
    return placed.where("place = ''").select("key", "spelt").join(own, "spelt").select("person", "key")


# ---- tables ----------------------------------------------------------------


def entry_organisations(cells: DataFrame, orgs: DataFrame) -> DataFrame:
    """(`text`, `org`) of the distinct affiliation texts; each value of a packed entry is judged by itself."""
    distinct = cells.select("text").where(F.trim("text") != "").distinct()
    values = cut(split_packed(distinct, "text", ["text"]))
    links = link_organisations(values, "val", orgs, "org_id", "org_name").select(F.col("value").alias("val"), "org")
    return values.join(links, "val").select("text", "org").distinct()


def linked(gold: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships of people (`person`, `key`), and organisations of affiliation entries (`key`, `aff_pos`, `org`).

    An author's key is rec_no * 100 + position.
    """
    authors = gold.select("rec_no", F.posexplode("authors").alias("pos", "a")).select((F.col("rec_no") * 100 + F.col("pos")).alias("key"), F.col("a.name").alias("name"), F.col("a.affiliations").alias("affiliations"))
    cells = authors.select("key", "name", F.posexplode_outer("affiliations").alias("aff_pos", "text"))
    of_text = entry_organisations(cells, orgs)
    places = cut(cells.join(of_text, "text", "left").select("key", "name", "aff_pos", "org"))
    entries = places.groupBy("key", "name").agg(F.collect_set(F.col("org").cast("string")).alias("places"))  # of one entry
    return cut(people(entries)), places.where("org IS NOT NULL").select("key", "aff_pos", "org").distinct()


def person_pairs(members: DataFrame) -> DataFrame:
    """(`id_a`, `id_b`): all pairs of a person's keys, smaller first. A person with many entries is spread over pairs of blocks."""
    sizes = members.groupBy("person").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "person").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = rows.select("person", F.col("key").alias("id_a"), F.col("block").alias("one"), every).withColumnRenamed("other", "two")
    right = rows.select("person", F.col("key").alias("id_b"), F.col("block").alias("two"), every).withColumnRenamed("other", "one")
    return left.join(right, ["person", "one", "two"]).where("id_a < id_b").select("id_a", "id_b").distinct()
