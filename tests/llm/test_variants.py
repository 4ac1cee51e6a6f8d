import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import variants

AUTHOR = "array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>"


def one_slip(a, b):
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4 or a == b:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def test_similar_tokens_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80)]
    words = set(base)
    for w in base:
        i = rng.randrange(len(w) - 1)
        words.add(rng.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :]]))
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {(r.a, r.b) for r in variants.similar_tokens(df, df).collect()}
    want = {(a, b) for a in words for b in words if a == b or one_slip(a, b)}
    assert want <= got and {(w, w) for w in words} <= got


@pytest.mark.parametrize(("a", "b", "same"), [
    ("Nikolai Ekenouxt", "EKENOUXT, Kolya", True), ("Ekenouxt Nikolai", "N. Ekenouxt", True), ("Nikolai Ekenouxt", "Nikolai P. Ekenuoxt", True),
    ("Nikolai Ekenouxt", "Patricia Ekenouxt", False), ("P. Ekenouxt", "N. Ekenouxt", False), ("J. Jansen", "Peter Jansen", False), ("Li Wu", "Wu Li", True),
    ("Mei-Ling R. Milardierl", "MR Milardierl", True), ("Johannes Tameraro", "Tameraro JR", True), ("Dr. Kwame Gavin, PhD", "Gavin K", True), ("Anna Ek Sund", "Sund, Anna E.", True),
])
def test_similarity(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    node = lambda c: F.struct(*[x.alias(n) for x, n in zip(variants.name_parts(F.col(c)), ("full", "ini"), strict=True)], F.transform(F.concat(*variants.name_parts(F.col(c))), lambda t: F.when(F.length(t) > 1, 5.0).otherwise(2.0)).alias("w"))
    pairs = df.select(node("a").alias("x"), node("b").alias("y"))
    equal = df.select(F.array_join(F.concat(*variants.name_parts(F.col("a"))), " ") == F.array_join(F.concat(*variants.name_parts(F.col("b"))), " ")).first()[0]
    assert (equal or variants.verified(pairs).count() == 1) == same


def groups(spark, rows):
    out = {}
    for r in variants.people(spark.createDataFrame(rows, "key long, name string, places array<string>")).collect():
        out.setdefault(r.person, set()).add(r.key)
    return {frozenset(v) for v in out.values()}


def test_spellings_that_links_connect(spark):
    rows = [(k, f"anna {s}", ["1"]) for k, s in enumerate(["ulanierl", "ulanieerl", "ulnierl", "berkhout", "berkhoud", "berkhood", "berkhood", "other"], 1)]
    assert groups(spark, rows) == {frozenset({1, 2, 3}), frozenset({4, 5, 6, 7}), frozenset({8})}


def test_abbreviations(spark):
    rows = [(1, "Ben Smith", ["1"]), (2, "Barbara Smith", ["1"]), (3, "B. Smith", ["1"]), (4, "B. Q. Smith", ["1"]), (5, "Ben Q. Smith", ["1"]), (6, "K. Smith", ["1"]), (7, "Smith, K", ["1"]), (8, "K. Smith", ["2"]), (9, None, ["1"]), (10, " ", ["1"])]
    assert groups(spark, rows) == {frozenset({1, 4, 5}), frozenset({2}), frozenset({6, 7}), frozenset({8})}  # 3 fits two people
    # two slips of one surname that an abbreviation connects
    assert groups(spark, [(1, "Björn Jansnakh", ["1"]), (2, "Jaanakh, Björn", ["1"]), (3, "Jananakh B", ["1"])]) == {frozenset({1, 2, 3})}


def test_without_an_organisation(spark):
    rows = [(1, "Anna Berkhout", ["1"]), (2, "Anna Berkhuot", []), (3, "Annna Berkhout", []), (4, "A. Berkhot", []), (5, "Peter Berkhout", []), (6, "Anna Strange", []), (7, "Maria Berkout", []), (8, "Strange, Anna", []), (9, "Eva Twice", ["1"]), (10, "Eva Twice", ["2"]), (11, "Eva Twice", [])]
    assert groups(spark, rows) == {frozenset(x) for x in ({1, 2, 3, 4}, {5}, {6, 8}, {7}, {9}, {10})}


def linked(spark, gold, orgs):
    return variants.linked(spark.createDataFrame(gold, f"rec_no long, authors {AUTHOR}").withColumn("org", F.lit(1)), spark.createDataFrame(orgs, "org_id long, org_name string"))


def test_people_and_organisations(spark):
    rows = [
        (1, [("Nikolai Ekenouxt", ["University of Farville, 10061 Farville"], None), ("Patricia Ekenouxt", ["Univ. Farville"], None)]),
        (2, [("EKENOUXT, Kolya", ["Dept. of Law, Université de Favrille; Oldham Gen. Hosp., Spain"], None), (None, None, None), ("", [""], None)]),
        (3, [("N. Ekenouxt", ["Farville University"], None), ("Nikolai Ekenouxt", ["Oldham General Hospital"], None)]),
        (4, None),
    ]
    orgs = [(1, "University of Farville"), (2, "Farville Polytechnic"), (3, "Oldham General Hospital"), (4, None)] + [(i, f"Town{chr(97 + i % 26)}{chr(97 + i // 26)}ville University") for i in range(10, 200)]
    members, places = linked(spark, rows, orgs)
    assert {(100, 0, 1), (101, 0, 1), (200, 0, 1), (200, 0, 3), (300, 0, 1), (301, 0, 3)} == {(r.key, r.aff_pos, r.org) for r in places.collect()}
    found = {}
    for r in members.collect():
        found.setdefault(r.person, set()).add(r.key)
    assert {100, 200, 300} in found.values() and {101} in found.values()
    for gold, registry in (([], orgs), (rows, [])):
        members, places = linked(spark, gold, registry)
        assert places.count() == 0


def test_short_places(spark):
    """Tokens of three letters and fewer match as they are, whatever the size of the registry."""
    for n in (3, 400):
        orgs = [(1, "University of Ulm"), (2, "University of Rio")] + [(i, f"University of Place{i}") for i in range(10, 10 + n)]
        _, places = linked(spark, [(1, [("Anna Ek", ["Ulm University"], None), ("Eva Ek", ["Univ. of Rio"], None), ("Ida Ek", ["Univ. of Rix"], None)])], orgs)
        assert {(r.key, r.org) for r in places.collect()} == {(100, 1), (101, 2)}


def test_pairs_of_a_person_with_many_entries(spark):
    rows = [("hot", i) for i in range(1300)] + [("cold", 5000), ("cold", 5001), ("one", 7000)]
    pairs = variants.person_pairs(spark.createDataFrame(rows, "person string, key long"))
    assert pairs.count() == 1300 * 1299 // 2 + 1
