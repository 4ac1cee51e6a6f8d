"""Counts and models cover all rows."""

import random

import numpy as np

from sievewright.llm import garbled, languages, truncated


def test_letters_are_counted_over_all_documents(spark):
    """A pair of letters that stands in few of many documents is counted, exactly, and where the texts are does not matter."""
    rng = random.Random(1)
    docs = [("aa", " ".join(rng.choices(["mola", "tari", "sone"], k=12))) for _ in range(3000)]
    docs += [("aa", "ünderwön " * 8 + str(k)) for k in range(3)]
    df = spark.createDataFrame(docs, "lang string, text string")
    one, many = (garbled.counted(x, "text", "lang") for x in (df.repartition(1), df.repartition(7)))
    assert one.chance == many.chance and "wö" in one.chance
    exact = garbled.Model(docs)
    assert set(one.frequent) == set(exact.frequent)
    by = garbled._per_language([("aa", "Ab ba. 漢ab a")])["aa"]
    assert by == {"^a": 3, "ab": 2, "^b": 1, "ba": 1, "漢": 1}


def test_truncation_learns_from_all_texts(spark, monkeypatch):
    """More texts than a sample held: each one gives its examples, wherever it stands."""
    texts = [f"The survey of the {k % 97} wells was repeated in the valley after {k} days of rain." for k in range(13_000)]
    wanted = sum(len(truncated.examples(t)[1]) for t in texts)
    seen, solve = [], truncated.solve
    monkeypatch.setattr(truncated, "solve", lambda f, a, b: seen.append(sum(a) + sum(b)) or solve(f, a, b))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one, many = (truncated.fitted(df.repartition(n), "t").weights for n in (1, 5))
    assert seen == [wanted, wanted] and (one == many).all() and one.any()


def test_the_network_is_trained_on_all_documents(spark, monkeypatch):
    """A document beyond those that training begins with changes the network; where the documents are does not."""
    monkeypatch.setattr(languages, "STEPS", 8)
    monkeypatch.setattr(languages, "SHARD", 3000)
    begun = languages.Network(["aa", "bb"])
    monkeypatch.setattr(languages, "fit", lambda samples: languages.Network(["aa", "bb"]))
    docs = [(k, f"{w} {i} " * 20) for i in range(30) for k, w in (("aa", "mola tari"), ("bb", "küçük"))]
    df = spark.createDataFrame(docs, "lang string, text string")
    one, many, fewer = (languages.fit_all(x, "text", "lang").p for x in (df.repartition(1), df.repartition(5), df.where("text not like 'mola tari 29%'")))
    assert all(np.array_equal(one[k], many[k]) for k in one)
    assert any((one[k] != begun.p[k]).any() for k in one) and any((one[k] != fewer[k]).any() for k in one)
    assert languages.go_over(languages.Network(["aa", "bb"]), docs, 0) == sum(-(-len(languages._bytes(t)) // 240) for _, t in docs)


def test_texts_are_read_once_and_few_at_a_time(monkeypatch):
    """Copies of a text cost nothing, the scores of few texts are held at once, and the answers are those of each text by itself."""
    net, seen = languages.Network(["aa", "bb"]), []
    scores = languages.position_scores
    monkeypatch.setattr(languages, "position_scores", lambda n, texts: seen.append(list(texts)) or scores(n, texts))
    monkeypatch.setattr(languages, "TEXTS", 7, raising=False)
    texts = [f"Mola {k} tari sone. {'Küçük ev. ' * (k % 5)}" for k in range(20)]
    got = languages.segments(net, texts * 3 + [""])
    assert sorted(t for some in seen for t in some) == sorted([*texts, ""]) and max(map(len, seen)) <= 7
    alone = [languages.segments(net, [t])[0] for t in texts]
    assert [[s[:3] for s in row] for row in got] == [[s[:3] for s in row] for row in alone * 3 + [[]]]


def test_gradients_of_texts_of_several_lengths():
    """Every position counts as if its text stood alone: nothing comes from beyond its end."""
    net, rng = languages.Network(["aa", "bb"], 5), np.random.default_rng(6)
    lengths = np.array([1, 4, 9, 9])
    x, y = rng.integers(0, 256, (9, 4, languages.STRIDE)).astype(np.uint8), rng.integers(0, 2, (9, 4))
    mask = np.arange(9)[:, None] < lengths
    _, grad = net.gradients(x, mask, y)
    alone = [net.gradients(x[:n, k : k + 1], mask[:n, k : k + 1], y[:n, k : k + 1])[1] for k, n in enumerate(lengths)]
    for name in net.p:
        assert np.allclose(grad[name], sum(a[name] * (n / lengths.sum()) for a, n in zip(alone, lengths, strict=True)), atol=1e-5), name


def test_words_without_a_match_are_not_weighed(monkeypatch):
    """Where no word that holds a garbled pair gains, the others are not read again with each pair of encodings."""
    model = garbled.Model([("aa", "küçük möla tärı söne " * 40)])
    weighed, cost = [], garbled.Model.cost
    monkeypatch.setattr(garbled.Model, "cost", lambda self, t: weighed.append(t) or cost(self, t))
    text = "söne ışığı küçük möla tärı çöl " * 20
    assert model._read(text, [], "cp1252", "cp1251", [(m.start(), m.end()) for m in garbled._WORD.finditer(text)]) is None and not weighed


def test_copies_are_weighed_once_and_counted_each(monkeypatch):
    """The examples of a text and the look for labels in it are made once for its copies, which all count."""
    text = "The survey of the wells was repeated in the valley after many days of rain and the yield"
    calls, label = [], truncated._LABEL

    class Label:
        def finditer(self, t):
            calls.append(t)
            return label.finditer(t)

    monkeypatch.setattr(truncated, "_LABEL", Label())
    assert truncated.trailer(text) == (len(text), "") and not calls  # no label is without a sign that this text lacks
    whole = f"{text} rose. Keywords: soil; wells"
    first = truncated.examples(whole)
    assert first[1] and truncated.examples(whole) == first and calls.count(whole) == 1
    for tail, kind in ((" (C) City", "right"), ("\n", ""), (" The study. City Press\n", "imprint"), (" (continued)", "")):
        assert truncated.trailer(text + tail)[1] == kind and truncated._marked(text + tail) == (truncated._MARKED.search(text + tail) is not None)
