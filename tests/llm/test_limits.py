"""Cases beyond limits that an operator might be tempted to set."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import languages, leak, packing, sentences, truncated, unify


@pytest.mark.parametrize(("text", "kind"), [
    ("It ends here. Keywords: " + "; ".join(f"keyword number {i}" for i in range(60)), "list"), ("It ends here. doi:10.1000/182", "ident"), ("It ends here. © 2019 The authors", "right"),
    ("It ends here.\nKey words: soil, S. aureus, wells", "list"), ("A study of wells, City Press, Vol. 6, No. 4", "imprint"), ("It ends here. City Press", "imprint"),
    ("The survey was led by the National Society", ""), ("We thank the editors of the Open Journals", ""), ("The manuscript was kept in the Vatican Archive", ""),
    ("Keywords: soil, wells. The survey was repeated in the valley and the yield of all of the wells ro", ""), ("see https://x.org/a for the data that was", ""),
])
def test_trailers(text, kind):
    assert truncated.trailer(text)[1] == kind


@pytest.mark.parametrize("heading", ["Materials and Methods for the Long Term Trial", "3.2 Statistical analysis of all of the repeated measures", "1. Introduction", "RESULTS", "Results"])
def test_headings_of_any_length(heading):
    text = f"The first part ends.\n\n{heading}\nWe measured the wells. They were deep."
    r, k, s, e = sentences.sentence_offsets(pa.array([text]))
    assert [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)] == ["The first part ends.", heading, "We measured the wells.", "They were deep."]


def test_a_broken_line_is_no_heading():
    text = "The first part ends.\n\nWe measured the depth of all of the wells near the town of\nOldham in the spring. They were deep."
    assert len(sentences.sentence_offsets(pa.array([text]))[0]) == 3


def test_short_sentences_and_mixed_texts():
    """A network fitted as in production: sentences of a few bytes have a language; stretches of unseen mixed texts too."""
    import duckdb

    rows = duckdb.sql("select lang, text from '/root/testdata/sf0.1/documents.parquet' where regexp_matches(lang, '^[a-z]{2}$') and length(text) > 40 order by doc_id").fetchall()
    by = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    net = languages.fit([(k, t) for k, v in by.items() for t in v[: languages.PER_LANGUAGE]])
    english = "The survey was repeated in the valley, and the yield of the wells rose by a third within two years."
    for short, lang in (("这是土壤。", "zh"), ("Это почва.", "ru"), ("이것은 흙이다.", "ko"), ("هذه تربة.", "ar")):
        assert lang in {s[2] for s in languages.segments(net, [f"{short} {english}"])[0] if s[4]}, lang
    rng, right, total = random.Random(2), 0, 0
    held = {k: v[languages.PER_LANGUAGE :] for k, v in by.items() if len(v) > languages.PER_LANGUAGE + 10}
    for _ in range(60):
        a, b = rng.sample(sorted(held), 2)
        first, second = rng.choice(held[a])[:600].rstrip() + ".", rng.choice(held[b])[:600]
        for start, end, lang, _, _ in languages.segments(net, [f"{first} {second}"])[0]:
            right += sum(lang == (a if i <= len(first) else b) for i in range(start, end))
            total += end - start
    assert right > 0.97 * total


@pytest.mark.parametrize("step", [6, 8, 10, 15])
def test_edited_copies_are_found(spark, step):
    """One word in `step` is another one: at least nine of ten copies are aligned with their item, and with no other."""
    rng = random.Random(step)
    vocab = [f"w{i}" for i in range(4000)]
    items = [rng.choices(vocab, k=rng.randint(30, 90)) for _ in range(40)]
    docs = [(k, " ".join(rng.choices(vocab, k=200) + [f"new{i}" if i % step == step // 2 else w for i, w in enumerate(item)] + rng.choices(vocab, k=200))) for k, item in enumerate(items)]
    found = leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"), "item_id", "text")
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(got & {(k, k) for k in range(40)}) >= 36 and not got - {(k, k) for k in range(40)}


def test_long_stretches_are_aligned_in_pieces():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, doc = rng.integers(0, 5, rng.integers(2, 9)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 400)).astype(np.uint64)
        whole = leak.align(item, doc)
        parts = [leak.align(item, doc[a:b]) for a, b in leak.pieces(0, len(doc), len(item))]
        assert max(p[0] for p in parts) == whole[0] and max(p[4] for p in parts) == whole[4]
        assert max(b - a for a, b in leak.pieces(0, len(doc), len(item))) <= leak.WIDE * len(item)


def test_capacity_is_chosen_when_a_container_opens():
    # 90 fits best with nothing beside it in 100; the small ones fill 64 exactly
    sizes = [90, 60, 60, 4, 4]
    box, capacity = packing.pack(np.array(sizes), [64, 100])
    assert sorted(capacity.tolist()) == [64, 64, 100]
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 500, 200))[::-1]
        _, mixed = packing.pack(sizes, [256, 512, 1024])
        for c in (512, 1024):
            _, one = packing.pack(sizes, [c])
            assert mixed.sum() <= one.sum()


@pytest.mark.parametrize(("a", "b"), [("10⁵ cells", "105 cells"), ("x²", "x2"), ("H₂O", "H2O"), ("2½ years", "21/2 years")])
def test_raised_figures_are_other_figures(a, b):
    canonical, skeleton = unify.unified(pa.array([a, b]))
    assert canonical[0] != canonical[1] and skeleton[0] != skeleton[1]
