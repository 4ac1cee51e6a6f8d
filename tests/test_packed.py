import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.operators.packed import split_batch, split_packed

CASES = [
    ("a; b", ["a", "b"]), ("1) x; 2) y", ["x", "y"]), ("(1) q\n(2) r", ["q", "r"]), ("(1) x y (2) z", ["x y", "z"]), ("(1) x (3) y", ["x (3) y"]),
    ('"a; b"; c', ["a; b", "c"]), ('"a, b","c"', ["a, b", "c"]), ("x and/or y", ["x and/or y"]), ("a / b // c", ["a", "b", "c"]),
    ("foo (was: X; now closed); bar", ["foo (was: X; now closed)", "bar"]), ("A &amp; B; C", ["A &amp; B", "C"]), ("paywall, abstract", ["paywall, abstract"]),
    ("", []), (None, []), ("   ", []), ("• a\n• b;", ["a", "b"]), ('5" x; y', ['5" x', "y"]), ("a (b; c", ["a (b", "c"]), ("a) b; c", ["a) b", "c"]),
    ("'x;y'; z", ["x;y", "z"]), ("O'Neil; D'Arcy", ["O'Neil", "D'Arcy"]), ("the boys' club; 'a' b", ["the boys' club", "'a' b"]), ("'tis; can't", ["'tis", "can't"]),
    (" ".join(f"({k}) v{k}" for k in range(1, 121)), [f"v{k}" for k in range(1, 121)]), ("a;;b; ", ["a", "b"]), ("http://x//y", ["http://x//y"]),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_split(text, values):
    assert split_batch(pa.array([text], pa.string())).to_pylist() == [values]


def test_batches_do_not_interfere():
    texts = [t for t, _ in CASES] * 3
    assert split_batch(pa.array(texts, pa.string())).to_pylist() == [v for _, v in CASES] * 3
    assert split_batch(pa.array(texts, pa.string()).slice(3, 7)).to_pylist() == [v for _, v in (CASES * 3)[3:10]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from("abc é"), min_size=1).map(str.strip).filter(bool), min_size=1, max_size=4), max_size=5))
def test_round_trip(rows):
    joined = ["; ".join(r) for r in rows]
    assert split_batch(pa.array(joined, pa.string())).to_pylist() == [[v.strip() for v in r] for r in rows]


def test_operator(spark):
    rows = [(1, "a; b", "x"), (2, None, "y"), (3, "one", "z"), (1, "a; b", "x"), (4, "w " * 50_000 + "; v", "q")]
    df = spark.createDataFrame(rows, "id long, text string, val string")  # val clashes with an output name and is ignored
    out = split_packed(df, "text", ["id"], least=2).collect()
    assert sorted((r.id, r.val_pos, len(r.val)) for r in out) == [(1, 0, 1), (1, 0, 1), (1, 1, 1), (1, 1, 1), (4, 0, 99_999), (4, 1, 1)]
    assert split_packed(df.limit(0), "text", ["id"]).count() == 0
    with pytest.raises(ValueError):
        split_packed(df, "text", ["val"])


def test_entities_protect_their_semicolon():
    texts = ["x &lt; y; z", "&#39;; a", "& ; b"]
    got = split_batch(pa.array(texts)).to_pylist()
    assert got == [["x &lt; y", "z"], ["&#39;", "a"], ["&", "b"]]
    assert all(not re.match(r"\s", v) for g in got for v in g)
