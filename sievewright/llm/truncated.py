"""Texts cut off by field limits or broken transfers: a hashed logistic regression on how a text ends.

Positives are made by cutting intact values (inside words, inside sentences, after abbreviations, inside quotations,
with and without the usual signs of a cut); negatives are the intact values. Features are the closing characters and
tokens, hashed, the state of quotes and brackets over the whole text, and whether the length meets the limit of its
source. Limits are counted over all rows: per source, the length at which far more unclosed texts end than at any
other. All intact values train the model: their examples are made where the texts are, equal sets of features are
counted, and the regression is fitted to these counts.

Defined cases: null, blank and N/A texts are not truncated; trailing spaces and invisible characters do not count;
a closing list of keywords, an imprint or an identifier is not a cut; a source without a limit has no limit feature;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import BROADCAST_ROWS, arrow_map
from sievewright.session import cut as cut_lineage

#: Size of the hashed feature space; weight of the squares of the weights beside the loss of all examples.
SPACE, RIDGE = 1 << 16, 0.3
#: A length is a source's limit when so many unclosed texts, and such a share of its unclosed texts, end there.
LIMIT_COUNT, LIMIT_SHARE = 3, 0.08

ENDS = ".!?。！？।؟…．｡"
CLOSERS = "\"'”’»“)]）】」』›"
INVISIBLE = "​‌‍⁠﻿‎‏­"
SIGNS = ("...", "…", " …", "... (more)", " [...]", " […]", "-", "–", "&hellip;", "&hel", "&#82", " ...", "..", " (more)", "... Read more", ",")
#: What a trailer begins with: a label of keywords and a colon, an identifier, a mark of copyright.
_LABEL = re.compile(
    r"""(?:^|(?<=[\s.,;。\]]))(?:
      (?P<list>(?:key\s?-?words?|index\s+terms|subject\s+headings|JEL|MSC|palavras-chave|mots[- ]cl[ée]s|schl[üu]sselw[öo]rter|palabras\s+clave|
         parole\s+chiave|anahtar\s+kelimeler|s[łl]owa\s+kluczowe|kata\s+kunci|ключевые\s+слова|关键词|關鍵詞|キーワード|주제어|핵심어|कुंजी\s*शब्द|
         الكلمات\s+المفتاحية|คำสำคัญ)[^:：\n]{0,20}[:：])
      |(?P<ident>(?:doi|arXiv|PMID|ISSN|ISBN|URN|hdl|https?)\s?:\s?|10\.\d{4,9}/)
      |(?P<right>©|\(c\)|Copyright|&copy;)
    )""",
    re.X | re.I,
)
#: Imprints: volume and number after a name, a volume in square brackets, or a publisher's name of its own after a closing mark.
_IMPRINT = re.compile(
    r"""(?:,\s[^.,;()]{3,},\s(?:Vol|Jg|T|Bd)\.\s?\d+,\s(?:No|Nr|Iss|Heft)\.\s?\d+|\[[^\[\]]{3,}\b(?:vol|no)\.\s?\d+\]
    |(?<=[.!?。！？।؟…"'”’»“)\]])\s*(?:\w+\s){1,3}(?:Press|Publishers?|Society|Journals|Reports|Archive|Verlag))$""",
    re.X | re.I,
)
#: What a text with an imprint ends with.
_IMPRINT_END = re.compile(r"(?:\d|\]|Press|Publishers?|Society|Journals|Reports|Archive|Verlag)$", re.I)
_ITEM = re.compile(r"[;,、；，·•|/\n]|\s[-–—]\s|\.\s")
#: What is put after intact texts in training, so that each kind of ending is known.
TRAILERS = ("\nKeywords: soil; yield", " Key words: wells, rivers", " doi:10.1000/182", " © The authors", " (C) 2019 City Press", " JEL: Q12", " [City Reports, vol. 4]", ", City Press, Vol. 6, No. 4")
_ENTITY = re.compile(r"&#?\w{1,7}$")
_MARKED = re.compile(r"(?:…|\.\.\.?|\[(?:…|\.\.\.)\]|\((?:more|continued|cont\.)\)|&hellip;?|&#8230;?|Read more)$", re.I)
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿]")
_THAI_END = re.compile(r"[฀-໿က-႟ក-៿][\s\d.,()]*$")
_BLANK = ("", "n/a", "na", "none", "null")


def _marked(text: str) -> bool:
    """Ends with the sign of a cut; the longest one has 11 characters."""
    return _MARKED.search(text[-12:]) is not None


def trimmed(text: str) -> str:
    """The text without space and invisible characters at its end."""
    return text.rstrip().rstrip(INVISIBLE).rstrip()


@lru_cache(maxsize=8)
def trailer(text: str) -> tuple[int, str]:
    """Where the trailer of a text begins, and its kind; (length, "") without one.

    The whole text is searched. Keywords are a trailer if each item after their label is short, an identifier if nothing
    follows it, a mark of copyright if no sentence follows it.
    """
    m = _IMPRINT_END.search(text[-12:]) and _IMPRINT.search(text)
    if m:
        return m.start(), "imprint"
    low = text.lower()
    if not any(c in low for c in (":", "：", "10.", "©", "(c)", "copy")):  # no label is without one of these
        return len(text), ""
    for m in _LABEL.finditer(text):
        rest = text[m.end() :]
        if m["list"]:
            if all(len(item.split()) < 7 and len(item) < 80 for item in _ITEM.split(rest)):
                return m.start(), "list"
        elif m["ident"]:
            if not re.search(r"\s", rest.strip()):
                return m.start(), "ident"
        elif len(rest.split()) < 12:
            return m.start(), "right"
    return len(text), ""


def closed(text: str) -> bool:
    """Ends with a mark that closes sentences, whatever quotes or brackets follow it."""
    body = text.rstrip(CLOSERS)
    return bool(body) and body[-1] in ENDS and not _marked(text)


def features(text: str, at_limit: bool) -> list[int]:
    """Hashed features of the end of a text."""
    # a closed text needs no look for a trailer; behind one, the end of the text before it is judged, beside the trailer's kind
    at, kind = (len(text), "") if closed(text) else trailer(text)
    whole, text = text, trimmed(text[:at])
    tail = re.sub(r"\d", "0", text[-24:])
    token = re.split(r"\s", tail)[-1][-14:]
    body = text.rstrip(CLOSERS)
    last = body[-1:] or " "
    shut = last in ENDS
    names = [f"c{tail[-1:]}", f"d{tail[-2:]}", f"e{tail[-3:]}", f"s{shut}"]
    names.append(f"m{_marked(text)}{bool(_ENTITY.search(tail))}")
    names.append(f"q{_open(text)}{shut}")
    unspaced = bool(_THAI_END.search(tail))
    names.append(f"u{unspaced}{at_limit}{shut}")
    if unspaced:
        names += [f"t{k}{tail[-k:]}" for k in (4, 5, 6, 8)]
    elif shut:
        names.append(f"w{token.lower()}" if len(token) < 6 else "w+")
        names.append("n" + re.sub(r"\w", "a", re.sub(r"\d", "0", token[-6:])))
    names.append(f"l{at_limit}")
    if kind:
        names += [f"k{kind}", f"k{kind}{shut}", f"K{_marked(whole)}{_ENTITY.search(whole[-10:]) is not None}"]
    return [zlib.crc32(n.encode()) % SPACE for n in names]


def _open(text: str) -> str:
    """Which kinds of quotes or brackets stand open at the end."""
    out = ""
    for first, second in ("()", "[]", "“”", "«»", "「」"):
        if first in text and text.count(first) > text.count(second) and not (first == "“" and "„" in text):
            out += first
    if "„" in text and text.count("„") > text.count("“") + text.count("”"):
        out += "„"
    if '"' in text and text.count('"') % 2:
        out += '"'
    return out if "(" not in out or not re.search(r"\d\)|\b[a-z]\)", text) else out.replace("(", "")


def cuts(text: str, rng: random.Random) -> list[str]:
    """Artificial truncations of an intact text."""
    out = []
    low = max(20, len(text) // 4)
    if len(text) < 40:
        return out
    for _ in range(3):
        piece = trimmed(text[: rng.randint(low, len(text) - 4)])
        if closed(piece) or _UNSPACED.search(piece[-1:]) and text[len(piece) : len(piece) + 1].isspace():
            continue
        out.append(piece + (rng.choice(SIGNS) if rng.random() < 0.45 else ""))
    inner = [m.end() for m in re.finditer(r"(?<![^\s(])[^\W\d_]{1,4}\.(?=\s[a-zа-я(])", text[low:])]
    if inner:
        out.append(text[: low + rng.choice(inner)])
    inside = [m.end() for m in re.finditer(r"[.!?。](?=\s|\w)", text) if _open(text[: m.end()]) and m.end() > 30]
    if inside:
        out.append(text[: rng.choice(inside)])
    return out


class Model:
    """Weights of the hashed logistic regression."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def score(self, text: str | None, at_limit: bool) -> float:
        if text is None:
            return 0.0
        text = trimmed(text)
        if text.lower() in _BLANK:
            return 0.0
        z = float(self.weights[features(text, at_limit)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def examples(raw: str) -> tuple[str | None, list[tuple[bytes, int]]]:
    """Sets of features with their labels (1: cut) that one text gives, the same ones wherever it stands; none if it may
    be cut itself. A text of a script that closes sentences without a mark also gives its end: an end seen in one text
    only may be a cut, so such examples count only if another text ends so."""
    text = trimmed(raw)
    thai = bool(_THAI_END.search(text[-12:]))
    marked = closed(text) or bool(trailer(text)[1])
    if not (marked or thai) or _open(text) or _marked(text):
        return None, []
    rng = random.Random(zlib.crc32(text.encode()))
    rows = [(features(text, rng.random() < 0.01), 0)]
    if rng.random() < 0.2:  # an intact text with what may follow one
        rows.append((features(text + rng.choice(TRAILERS), False), 0))
    # a cut within a trailer leaves a whole text, so only what stands before it is cut
    rows += [(features(piece, rng.random() < 0.3), 1) for piece in cuts(trimmed(text[: trailer(text)[0]]), rng)]
    return None if marked else text[-5:], [(np.sort(np.array(f, np.int32)).tobytes(), label) for f, label in rows]


def fit(texts: list[str]) -> Model:
    """Fit on intact texts and their artificial truncations."""
    ends = Counter(t[-5:] for t in set(map(trimmed, texts)))
    counts: dict[bytes, list[int]] = {}
    for text in texts:
        end, rows = examples(text)
        for f, label in rows if end is None or ends[end] > 1 else ():
            counts.setdefault(f, [0, 0])[label] += 1
    return solve(list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()])


def solve(sets: list[bytes], whole: list[int], cut: list[int], rounds: int = 80) -> Model:
    """The weights of least loss over all examples (whole and cut: their numbers per set of features), by the method of
    Broyden, Fletcher, Goldfarb and Shanno with bounded memory; the order of the sets does not matter."""
    if not sets:
        return Model(np.zeros(SPACE))
    order = sorted(range(len(sets)), key=sets.__getitem__)
    lengths = np.array([len(sets[i]) // 4 for i in order])
    x = np.full((len(order), lengths.max()), SPACE)
    x[np.arange(x.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join([sets[i] for i in order]), np.int32)
    used, place = np.unique(x, return_inverse=True)
    place = place.reshape(x.shape)
    free = (used < SPACE).astype(float)
    n0, n1 = np.array(whole, float)[order], np.array(cut, float)[order]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[place].sum(1)
        error = (n0 + n1) / (1 + np.exp(-np.clip(z, -40, 40))) - n1
        slope = np.bincount(place.ravel(), np.repeat(error, place.shape[1]), len(used)) + RIDGE * w
        return float(n0 @ np.logaddexp(0, z) + n1 @ np.logaddexp(0, -z) + RIDGE * (w @ w) / 2), slope * free

    w = np.zeros(len(used))
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, shares = slope.copy(), []
        for d, y in reversed(past):
            shares.append((d @ step) / (d @ y))
            step -= shares[-1] * y
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(slope).sum()))
        for (d, y), share in zip(past, reversed(shares), strict=True):
            step += d * (share - (y @ step) / (d @ y))
        fall, size = float(slope @ step), 1.0
        while True:
            after, turned = loss(w - size * step)
            if after <= value - 1e-4 * size * fall or size < 1e-6:
                break
            size /= 2
        if after > value or value - after < 1e-7 * value:
            break
        if (turned - slope) @ (-size * step) > 1e-12:
            past = [*past, (-size * step, turned - slope)][-8:]
        w, value, slope = w - size * step, after, turned
    out = np.zeros(SPACE + 1)
    out[used] = w
    return Model(out[:SPACE])


def fitted(df: DataFrame, text: str, spoilt: Callable[[str], bool] = lambda t: False) -> Model:
    """The model of all texts of more than 60 characters that are not spoilt. Only counts of sets of features leave the
    executors; they grow with the ways in which texts end, not with the texts."""
    chosen = df.where(F.length(text) > 60).select(F.col(text).alias("t"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[bytes, str | None], list[int]] = {}
        for t, copies in Counter(batch.column(0).to_pylist()).items():
            end, rows = examples(t)
            if rows and not spoilt(t):
                for f, label in rows:
                    counts.setdefault((f, end), [0, 0])[label] += copies
        sums = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts], pa.binary()), pa.array([e for _, e in counts], pa.string()), *sums], ["f", "end", "n0", "n1"])

    add = [F.sum(c).alias(c) for c in ("n0", "n1")]
    rows = cut_lineage(arrow_map(chosen, kernel, "f binary, end string, n0 long, n1 long").groupBy("f", "end").agg(*add))
    bare = F.regexp_replace("t", rf"[\s{INVISIBLE}]+$", "")
    unspaced = chosen.where(F.col("t").rlike(_UNSPACED.pattern))  # few texts have such a letter at all
    again = unspaced.select(bare.alias("t")).where(F.col("t").rlike(_THAI_END.pattern)).groupBy(F.right("t", F.lit(5)).alias("end")).agg(F.count_distinct(F.xxhash64("t")).alias("k")).where("k > 1")
    kept = rows.where(F.col("end").isNull()).unionByName(rows.where(F.col("end").isNotNull()).join(again, "end", "left_semi").select("f", "end", "n0", "n1"))
    found = kept.groupBy("f").agg(*add).toArrow()
    return solve(*(found.column(c).to_pylist() for c in ("f", "n0", "n1")))


def source_limits(df: DataFrame, text: str, source: str) -> DataFrame:
    """Per source, the length at which its unclosed texts pile up: columns `source`, `cut_at`. Counted over all rows."""
    unclosed = df.where(
        F.col(text).isNotNull() & ~F.rtrim(F.col(text)).rlike(r"""[.!?。！？।؟]["'”’»“)\]）】」』›\s]*$""") & ~F.lower(F.trim(F.col(text))).isin(*_BLANK)
    )
    # copies of one text, landed again, count once
    texts = unclosed.groupBy(F.col(source).alias("source"), F.length(text).alias("n"), F.xxhash64(text)).agg(F.count("*"))
    counts = texts.groupBy("source", "n").agg(F.count("*").alias("k"))
    per = counts.groupBy("source").agg(F.max_by("n", F.struct("k", "n")).alias("cut_at"), F.max("k").alias("top"), F.sum("k").alias("all"))
    return per.where((F.col("top") >= LIMIT_COUNT) & (F.col("top") >= LIMIT_SHARE * F.col("all"))).select("source", "cut_at")


def truncation_scores(
    df: DataFrame, key: list[str], text: str, source: str, spoilt: Callable[[str], bool] = lambda t: False, least: float = 0.5
) -> DataFrame:
    """One row per truncated text: the key columns, `source` and `p_truncated`. Further columns of df are ignored.

    Texts for which `spoilt` holds (no real text, or garbled) neither train the model nor come out.
    """
    model = fitted(df, text, spoilt)
    # where every weight is zero nothing was learnt, and nothing is called truncated
    learnt = bool(np.any(model.weights))
    used = np.flatnonzero(model.weights)
    shipped = (used, model.weights[used])
    base = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(source).alias("source"), F.col(text).alias("t"))
    base = base.where(F.col("t").isNotNull())
    limits = source_limits(df, text, source)
    held_limits = limits.limit(BROADCAST_ROWS + 1).collect()
    if len(held_limits) <= BROADCAST_ROWS:  # so the texts are not shuffled, and a source with many rows stays spread
        limits = F.broadcast(df.sparkSession.createDataFrame(held_limits, limits.schema))
    joined = base.join(limits, base["source"].eqNullSafe(limits["source"]), "left").select(
        *[f"k{i}" for i in range(len(key))], base["source"], "t", "cut_at"
    )
    kinds = dict(joined.dtypes)
    held: list[Model] = []

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            w = np.zeros(SPACE)
            w[shipped[0]] = shipped[1]
            held.append(Model(w))
        n = len(key)
        found: dict[tuple[str, bool], float] = {}
        scores = []
        for t, at in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
            case = t, at is not None and at - 1 <= len(t) <= at
            if case not in found:
                p = held[0].score(*case) if learnt else 0.0
                found[case] = 0.0 if p >= least and spoilt(t) else p
            scores.append(found[case])
        keep = pa.array([i for i, s in enumerate(scores) if s >= least], pa.int64())
        columns = [batch.column(i).take(keep) for i in range(n + 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()).take(keep)], [*[f"k{i}" for i in range(n)], "source", "p_truncated"])

    schema = ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(key))) + f", source {kinds['source']}, p_truncated double"
    out = arrow_map(joined, kernel, schema)
    for i, k in enumerate(key):
        out = out.withColumnRenamed(f"k{i}", k)
    return out
