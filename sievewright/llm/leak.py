"""Evaluation texts leaking into training text: n-gram seeds, then Smith-Waterman alignment.

A word is an unbroken run of letters and digits of the NFKC form, without regard to case. Every n-gram of an item is a
seed: a document that shares N consecutive words with an item is compared with it, whatever was edited elsewhere.
Documents are scanned by rolling hashes against the seeds. A bound on scores, which no alignment exceeds, sets aside the stretches
of the document that cannot be reported; all others are aligned with the item, which also scores edited and paraphrased
copies, and an exact count of the longest common run follows.

Items are the stated query set: they are handled in blocks of BLOCK items against all documents, so what is sent to
the executors is bounded whatever their number; the documents are never shuffled.

Defined cases: null and empty texts match nothing; items of fewer than N words have no seed and match nothing, items
of fewer than RUN words can only be scored by alignment; copies edited so densely that no N words in a row are left
are not compared; several items with the same text all come out; documents of any length are scanned whole; repeated
documents each come out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import arrow_map

N, RUN, BLOCK = 5, 12, 5000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the best possible score, and least aligned words, for a pair to be reported as a copy.
LEAST_SHARE, LEAST_WORDS = 0.25, 8
#: An alignment that gains spans at most (MATCH - GAP) / -GAP words of a document for each word of the item; stretches
#: longer than WIDE times the item are aligned in pieces that overlap by that much, so nothing is lost and memory is bounded.
SPAN, WIDE = (MATCH - GAP) // -GAP, 8
#: Words of documents that are aligned with an item at once.
CELLS = 12_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


def _hashes(tokens: list[str]) -> np.ndarray:
    """Word hashes of this process; hits are compared by the words themselves afterwards."""
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


def _grams(h: np.ndarray, n: int = N) -> np.ndarray:
    """Rolling hashes of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _BASE
        out ^= out >> np.uint64(29)
    return out


class Seeds:
    """Membership of n-grams in a bounded set: a bitmap first, then a sorted array."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        found: dict[int, list[int]] = defaultdict(list)
        for item, h in enumerate(texts):
            for gram in np.unique(_grams(h)).tolist():
                found[gram].append(item)
        self.keys = np.array(sorted(found), np.uint64)
        self.where = [found[int(k)] for k in self.keys]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams that are seeds, and which."""
        if not len(self.keys) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[grams >> np.uint64(42)])
        place = np.minimum(np.searchsorted(self.keys, grams[maybe]), len(self.keys) - 1)
        real = self.keys[place] == grams[maybe]
        return maybe[real], place[real]


class Holders:
    """Which items hold each n-gram."""

    def __init__(self, texts: list[np.ndarray], n: int) -> None:
        grams = [np.unique(_grams(h, n)) for h in texts]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.items = np.repeat(np.arange(len(texts)), [len(g) for g in grams])[order]
        self.keys, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))

    def held(self, grams: np.ndarray, row_of: np.ndarray, rows: int) -> np.ndarray:
        """Whether the item of a row holds the n-gram of a column; row_of is -1 for items without a row."""
        out = np.zeros((rows, len(grams)), bool)
        if not len(self.keys) or not len(grams):
            return out
        place = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == grams)
        begin, count = self.starts[place[at]], self.starts[place[at] + 1] - self.starts[place[at]]
        posted = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        row, column = row_of[self.items[posted]], np.repeat(at, count)
        out[row[row >= 0], column[row >= 0]] = True
        return out


def rows_of_hits(items: np.ndarray, positions: np.ndarray, n_items: int) -> np.ndarray:
    """Per item, how many of its hits stand in a row at most."""
    order = np.lexsort((positions, items))
    items, positions = items[order], positions[order]
    starts = np.flatnonzero(np.append(True, (np.diff(items) != 0) | (np.diff(positions) != 1)))
    out = np.zeros(n_items, np.int64)
    np.maximum.at(out, items[starts], np.diff(np.append(starts, len(items))))
    return out


def stretches(h: np.ndarray, chosen: np.ndarray, least: np.ndarray, ones: Holders, twos: Holders, n_items: int) -> list[tuple[int, int, int]]:
    """(place in chosen, first word, end) of the stretches of a document outside which no alignment with a chosen item scores `least`.

    An aligned stretch gains at most MATCH for a word the item holds and loses 1 for any other. Two neighbours that the
    item holds, but not next to each other, cost a gap if both are matched; a word that is not matched costs more than
    its two neighbourhoods. The 1 added stands for the neighbourhood before the stretch.
    """
    row_of = np.full(n_items, -1)
    row_of[chosen] = np.arange(len(chosen))
    word = ones.held(_grams(h, 1), row_of, len(chosen))
    gain = np.where(word, np.int32(MATCH), np.int32(MISMATCH))
    gain[:, 1:] -= word[:, 1:] & word[:, :-1] & ~twos.held(_grams(h, 2), row_of, len(chosen))
    total = np.cumsum(gain, 1)
    low = np.minimum.accumulate(np.pad(total[:, :-1], ((0, 0), (1, 0))), 1)
    high = np.maximum.accumulate(total[:, ::-1], 1)[:, ::-1]
    inside = np.pad(high - low + 1 >= least[:, None], ((0, 0), (1, 1))).astype(np.int8)  # the best stretch through each word
    rows, edges = np.nonzero(np.diff(inside, axis=1))
    return list(zip(rows[::2].tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def pieces(lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """A stretch cut into pieces of WIDE times an item's size that overlap by the longest alignment."""
    step = (WIDE - SPAN) * size
    return [(a, min(hi, a + WIDE * size)) for a in range(lo, max(lo + 1, hi - SPAN * size), step)]


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman of two word arrays: score, aligned words, first and last word of part, and the longest common run."""
    return align_all(item, [part])[0]


def align_all(item: np.ndarray, parts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """Alignments of one item with many parts, CELLS at once."""
    out: list = [None] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    while order:
        width = len(parts[order[-1]])
        chunk = order[-max(1, CELLS // (width + 1)) :]
        del order[-len(chunk) :]
        for i, found in zip(chunk, _align(item, [parts[i] for i in chunk], width), strict=True):
            out[i] = found
    return out


def _align(item: np.ndarray, parts: list[np.ndarray], m: int) -> list[tuple[int, int, int, int, int]]:
    """One column a part, so that every step is a vector operation over whole rows."""
    kind = np.int16 if MATCH * len(item) + m < 30_000 else np.int32
    known, codes = np.unique(item, return_inverse=True)
    part = np.full((m, len(parts)), -1, kind)  # words of the item by number; others and the padding are -1
    for p, words_ in enumerate(parts):
        place = np.minimum(np.searchsorted(known, words_), len(known) - 1)
        part[: len(words_), p] = np.where(known[place] == words_, place, -1)
    rows = np.zeros((len(item) + 1, m + 1, len(parts)), kind)
    run, longest = np.zeros((m, len(parts)), kind), np.zeros((m, len(parts)), kind)
    for i, code in enumerate(codes):
        row, step = rows[i], rows[i + 1]
        same = (part == code).astype(kind)
        run[1:] = run[:-1].copy()
        run[:1] = 0
        run += kind(1)
        run *= same
        np.maximum(longest, run, out=longest)
        same *= kind(MATCH - MISMATCH)
        same += kind(MISMATCH)
        np.maximum(row[:-1] + same, row[1:] + kind(GAP), out=step[1:])
        np.maximum(step, 0, out=step)
        k = 1
        while k <= min(m, MATCH * len(item)):  # gaps of up to 2k - 1 words of the part
            np.maximum(step[k:], step[:-k] + kind(k * GAP), out=step[k:])
            k *= 2
    every = np.arange(len(parts))
    i = rows.max(1).argmax(0)
    j = rows[i, :, every].argmax(1)
    last, score, matched = j.copy(), rows[i, j, every].astype(np.int64), np.zeros(len(parts), np.int64)
    first = j.copy()
    live = np.flatnonzero(score > 0)
    while len(live):
        x, y = i[live], j[live]
        same = part[y - 1, live] == codes[x - 1]
        here = rows[x, y, live]
        back = here == rows[x - 1, y - 1, live] + np.where(same, MATCH, MISMATCH)
        up = ~back & (here == rows[x - 1, y, live] + GAP)
        matched[live] += back & same
        i[live] -= back | up
        j[live] -= ~up
        first[live] = j[live]
        live = live[rows[i[live], j[live], live] > 0]
    return list(zip(score.tolist(), matched.tolist(), first.tolist(), last.tolist(), longest.max(0, initial=0).tolist(), strict=True))


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, edited: bool = True) -> DataFrame:
    """One row per document and item that are aligned: keys, alignment `score` and its `share` of the best possible one, `n_words` aligned,
    `longest_run` of common words, and the words `word_start`..`word_end` of the document. Without `edited`,
    only pairs with a common run of RUN words."""
    kinds = {**dict(docs.dtypes), **{f"item {k}": v for k, v in items.dtypes}}
    chosen = docs.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t")).where(F.col("t").isNotNull())
    # the query set, fetched block by block in the order of its key
    ordered = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = ordered.count()
    schema = f"`{doc_key}` {kinds[doc_key]}, `{item_key}` {kinds[f'item {item_key}']}, share double, score int, n_words int, longest_run int, word_start int, word_end int"
    result = docs.sparkSession.createDataFrame([], schema)
    for block in range(max(1, -(-total // BLOCK))) if total else []:
        rows = ordered.orderBy("k").offset(block * BLOCK).limit(BLOCK).collect()
        result = result.unionByName(_block(chosen, [r["k"] for r in rows], [words(r["t"]) for r in rows], schema, doc_key, item_key, edited))
    return result


def _block(docs: DataFrame, keys: list, texts: list[list[str]], schema: str, doc_key: str, item_key: str, edited: bool) -> DataFrame:
    held: list[tuple] = []

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            targets = [_hashes(t) for t in texts]
            held.append((targets, Seeds(targets), Holders(targets, 1), Holders(targets, 2), np.array([len(t) for t in texts])))
        targets, seeds, ones, twos, sizes = held[0]
        spans: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)  # per item: row, first word of the part, the part
        for at, text in enumerate(batch.column(1).to_pylist()):
            h = _hashes(words(text))
            positions, which = seeds.hits(_grams(h))
            if not len(positions):
                continue
            holders = [seeds.where[w] for w in which.tolist()]
            in_a_row = rows_of_hits(np.concatenate(holders), np.repeat(positions, [len(x) for x in holders]), len(texts))
            chosen = np.flatnonzero(in_a_row)
            # all n-grams of a run of RUN words are hits, and it scores MATCH a word
            least = np.where(in_a_row[chosen] > RUN - N, MATCH * RUN, np.inf)
            if edited:
                least = np.minimum(least, LEAST_SHARE * MATCH * sizes[chosen])
            chosen, least = chosen[least < np.inf], least[least < np.inf]
            if not len(chosen):
                continue
            for k, lo, hi in stretches(h, chosen, least, ones, twos, len(texts)):
                item = int(chosen[k])
                for a, b in pieces(lo, hi, int(sizes[item])):
                    spans[item].append((at, a, h[a:b]))
        best: dict[tuple[int, int], tuple] = {}
        for item, parts in spans.items():
            size = len(targets[item])
            for (at, lo, _), (score, matched, first, last, longest) in zip(parts, align_all(targets[item], [p for _, _, p in parts]), strict=True):
                found, old = (score / (MATCH * size), score, matched, longest, lo + first, lo + last), best.get((at, item))
                best[at, item] = found if old is None else (*max(old, found)[:3], max(old[3], longest), *max(old, found)[4:])
        kept = sorted((at, item, b) for (at, item), b in best.items() if b[3] >= RUN or edited and b[0] >= LEAST_SHARE and b[2] >= LEAST_WORDS)
        where, out = [at for at, _, _ in kept], [(keys[item], *b) for _, item, b in kept]
        if not where:
            return None
        columns = list(zip(*out, strict=True))
        kinds = [pa.float64(), *[pa.int32()] * 5]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(where)), pa.array(columns[0]), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]],
            [doc_key, item_key, "share", "score", "n_words", "longest_run", "word_start", "word_end"],
        )

    return arrow_map(docs, kernel, schema)
