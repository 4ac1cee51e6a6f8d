"""Several values packed in one field: one row per value, with its position.

The scan works on the bytes of Arrow string buffers. For a whole batch it computes, without a loop over rows,
  - quote parity and bracket depth of every byte, counted from the start of its row,
  - masks of the bytes that divide (semicolon, bar, tab, line break, spaced slash, comma between quoted values, the
    space before the next mark of a numbered list),
and turns the surviving delimiters into child offsets of one list array, which is flattened with parent ordinals.

Defined cases: null, empty or blank text gives no value; unbalanced quotes in a row count as ordinary characters; a
single quote encloses only from one delimiter or end of the text to another, else it is an apostrophe;
an opening bracket without its end, or an end without its opening, protects nothing; empty values between
delimiters are dropped and take no position; repeated rows each give their own values; texts of any length are
scanned whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import arrow_map

#: List marks that a value loses: a bullet, or a number with a dot or bracket.
MARK = re.compile(r"^(?:[-*•·‣▪◦–—]\s+|\(\d{1,3}\)\s*|\d{1,3}\)\s*|\d{1,3}\.\s+)")
PAIRS = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“"}
#: Texts without one of these characters hold one value; Spark drops them before Python sees them.
MAY_DIVIDE = r"[;|\t\n\r/,；｜¦]|\s\(?2[.)]\s"


def _sequence(data: np.ndarray, *units: str) -> np.ndarray:
    """Mask of the bytes at which one of the units begins."""
    found = np.zeros(len(data), bool)
    for unit in units:
        raw = unit.encode()
        n = len(data) - len(raw) + 1
        if n <= 0:
            continue
        here = data[:n] == raw[0]
        for k in range(1, len(raw)):
            here &= data[k : k + n] == raw[k]
        found[:n] |= here
    return found


def _depth(opens: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bracket depth after each byte; ends without an opening are ignored. Rows are told apart by a large step."""
    step = opens.astype(np.int64) - ends
    cum = np.cumsum(step)
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    base = (cum - step)[first][np.cumsum(first) - 1] if len(row) else cum
    rel = cum - base
    big = np.int64(len(step) + 1) * 2
    ordinal = np.cumsum(first).astype(np.int64)
    low = np.minimum.accumulate(rel - big * ordinal) + big * ordinal
    return rel - np.minimum(low, 0)


def _numbered(data: np.ndarray, row: np.ndarray, first: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Mask of the spaces before the marks (2), (3) ... of a list written in one line that begins with its mark (1).

    The marks are "(n)", "n)" or "n."; they count only if they are of one style and go on one by one.
    """
    n = len(data)
    found = np.zeros(n, bool)
    tail = np.r_[data, np.zeros(6, np.uint8)]
    edge = np.r_[True, space[:-1]] | first
    filled = ~space
    at_head = np.zeros(n, bool)
    seen = np.cumsum(filled)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at_head[filled & (seen - seen[begin] + filled[begin] == 1)] = True
    index = np.flatnonzero(edge & filled)
    opened = (tail[index] == 40).astype(np.int64)
    d1, d2, d3 = (tail[index + opened + k].astype(np.int64) - 48 for k in range(3))
    digit1, digit2, digit3 = ((d >= 0) & (d < 10) for d in (d1, d2, d3))
    digit3 &= digit2
    value = np.where(digit2, d1 * 10 + d2, d1)
    value = np.where(digit3, value * 10 + d3, value)
    end = tail[np.minimum(index + opened + 1 + digit2 + digit3, n + 4)]
    after = tail[np.minimum(index + opened + 2 + digit2 + digit3, n + 5)]
    mark = digit1 & ((end == 41) | (end == 46) & (opened == 0)) & (after == 32)
    index, value = index[mark], value[mark]
    style = opened[mark] * 2 + (end[mark] == 41)
    if not len(index):
        return found
    which = row[index]
    heads = at_head[index] & (value == 1)
    if not heads.any():
        return found
    head_style = np.full(int(row[-1]) + 1, -1)
    head_style[which[heads]] = style[heads]
    same = head_style[which] == style
    index, value, which = index[same], value[same], which[same]
    start = np.r_[True, which[1:] != which[:-1]]
    rank = np.arange(len(which)) - np.maximum.accumulate(np.where(start, np.arange(len(which)), 0))
    wrong = np.bincount(which, value != rank + 1, int(row[-1]) + 1)
    good = (wrong[which] == 0) & (rank > 0)
    found[index[good] - 1] = True
    return found


def divide(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions in data) and row ordinals of the raw values of each text."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = data[lo:hi]
    offsets = (offsets - lo).astype(np.int64)
    n, rows = len(data), len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(rows), lengths)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    quote = data == 34
    seen = np.r_[0, np.cumsum(quote)]
    whole = (seen[offsets[1:]] - seen[offsets[:-1]]) % 2 == 0
    inside = (seen[1:] - seen[offsets[:-1]][row]) % 2 == 1
    inside &= whole[row]

    opens = np.isin(data, np.frombuffer(b"([{", np.uint8)) | _sequence(data, "“", "«")
    ends = np.isin(data, np.frombuffer(b")]}", np.uint8)) | _sequence(data, "”", "»")
    opens &= ~inside
    ends &= ~inside
    if opens.any():
        left = _depth(opens, ends, row)
        right = _depth(ends[::-1], opens[::-1], row[::-1])[::-1]
        inside |= np.minimum(left, right) > 0

    index = np.arange(n)
    space = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    before = np.r_[True, space[:-1]] | (index == offsets[:-1][row])
    after = np.r_[space[1:], True] | (index + 1 == offsets[1:][row])

    alnum = ((data >= 48) & (data <= 57)) | ((data | 32) >= 97) & ((data | 32) <= 122) | (data == 35)
    # single quotes enclose a value only from a delimiter (or the beginning) to a delimiter (or the end), as they are apostrophes too
    single_quote = data == 39
    if single_quote.any():
        border = np.isin(data, np.frombuffer(b";|,\t\n\r/", np.uint8))
        seen_before = np.r_[-1, np.maximum.accumulate(np.where(space & ~border, -1, index))[:-1]]
        seen_after = np.r_[np.minimum.accumulate(np.where(space & ~border, n, index)[::-1])[::-1][1:], n]
        at_start = (seen_before < offsets[:-1][row]) | border[np.maximum(seen_before, 0)]
        at_end = (seen_after >= offsets[1:][row]) | border[np.minimum(seen_after, n - 1)]
        opening = single_quote & at_start & ~np.r_[space[1:], True] & ~inside
        closing = single_quote & at_end & ~np.r_[True, space[:-1]] & ~opening
        last_open = np.maximum.accumulate(np.where(opening, index, -1))
        last_close = np.r_[-1, np.maximum.accumulate(np.where(closing, index, -1))[:-1]]
        next_close = np.minimum.accumulate(np.where(closing, index, n)[::-1])[::-1]
        inside |= (last_open >= offsets[:-1][row]) & (last_open > last_close) & (next_close < offsets[1:][row])
    amp = np.where(data == 38, index, -1)
    last_amp = np.maximum.accumulate(amp)
    other = np.cumsum(~alnum)
    semi = data == 59
    entity = semi & (last_amp >= offsets[:-1][row]) & (index - last_amp > 1)
    entity &= (other - 1 - other[np.maximum(last_amp, 0)]) == 0

    slash = data == 47
    next_slash, last_slash = np.r_[slash[1:], False], np.r_[False, slash[:-1]]
    single = slash & before & after
    double = slash & before & next_slash & np.r_[after[1:], False]
    double_end = np.r_[False, double[:-1]] & last_slash

    word = np.where(space, -1, index)
    previous = np.r_[-1, np.maximum.accumulate(word)[:-1]]
    following = np.where(space, n, index)
    following = np.r_[np.minimum.accumulate(following[::-1])[::-1][1:], n]
    comma = (data == 44) & (previous >= offsets[:-1][row]) & (following < offsets[1:][row])
    comma &= (data[np.maximum(previous, 0)] == 34) & (data[np.minimum(following, n - 1)] == 34) & whole[row]

    divides = (semi & ~entity) | (data == 124) | (data == 9) | (data == 10) | (data == 13)
    divides |= single | double | double_end | comma
    for unit in ("；", "｜", "¦"):
        here = _sequence(data, unit)
        for k in range(min(n, len(unit.encode()))):
            divides[k:] |= here[: n - k]
    divides |= _numbered(data, row, index == offsets[:-1][row], space)
    divides &= ~inside

    # each run of bytes between delimiters or row borders is one raw value
    keep = ~divides
    start = keep & (np.r_[True, divides[:-1]] | (index == offsets[:-1][row]))
    end = keep & (np.r_[divides[1:], True] | (index + 1 == offsets[1:][row]))
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    filled = np.r_[0, np.cumsum(~space)]
    full = filled[e] > filled[s]
    s, e = s[full], e[full]
    return s + lo, e + lo, row[s]


def clean(value: str) -> str:
    """A value without surrounding space, list mark and enclosing quotes; all else as written."""
    value = MARK.sub("", value.strip()).strip()
    while len(value) > 1 and PAIRS.get(value[0]) == value[-1] and value[-1] not in value[1:-1]:
        value = value[1:-1].strip()
    return value


def split_batch(texts: pa.Array) -> pa.ListArray:
    """The values of each text as a list; null and blank texts give empty lists."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    s, e, row = divide(data, offsets)
    body = raw.to_pybytes() if raw is not None else b""
    values = [clean(body[a:b].decode()) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    filled = np.fromiter((bool(v) for v in values), bool, len(values))
    counts = np.bincount(row[filled], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    children = pa.array([v for v in values if v], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), children)


def split_packed(df: DataFrame, text: str, keys: list[str], least: int = 1) -> DataFrame:
    """One row per value of `text`: the key columns, `val_pos` (from 0, per text) and `val`.

    Only texts with at least `least` values come out. Rows with a null text give nothing. Further columns of df are
    ignored, so their names cannot clash; a key named like an output column is refused.
    """
    if {"val_pos", "val"} & set(keys):
        raise ValueError("a key column may not be named val_pos or val")
    chosen = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    if least > 1:
        chosen = chosen.where(F.col("__text").rlike(MAY_DIVIDE))
    kinds = dict(chosen.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", val_pos int, val string"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = split_batch(batch.column(len(keys)))
        sizes = np.diff(lists.offsets.to_numpy())
        many = sizes >= least
        parent = np.repeat(np.arange(len(sizes)), sizes)
        position = np.arange(len(parent)) - lists.offsets.to_numpy()[:-1][parent]
        taken = pa.array(np.flatnonzero(many[parent]))
        where = pa.array(parent).take(taken)
        columns = [batch.column(i).take(where) for i in range(len(keys))]
        columns += [pa.array(position.astype(np.int32)).take(taken), lists.values.take(taken)]
        return pa.RecordBatch.from_arrays(columns, [*keys, "val_pos", "val"])

    return arrow_map(chosen, kernel, schema)
