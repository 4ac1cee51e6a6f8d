"""One consistent form for text that looks the same and differs in its characters.

An Arrow text column becomes one numpy array of code points. Lookup tables give every code point the start and length
of its expansion (compatibility decomposition, plain spaces, hyphens and signs, nothing for invisible characters); one
gather writes all expansions. Marks are put in canonical order and composed by pair lookup over the whole array. No
string method is called per row.

Two forms: `canonical` keeps look-alike letters of a word in one script as they are and resolves words that mix
scripts towards the script of their text; `skeleton` maps every look-alike letter to one prototype on both sides of a
comparison, whatever the word. Accents, figures (raised and lowered ones and fractions too), case and words stay, so real
differences stay.

Defined cases: null stays null; an empty text stays empty; spaces at the ends are dropped; line breaks stay; texts of
any length are processed whole; repeated rows are treated alike.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import arrow_map

TOP = 0x110000
#: Look-alike letters and their prototypes (fixed values): Cyrillic, Greek, Armenian and phonetic forms of Latin letters.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ɡ": "g", "ɑ": "a", "ƽ": "s", "ʏ": "y",
}
#: Signs that stand for one another (fixed values).
SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "⁃": "-", "‘": "'", "’": "'", "‛": "'", "ʼ": "'", "′": "'", "ʹ": "'", "＇": "'",
    "“": '"', "”": '"', "‟": '"', "″": '"', "‚": ",", "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "⁎": "*", "∗": "*", "•": "·", "∙": "·", "⋅": "·", "‧": "·",
}
#: Invisible characters (ranges, ends included).
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables, derived from the character database and the values above."""
    length = np.ones(TOP, np.uint8)
    start = np.arange(TOP, dtype=np.int32)
    extra: list[int] = []
    invisible = np.zeros(TOP, bool)
    for a, b in INVISIBLE:
        invisible[a : b + 1] = True
    signs = {ord(a): ord(b) for a, b in SIGNS.items()}

    def put(c: int, out: list[int]) -> None:
        length[c] = len(out)
        start[c] = TOP + len(extra)
        extra.extend(out)

    for c in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(c)
        if invisible[c]:
            length[c] = 0
            continue
        made_of = unicodedata.decomposition(ch)
        raised = made_of.startswith(("<super>", "<sub>", "<fraction>")) and any(unicodedata.normalize("NFKD", x).isdecimal() for x in ch) or made_of.startswith("<fraction>")
        # raised and lowered figures and fractions are other figures than the plain ones
        parts = unicodedata.normalize("NFKD", ch) if (made_of or 0xAC00 <= c < 0xD7A4) and not raised else ch
        out = [32 if chr(x).isspace() else signs.get(x, x) for x in map(ord, parts) if not invisible[x]]
        if out != [c]:
            put(c, out)
    length[0xE0000:0xE1000] = 0
    for c in (9, 11, 12, 0x1F):
        put(c, [32])
    put(13, [10])
    flat = np.r_[np.arange(TOP, dtype=np.int32), np.array(extra, np.int32)]

    order = np.zeros(TOP, np.uint8)
    pairs: dict[int, int] = {}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        order[c] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a * TOP + b] = c
    keys = np.array(sorted(pairs), np.int64)
    prototype = np.arange(TOP, dtype=np.int32)
    for a, b in LOOKALIKES.items():
        prototype[ord(a)] = ord(b)
    script = np.zeros(TOP, np.uint8)  # 1 Latin, 2 Cyrillic, 3 Greek, 4 Armenian
    for a, b, s in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC0, 0x24F, 1), (0x250, 0x2AF, 1), (0x1E00, 0x1EFF, 1), (0x400, 0x52F, 2), (0x370, 0x3FF, 3), (0x1F00, 0x1FFF, 3), (0x530, 0x58F, 4)):
        script[a : b + 1] = s
    back = np.arange(TOP, dtype=np.int32)  # Latin prototypes to Cyrillic letters
    for a, b in LOOKALIKES.items():
        if 0x400 <= ord(a) < 0x530:
            back[ord(b)] = ord(a)
    return {
        "length": length, "start": start, "flat": flat, "order": order, "keys": keys,
        "made": np.array([pairs[k] for k in keys.tolist()], np.int32), "prototype": prototype, "script": script, "back": back,
    }


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the row of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    cp = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.int32)
    heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    sizes = np.diff(heads[offsets - offsets[0]])
    return cp, np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def expand(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All expansions by one gather."""
    t = tables()
    size = t["length"][cp].astype(np.int64)
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    within = np.arange(n) - np.repeat(ends - size, size)
    return t["flat"][np.repeat(t["start"][cp].astype(np.int64), size) + within], np.repeat(row, size)


def reorder(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Marks in canonical order; only the runs that are out of order are sorted."""
    order = tables()["order"][cp]
    if len(cp) < 2 or not ((order[:-1] > order[1:]) & (order[1:] > 0) & (row[:-1] == row[1:])).any():
        return cp
    group = np.cumsum((order == 0) | np.r_[True, row[1:] != row[:-1]])
    wrong = np.unique(group[1:][(order[:-1] > order[1:]) & (order[1:] > 0) & (row[:-1] == row[1:])])
    at = np.flatnonzero(np.isin(group, wrong))
    out = cp.copy()
    out[at] = cp[at][np.lexsort((order[at], group[at]))]
    return out


def compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks joined to their letters, and Hangul letters to syllables, pair by pair over the whole array."""
    t = tables()
    while len(cp) > 1:
        a, b = cp[:-1].astype(np.int64), cp[1:].astype(np.int64)
        candidate = (t["order"][b] > 0) | ((b >= 0x1161) & (b < 0x11C3)) | (b == 0x3099) | (b == 0x309A) | ((b >= 0x0900) & (b < 0x0E00))
        candidate &= row[:-1] == row[1:]
        at = np.flatnonzero(candidate)
        if not len(at):
            break
        x, y = a[at], b[at]
        key = x * TOP + y
        place = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        made = np.where(t["keys"][place] == key, t["made"][place], -1).astype(np.int64)
        lv = (x >= 0x1100) & (x < 0x1113) & (y >= 0x1161) & (y < 0x1176)
        made = np.where(lv, 0xAC00 + ((x - 0x1100) * 21 + (y - 0x1161)) * 28, made)
        lvt = (x >= 0xAC00) & (x < 0xD7A4) & ((x - 0xAC00) % 28 == 0) & (y > 0x11A7) & (y < 0x11C3)
        made = np.where(lvt, x + (y - 0x11A7), made)
        good = made >= 0
        at, made = at[good], made[good]
        if not len(at):
            break
        first = np.r_[True, np.diff(at) > 1]
        # in a chain of adjacent pairs every second one is joined now, the rest in the next turn
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        chosen = run % 2 == 0
        at, made = at[chosen], made[chosen]
        cp = cp.copy()
        cp[at] = made
        keep = np.ones(len(cp), bool)
        keep[at + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def resolve(cp: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Look-alike letters of words that mix scripts, or that lie alone in a text of another script, brought to the text's script."""
    t = tables()
    script = t["script"][cp]
    if not (script > 1).any():
        return cp
    latin = np.bincount(row, script == 1, rows)
    cyrillic = np.bincount(row, script == 2, rows)
    letter = (script > 0) | (t["order"][cp] > 0)
    begin = letter & np.r_[True, ~letter[:-1] | (row[1:] != row[:-1])]
    word = np.cumsum(begin) - 1
    n = int(word[-1]) + 1 if len(word) else 0
    if not n:
        return cp
    w = np.maximum(word, 0)
    alike = (t["prototype"][cp] != cp) & letter
    other = np.bincount(w, letter & (script > 1) & ~alike, n) > 0  # letters that have no Latin look-alike
    proper = np.bincount(w, letter & (script == 1) & (t["back"][cp] == cp), n) > 0
    mainly_latin = latin >= cyrillic
    to_latin = alike & (mainly_latin[row] & ~other[w])
    to_cyrillic = letter & (script == 1) & (t["back"][cp] != cp) & ~mainly_latin[row] & other[w] & ~proper[w]
    out = np.where(to_latin, t["prototype"][cp], cp)
    return np.where(to_cyrillic, t["back"][cp], out).astype(np.int32)


def _strings(cp: np.ndarray, row: np.ndarray, rows: int, valid: np.ndarray) -> pa.Array:
    """An Arrow column from code points, without spaces at the ends of its texts."""
    space = (cp == 32) | (cp == 10)
    for _ in range(2):  # once from the left, once from the right
        index = np.arange(len(cp))
        filled = np.maximum.accumulate(np.where(space, -1, index)) if len(cp) else index
        begin = np.searchsorted(row, np.arange(rows))
        edge = space & (filled < begin[row]) if len(cp) else space
        cp, row, space = cp[~edge][::-1], row[~edge][::-1], space[~edge][::-1]
        row = rows - 1 - row
    sizes = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    per = np.bincount(row, sizes, rows).astype(np.int64)
    body = cp.astype(np.int32).tobytes().decode("utf-32-le").encode()
    offsets = np.r_[0, np.cumsum(per)].astype(np.int64)
    mask = pa.array(valid).buffers()[1] if not valid.all() else None
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body), mask).cast(pa.string())


def unified(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The canonical form and the skeleton of every text of a column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = pc.fill_null(pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring_regex(texts, "[\\x00-\\x09\\x0b-\\x1f\\x7f]"))), True)
    same = pc.utf8_trim(texts, " \n").cast(pa.string())
    rest = pc.indices_nonzero(pc.invert(plain))
    if not len(rest):
        return same, same
    canonical, skeleton = _unified(texts.take(rest))
    at = np.arange(len(texts))
    at[rest.to_numpy()] = len(texts) + np.arange(len(rest))  # texts taken as they are come first, unified ones after them
    return tuple(pa.concat_arrays([same, made]).take(pa.array(at)) for made in (canonical, skeleton))


def _unified(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    rows = len(texts)
    valid = np.asarray(texts.is_valid())
    cp, row = expand(*code_points(texts))
    cp = reorder(cp, row)
    skeleton = tables()["prototype"][cp]
    out = []
    for form in (cp, skeleton):
        made, where = compose(form, row)
        if form is cp:
            made = resolve(made, where, rows)
        out.append(_strings(made, where, rows, valid))
    return out[0], out[1]


def unify(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The key columns, `canonical` and `skeleton` of each row's text; further columns of df are ignored."""
    chosen = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    kinds = dict(chosen.dtypes)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        canonical, skeleton = unified(batch.column(len(keys)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], canonical, skeleton], [*[f"k{i}" for i in range(len(keys))], "canonical", "skeleton"])

    out = arrow_map(chosen, kernel, ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(keys))) + ", canonical string, skeleton string")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "canonical", "skeleton")
