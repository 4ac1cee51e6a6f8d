"""Sentence units for documents in any language and script.

The boundary rules are compiled into one finite transducer over a small alphabet of symbols (TABLE: state x symbol ->
next state, and whether a sentence begins before the symbol). Characters become symbols by lookup tables and local
tests over whole arrays: abbreviations, initials, ordinals, decimals and list numbers are recognised by hashes of the
tokens beside a full stop. The symbol stream of a slice of documents is cut into chunks; every chunk is run from all
states at once, which gives its state-transition function; the functions are composed by a parallel prefix scan, and
a second run from the now known states emits the boundaries. Long documents are therefore no sequential chain.

Defined cases: null, empty and blank texts have no sentence; a document without any closing mark is one sentence (per
paragraph); a heading on its own line is one unit with its number; an opening quotation mark without its end in a
paragraph counts as an ordinary character; offsets are those of the text as given, white space at the ends excluded;
texts of any length are read whole; repeated documents each come out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.unify import code_points
from sievewright.session import arrow_map

TOP = 0x110000
#: Abbreviations that do not end a sentence (fixed values; lower case, without the last full stop), by language.
NEVER = """
gov col rep sen capt lt maj sgt rev hon lic arq
dr mrs mr ms prof st fig figs vol vols sec secs pp pag ver approx eq eqs ref refs ed eds cf vs al e.g i.e resp incl est ca viz jr sr dept univ gen
vgl abb bzw tab nr bd hrsg evtl ggf sog usw.a z.b d.h u.a s.o
mme mmes mlle mm mgr dra sra sres srta sr srs profa drs pe eng exmo pág págs núm cap art tj m.in np por rys ok mgr inż hab
dott prof.ssa ing cfr pag sig
örn bkz haz çev yrd doç
mis gbr hlm tgl
проф рис см др т.е т.к ул им акад табл стр гг
डॉ मि मि.ग्रा कि.ग्रा श्री
د أ م
มก กก ซม มม พ.ศ ค.ศ ดร
"""
#: Abbreviations that end a sentence only before a capital letter.
MAYBE = "a.m p.m u.k u.s inc ltd co corp etc usw r ph.d b.sc m.sc plc gmbh"
#: Before a number these are abbreviations.
BEFORE_NUMBER = "no nos n nr num núm p pp s art ch chap sect fig sec vol"
#: Month names after an ordinal (languages that write ordinals with a full stop).
MONTHS = """
januar februar märz april mai juni juli august september oktober november dezember jänner
stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia
ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık
"""
#: Words before a number with which a Thai sentence may end.
THAI_REFERENCE = ("รูปที่", "ตารางที่", "ภาพที่")
#: A line that is neither numbered nor capitalised throughout is a heading only if it is this short (characters, words):
#: longer ones look like a line that was broken by its width. Numbered and capitalised headings may have any length.
PLAIN_CHARS, PLAIN_WORDS = 40, 5
CHUNK, SLICE = 64, 400_000

SYMBOLS = ("LOWER", "UPPER", "DIGIT", "TERM", "WEAK", "OPENQ", "CLOSEQ", "CLOSEB", "OPENB", "SPACE", "BREAK", "CTERM", "HIRA", "MID", "STERM", "RESET")
LOWER, UPPER, DIGIT, TERM, WEAK, OPENQ, CLOSEQ, CLOSEB, OPENB, SPACE, BREAK, CTERM, HIRA, MID, STERM, RESET = range(len(SYMBOLS))
STATES = ("N", "T", "W", "TS", "WS", "C", "CQ", "B", "qN", "qT", "qC")


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """next state and output (1: a sentence begins before this symbol) for every state and symbol."""
    at = {s: i for i, s in enumerate(STATES)}
    move = np.zeros((len(STATES), len(SYMBOLS)), np.uint8)
    emit = np.zeros((len(STATES), len(SYMBOLS)), bool)
    plain = {OPENQ: "qN", TERM: "T", WEAK: "W", CTERM: "C", BREAK: "B", STERM: "B"}

    def rule(state: str, symbols: tuple[int, ...] | range, to: str | None, begin: bool = False) -> None:
        for s in symbols:
            move[at[state], s] = at[to if to is not None else plain.get(s, "N")]
            emit[at[state], s] = begin

    every = range(len(SYMBOLS))
    for state in ("N", "T", "W", "TS", "WS", "C", "CQ", "B"):
        rule(state, every, None)
    for state, spaced in (("T", "TS"), ("W", "WS")):
        rule(state, (SPACE,), spaced)
        rule(state, (CLOSEQ, CLOSEB), state)
    rule("W", (WEAK,), "W")
    rule("TS", (SPACE,), "TS")
    rule("TS", (CLOSEQ, CLOSEB), "T")
    rule("TS", (UPPER, DIGIT, OPENQ, OPENB, HIRA), None, True)
    rule("WS", (SPACE,), "WS")
    rule("WS", (CLOSEQ, CLOSEB), "W")
    rule("WS", (UPPER, OPENQ, HIRA), None, True)
    for state in ("C", "CQ"):
        rule(state, (SPACE, CLOSEQ, CLOSEB), state)
        rule(state, (LOWER, UPPER, DIGIT, OPENQ, OPENB), None, True)
    rule("C", (HIRA,), None, True)
    rule("B", (SPACE, BREAK), "B")
    for s in every:
        if s not in (SPACE, BREAK, RESET):
            emit[at["B"], s] = True
    for state in ("qN", "qT", "qC"):
        rule(state, every, "qN")
        rule(state, (TERM, WEAK, STERM), "qT")
        rule(state, (CTERM,), "qC")
        rule(state, (BREAK,), "B")
    rule("qN", (CLOSEQ,), "N")
    rule("qT", (SPACE, CLOSEB), "qT")
    rule("qT", (CLOSEQ,), "W")
    rule("qC", (SPACE, CLOSEB), "qC")
    rule("qC", (CLOSEQ,), "CQ")
    move[:, RESET] = at["B"]
    emit[:, RESET] = False
    return move, emit


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Character classes from the character database."""
    lower = np.arange(TOP, dtype=np.int32)
    kind = np.full(TOP, MID, np.uint8)
    letter, space, cjk, digit, upper = (np.zeros(TOP, bool) for _ in range(5))
    for c in range(0x20000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] in "LM":
            letter[c] = True
            kind[c] = LOWER if cat == "Ll" or cat[0] == "M" else UPPER
            upper[c] = cat in ("Lu", "Lt")
            if ch.lower() != ch and len(ch.lower()) == 1:
                lower[c] = ord(ch.lower())
        elif cat == "Nd":
            digit[c] = True
            kind[c] = DIGIT
        if ch.isspace():
            space[c] = True
            kind[c] = SPACE
    for a, b in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)):
        cjk[a : b + 1] = True
    kind[0x3041:0x3097] = HIRA
    for ch in ".!?؟।":
        kind[ord(ch)] = TERM
    for ch in "。！？｡":
        kind[ord(ch)] = CTERM
    kind[ord("…")] = WEAK
    for ch in "«「『":
        kind[ord(ch)] = OPENQ
    for ch in "»」』”":
        kind[ord(ch)] = CLOSEQ
    for ch in ")]}）］】":
        kind[ord(ch)] = CLOSEB
    for ch in "([{（［【":
        kind[ord(ch)] = OPENB
    for ch in "¿¡":
        kind[ord(ch)] = UPPER
    thai = np.zeros(TOP, bool)
    for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)):
        thai[a : b + 1] = True
    return {"lower": lower, "kind": kind, "letter": letter, "space": space, "cjk": cjk, "digit": digit, "upper": upper, "thai": thai}


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _name(word: str) -> int:
    """Hash of a token, equal to that of the same characters anywhere in an array."""
    h, p = 0, 1
    for ch in word:
        h = (h + ord(ch) * p) % (1 << 64)
        p = p * int(_P) % (1 << 64)
    return h


@lru_cache(maxsize=1)
def lists() -> dict[str, np.ndarray]:
    make = lambda words: np.array(sorted({_name(w) for w in words}), np.uint64)
    return {
        "never": make(NEVER.split()), "maybe": make(MAYBE.split()), "number": make(BEFORE_NUMBER.split()), "months": make(MONTHS.split()),
        "thai": make(THAI_REFERENCE),
    }


def _in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def symbols(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The symbol of every character."""
    t, ls = tables(), lists()
    n = len(cp)
    index = np.arange(n)
    kind = t["kind"][cp].copy()
    letter, space, digit, thai = t["letter"][cp], t["space"][cp], t["digit"][cp], t["thai"][cp]
    first = np.r_[True, row[1:] != row[:-1]]
    last = np.r_[row[1:] != row[:-1], True]
    before = np.where(first, 10, np.r_[10, cp[:-1]])
    after = np.where(last, 10, np.r_[cp[1:], 10])
    word = letter | digit

    # hashes of all stretches, from prefix sums
    sums = np.r_[np.uint64(0), np.cumsum(t["lower"][cp].astype(np.uint64) * _powers(_P, n))]
    inverse = _powers(_PI, n + 1)
    # bounds of runs of letters (with inner full stops) around every character
    stop = cp == 46
    outside = np.where((letter | stop) & ~first, -1, index)
    token_start = np.maximum.accumulate(outside)  # the last place at or before i that is no letter or stop, or begins a row
    letters_start = np.maximum.accumulate(np.where(letter & ~first, -1, index))
    no_letter = np.where(letter, n, index)
    token_end = np.minimum.accumulate(no_letter[::-1])[::-1]
    row_end = np.where(last, index + 1, n)
    row_end = np.minimum.accumulate(row_end[::-1])[::-1]

    dots = np.flatnonzero(stop)
    if len(dots):
        prior = np.maximum(dots - 1, 0)
        a = token_start[prior]
        a = np.where(letter[a] | stop[a], a, a + 1)  # a row may begin with the token itself
        a = np.where(first[dots], dots, a)
        size = dots - a
        name = (sums[dots] - sums[a]) * inverse[a]
        b = letters_start[prior]
        b = np.minimum(np.where(letter[b], b, b + 1), dots)
        short_name = (sums[dots] - sums[b]) * inverse[b]  # the letters alone, where a space before them is missing
        nxt = after[dots]
        spaced = np.minimum(dots + 1, n - 1)
        # the first character after the spaces that follow
        filled = np.where(space, n, index)
        following = np.minimum.accumulate(filled[::-1])[::-1]
        f = following[spaced]
        has = (f < row_end[dots]) & ~last[dots]
        f = np.minimum(f, n - 1)
        next_digit = has & digit[f]
        f_end = np.minimum(token_end[f], row_end[dots])
        next_name = (sums[np.maximum(f_end, f)] - sums[f]) * inverse[f]
        month = has & letter[f] & _in(next_name, ls["months"])
        prev_digit = digit[prior] & ~first[dots]
        next_letter = t["letter"][nxt]
        single = (size == 1) & letter[prior] & ~first[dots] & ~t["cjk"][cp[prior]]
        never = (size > 0) & (_in(name, ls["never"]) | (dots - b > 1) & _in(short_name, ls["never"]))
        number = (size > 0) & next_digit & _in(name, ls["number"])
        maybe = (size > 0) & _in(name, ls["maybe"])
        many = (nxt == 46) | (before[dots] == 46)
        inner = (t["digit"][nxt] & prev_digit) | (next_letter & ~t["upper"][nxt] & ~t["cjk"][nxt] & (t["kind"][nxt] == LOWER)) | (t["digit"][nxt] & ~prev_digit)
        # a number at the start of a line, and ordinals before a month
        number_start = np.maximum.accumulate(np.where((digit | stop) & ~first, -1, index))[prior]
        number_start = np.where(digit[number_start], number_start, number_start + 1)
        number_start = np.minimum(number_start, n - 1)
        feed = np.maximum(number_start - 1, 0)
        blank = (before[number_start] == 10) & ((before[feed] == 10) | first[feed])  # after a blank line, or at the start
        listed = prev_digit & (blank | first[number_start]) & (dots - number_start < 6)
        thai_stop = thai[prior] & (size < 4)
        out = np.full(len(dots), TERM)
        glued = next_letter & (t["upper"][nxt]) & ((size > 1) | prev_digit | ~letter[prior])
        out = np.where(glued & ~never & ~maybe, STERM, out)
        out = np.where(maybe | many, WEAK, out)
        out = np.where((never | number | single | listed | (month & prev_digit) | thai_stop | (next_letter & ~glued & t["upper"][nxt])) & ~many, MID, out)
        out = np.where(inner & ~many, MID, out)
        kind[dots] = out

    marks = np.flatnonzero(((cp == 33) | (cp == 63)))
    if len(marks):
        nxt = after[marks]
        kind[marks] = np.where(t["upper"][nxt], STERM, np.where(t["letter"][nxt] & (t["kind"][nxt] == LOWER), MID, TERM))

    # quotation marks whose direction depends on what stands beside them
    quotes = np.flatnonzero((cp == 34) | (cp == 0x201C) | (cp == 0x201E))
    if len(quotes):
        p = before[quotes]
        opens = t["space"][p] | np.isin(t["kind"][p], (OPENB, OPENQ, MID)) & (p != 44) | first[quotes]
        opens = np.where(cp[quotes] == 0x201C, opens | t["cjk"][p], opens)
        opens |= cp[quotes] == 0x201E
        kind[quotes] = np.where(opens, OPENQ, CLOSEQ)
    # line breaks
    newline = (cp == 10) | (cp == 0x2028) | (cp == 0x2029) | (cp == 13)
    filled = np.where(space, -1, index)
    behind = np.maximum.accumulate(filled)
    ahead = np.minimum.accumulate(np.where(space, n, index)[::-1])[::-1]
    seen = np.r_[0, np.cumsum(newline & ~((cp == 13) & (after == 10)))]
    lines = np.flatnonzero(newline)
    if len(lines):
        left, right = behind[lines], np.minimum(ahead[lines], n)
        blank = seen[right] - seen[np.maximum(left, -1) + 1] > 1
        kind[lines[blank]] = BREAK
        # headings: a short line after a blank one, without a closing mark, before a line that begins a sentence
        single_line = lines[~blank]
        if len(single_line):
            kind[single_line[_headings(cp, kind, row, single_line, newline, behind, ahead, first, space, t)]] = BREAK
    # Thai: a space between letters, or after a numbered reference
    spots = np.flatnonzero(space & (kind == SPACE) & ~first & ~last & ~np.r_[False, space[:-1]])
    if len(spots) and thai.any():
        l, r = spots - 1, np.minimum(ahead[spots], n - 1)
        same = (row[l] == row[r]) & thai[r]
        between = same & thai[l]
        run = np.maximum.accumulate(np.where(digit, -1, index))
        d = run[l]  # the last character before the number
        dd = np.maximum(np.maximum.accumulate(np.where(space, -1, index))[np.maximum(d, 0)], 0)
        refs = np.zeros(len(spots), bool)
        numbered = same & digit[l]
        for ref in THAI_REFERENCE:
            k = len(ref)
            start = dd - k + 1
            ok = numbered & (start >= 0)
            s = np.maximum(start, 0)
            refs |= ok & ((sums[np.minimum(dd + 1, n)] - sums[s]) * inverse[s] == np.uint64(_name(ref)))
        kind[spots[between | refs]] = BREAK

    # an opening mark that is never closed in its paragraph does not open
    if (kind == OPENQ).any():
        para = np.cumsum(first | (kind == BREAK))
        total = int(para[-1]) + 1
        opened = np.bincount(para, kind == OPENQ, total)
        closed = np.bincount(para, kind == CLOSEQ, total)
        bad = (opened > closed)[para]
        kind[(kind == OPENQ) & bad] = MID
    kind[first] = np.where(kind[first] == BREAK, SPACE, kind[first])
    return kind


def _headings(cp, kind, row, breaks, newline, behind, ahead, first, space, t) -> np.ndarray:
    """Which single line breaks end a heading."""
    n = len(cp)
    index = np.arange(n)
    line_start = np.maximum.accumulate(np.where(first | np.r_[True, newline[:-1]], index, -1))[np.maximum(breaks - 1, 0)]
    line_start = np.minimum(np.maximum(line_start, 0), n - 1)
    size = breaks - line_start
    prev = np.maximum(line_start - 1, 0)
    opening = first[line_start] | (kind[prev] == BREAK) | first[prev] & space[prev]
    words = np.r_[0, np.cumsum(space & ~np.r_[False, space[:-1]])]
    few = (words[breaks] - words[line_start] < PLAIN_WORDS) & (size <= PLAIN_CHARS)
    # numbered: digits and full stops, a space, then a capital; capitalised: no word of four letters or more in small letters
    digit, letter, upper = t["digit"][cp], t["letter"][cp], t["upper"][cp]
    after_number = np.minimum.accumulate(np.where(digit | (cp == 46), n, index)[::-1])[::-1]
    numbered_end = np.minimum(after_number[line_start], n - 1)
    numbered = digit[line_start] & space[numbered_end] & upper[np.minimum(numbered_end + 1, n - 1)]
    begins = letter & ~np.r_[False, letter[:-1]]
    long_word = np.zeros(n, bool)
    if n > 3:
        long_word[: n - 3] = begins[: n - 3] & letter[1 : n - 2] & letter[2 : n - 1] & letter[3:]
    small = np.r_[0, np.cumsum(long_word & ~upper)]
    many = np.r_[0, np.cumsum(long_word & upper)]
    capitalised = (small[breaks] == small[line_start]) & (many[breaks] - many[line_start] > 1)
    tail = np.maximum(behind[breaks], 0)
    unclosed = ~np.isin(kind[tail], (TERM, WEAK, STERM, CTERM, CLOSEQ)) & ~np.isin(cp[tail], np.array([44, 58, 59, 0x3001, 0xFF0C]))
    nxt = np.minimum(ahead[breaks], n - 1)
    starts = np.isin(kind[nxt], (UPPER, OPENQ, HIRA, DIGIT)) & (row[nxt] == row[breaks])
    head = np.isin(kind[line_start], (UPPER, DIGIT, HIRA))
    mids = np.r_[0, np.cumsum((cp == 44) | (cp == 0x3001) | (cp == 0xFF0C))]
    return opening & (size > 0) & (few | numbered | capitalised) & unclosed & starts & head & (mids[breaks] == mids[line_start]) & ~t["thai"][cp[line_start]]


def run_transducer(stream: np.ndarray) -> np.ndarray:
    """Outputs of the transducer for a symbol stream, chunk by chunk in parallel."""
    move, emit = transducer()
    q = len(STATES)
    chunks = -(-len(stream) // CHUNK)
    padded = np.full(chunks * CHUNK, SPACE, np.uint8)
    padded[: len(stream)] = stream
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat = move.ravel()
    wide = len(SYMBOLS)
    # transition function of every chunk: the state reached from each state
    reach = np.broadcast_to(np.arange(q, dtype=np.uint8), (chunks, q)).copy()
    for step in grid:
        reach = flat[reach.astype(np.int16) * wide + step[:, None]]
    # inclusive prefix scan by composition
    span = 1
    while span < chunks:
        later = np.take_along_axis(reach[span:], reach[:-span].astype(np.intp), 1)
        reach = np.concatenate([reach[:span], later])
        span *= 2
    start = STATES.index("B")
    state = np.r_[np.uint8(start), reach[:-1, start]]
    out = np.zeros((CHUNK, chunks), bool)
    outputs = emit.ravel()
    for k, step in enumerate(grid):
        place = state.astype(np.int16) * wide + step
        out[k] = outputs[place]
        state = flat[place]
    return out.T.ravel()[: len(stream)]


def split(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (positions in cp) and rows of all sentences of a slice."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = tables()
    kind = symbols(cp, row)
    first = np.r_[True, row[1:] != row[:-1]]
    word = (t["letter"] | t["digit"])[cp]
    # of a run of word characters only the first counts, except in scripts without spaces, where kana matter one by one
    inner = word & np.r_[False, word[:-1]] & ~first
    keep = np.flatnonzero(~inner)
    stream, place = kind[keep], keep
    # a reset before the first symbol of every row
    heads = np.flatnonzero(first[keep])
    stream = np.insert(stream, heads, RESET)
    place = np.insert(place, heads, place[heads])
    begins = place[run_transducer(stream)]
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = row[begins]
    space = t["space"][cp]
    behind = np.maximum.accumulate(np.where(space, -1, np.arange(len(cp))))
    row_last = np.r_[np.flatnonzero(first)[1:], len(cp)] - 1
    ordinal = np.cumsum(first) - 1
    limit = np.r_[begins[1:] - 1, 0]
    final = np.r_[rows[1:] != rows[:-1], True]
    limit = np.where(final, row_last[ordinal[begins]], limit)
    return begins, behind[limit] + 1, rows


def sentence_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts of a column: row, number in its text, first and last character (end exclusive) of every sentence."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.diff(np.frombuffer(texts.cast(pa.large_string()).fill_null("").buffers()[1], np.int64)[: len(texts) + 1]) if len(texts) else np.zeros(0, int)
    group = np.cumsum(sizes) // SLICE
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    parts: list[tuple[np.ndarray, ...]] = []
    for a, b in zip(borders, borders[1:], strict=False):
        if a == b:
            continue
        cp, row = code_points(texts.slice(a, b - a))
        s, e, r = split(cp, row)
        origin = np.searchsorted(row, np.arange(b - a))
        number = np.arange(len(r)) - np.searchsorted(r, r)
        parts.append((r + a, number, s - origin[r], e - origin[r]))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: key, `sent_no` from 0, `char_start`, `char_end`. Further columns of df are ignored."""
    kind = dict(df.dtypes)[key]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        r, k, s, e = sentence_offsets(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(r.astype(np.int64))), *[pa.array(x.astype(np.int32)) for x in (k, s, e)]], ["k", "sent_no", "char_start", "char_end"]
        )

    chosen = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return arrow_map(chosen, kernel, f"k {kind}, sent_no int, char_start int, char_end int").withColumnRenamed("k", key)
