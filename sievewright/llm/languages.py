"""Document languages: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions, STRIDE bytes a step (one embedding table per offset, summed),
and gives every position of STRIDE bytes a probability for each language. It is trained here in numpy by
backpropagation through time, on windows of labelled documents, some of them joined from two languages so that it
learns where a language changes. Position probabilities are pooled over sentences and over the document.

Fitting begins on a bounded set (PER_LANGUAGE documents of each language, STEPS batches) and then goes over all windows
of all labelled documents once: shards of them, set apart by hash, are trained on the executors, and the networks are
averaged. Every text is read whole.

Defined cases: null, blank and N/A texts have no language; a text without any whole sentence is judged as one piece;
trailing keywords, imprints and identifiers are not sentences; equal probabilities go to the language first in the
alphabet; repeated texts get the same answer; an empty training table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import sentences as sent
from sievewright.llm.truncated import closed, trimmed
from sievewright.session import arrow_map, shared_dir

STRIDE, HIDDEN = 6, 24
PER_LANGUAGE, STEPS, BATCH, WINDOW = 160, 420, 64, 40
#: The pass over all documents: bytes of a shard, windows a step, rate of the first step, shards averaged in one task.
SHARD, WIDE, RATE, TOGETHER = 6_000_000, 256, 0.0005, 32
#: Texts whose scores are held at once.
TEXTS = 2048
#: A sentence in another language than the text's main one needs this mean gain of log-probability per position.
MARGIN = 0.35
#: ... and this gain in all, so that a few bytes of a name do not make a language; a sentence may be as short as it likes.
LEAST_GAIN = 2.0
_BLANK = ("", "n/a", "na", "none", "null")
_JOIN = re.compile(r"(?<=[.!?。！？।؟»”\"])(\s+)[/|—–\-](?=\s)")


_ROOM: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array with whatever it held last: memory that is new to a process costs more than what is computed in it."""
    size = int(np.prod(shape))
    if name not in _ROOM or _ROOM[name].size < size or _ROOM[name].dtype != kind:
        _ROOM[name] = np.empty(size, kind)
    return _ROOM[name][:size].reshape(shape)


class Network:
    """Parameters and passes of the network."""

    def __init__(self, labels: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.25, (STRIDE, 256, 3 * h)).astype(np.float32)
            self.p[f"U{d}"] = (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(3 * h, np.float32)
            self.p[f"c{d}"] = np.zeros(h, np.float32)
        self.p["W"] = rng.normal(0, 0.2, (2 * h, len(labels))).astype(np.float32)
        self.p["o"] = np.zeros(len(labels), np.float32)

    @np.errstate(over="ignore")  # 1 / inf is the limit
    def sweep(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions (time, batch, 2 HIDDEN) for x (time, batch, STRIDE). The directions advance together,
        the second one from the end; keep collects what backpropagation needs."""
        steps, batch, _ = x.shape
        h, kind = HIDDEN, self.p["W"].dtype
        sign = np.repeat(np.array([-1, -1, 1], kind), h)  # the sigmoid of a is 1 / (1 + exp(-a))
        e = [_room(f"E{d}", (STRIDE, 257, 3 * h), kind) for d in "fb"]
        for d, table in zip("fb", e, strict=True):
            np.multiply(self.p[f"E{d}"], sign, table[:, :256])
            table[0, :256] += self.p[f"b{d}"] * sign
            table[0, 256] = np.repeat(np.array([-1e4, 0, 0], kind), h)  # a position beyond the text keeps the state
        u = self._gates() * sign[::h, None, None, None]
        c = np.stack([self.p["cf"], self.p["cb"]])[:, None]
        places = np.ascontiguousarray(x.transpose(0, 2, 1)).astype(np.intp)
        places[:, 0][~mask] = 256
        state = np.zeros((2, batch, h), kind)
        states = _room("states", (steps, batch, 2 * h), kind)
        rows, more = np.empty((2, batch, 3 * h), kind), np.empty((batch, 3 * h), kind)
        many = 1 if keep is None else steps
        held = _room("gates", (many, 3, 2, batch, h), kind), _room("v", (many, 3, 2, batch, h), kind)
        for t in range(steps):
            gates, v = (a[t % many] for a in held)
            for k, at in enumerate((t, steps - 1 - t)):
                row, place = rows[k], places[at]
                e[k][0].take(place[0], 0, row, "clip")
                for i in range(1, STRIDE):
                    e[k][i].take(place[i], 0, more, "clip")
                    row += more
            np.copyto(gates, rows.reshape(2, batch, 3, h).transpose(2, 0, 1, 3))
            np.matmul(state, u, v)
            g, n = gates[:2], gates[2]
            g += v[:2]
            np.exp(g, g)
            g += 1
            np.divide(1, g, g)
            v[2] += c
            n += g[1] * v[2]
            n *= -2  # tanh(n) is 2 / (1 + exp(-2 n)) - 1
            np.exp(n, n)
            n += 1
            np.divide(2, n, n)
            n -= 1
            step = state - n
            step *= g[0]
            step += n
            if keep is not None:
                keep.append((state, gates, v[2]))
            state = step
            states[t, :, :h], states[steps - 1 - t, :, h:] = state
        return states

    def _gates(self) -> np.ndarray:
        """The weights between states: gate, direction, HIDDEN, HIDDEN."""
        return np.stack([np.stack(np.split(self.p[f"U{d}"], 3, 1)) for d in "fb"], 1)

    def _normed(self, both: np.ndarray) -> np.ndarray:
        """Log-probabilities of states: language, position."""
        z = self.p["W"].T @ both.reshape(-1, 2 * HIDDEN).T
        z += self.p["o"][:, None]
        z -= z.max(0)
        z -= np.log(np.exp(z).sum(0))
        return z

    def log_probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self._normed(self.sweep(x, mask)).T).reshape(*mask.shape, -1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = HIDDEN
        steps, batch = mask.shape
        kept: list = []
        both = self.sweep(x, mask, kept)
        prob = np.exp(self._normed(both))
        n = max(1, mask.sum())
        place, flat_y = np.arange(y.size), y.ravel()
        loss = float(-(np.log(prob[flat_y, place] + 1e-9) * mask.ravel()).sum() / n)
        prob[flat_y, place] -= 1
        prob *= (mask / n).ravel().astype(prob.dtype)
        grad = {"W": both.reshape(-1, 2 * h).T @ prob.T, "o": prob.sum(1)}
        part = (prob.T @ self.p["W"].T).reshape(steps, batch, 2 * h)
        u = self._gates()
        back = np.ascontiguousarray(u.transpose(0, 1, 3, 2))
        # what comes to the inputs and to the candidates' share of the states, at every position
        rows, shares = _room("rows", (steps, batch, 2, 3, h), u.dtype), _room("shares", (steps, batch, 2, h), u.dtype)
        ga, dv = _room("ga", (3, 2, batch, h), u.dtype), _room("dv", (3, 2, batch, h), u.dtype)
        carry, other = np.zeros((2, batch, h), u.dtype), np.empty((2, batch, h), u.dtype)
        for t in range(steps - 1, -1, -1):
            state, (z, r, cand), v = kept.pop()
            carry[0] += part[t, :, :h]
            carry[1] += part[steps - 1 - t, :, h:]
            np.subtract(1, z, other)
            np.multiply(carry, other, ga[2])
            np.subtract(state, cand, ga[0])
            ga[0] *= z
            ga[0] *= ga[2]
            np.multiply(cand, cand, other)
            np.subtract(1, other, other)
            ga[2] *= other
            np.multiply(ga[2], v, ga[1])
            ga[1] *= r
            np.subtract(1, r, other)
            ga[1] *= other
            rows[t, :, 0] = ga[:, 0].transpose(1, 0, 2)
            rows[steps - 1 - t, :, 1] = ga[:, 1].transpose(1, 0, 2)
            ga[2] *= r
            shares[t, :, 0], shares[steps - 1 - t, :, 1] = ga[2]
            np.matmul(ga, back, dv)
            carry *= z
            for more in dv:
                carry += more
        flat, shares = rows.reshape(steps, batch, 6 * h), shares.reshape(steps, batch, 2 * h)
        for k, d in enumerate("fb"):
            past, now = (slice(None, -1), slice(1, None)) if d == "f" else (slice(1, None), slice(None, -1))
            held = both[past, :, k * h : k * h + h].reshape(-1, h).T
            to_gates, to_share = flat[now, :, k * 3 * h : k * 3 * h + 2 * h], shares[now, :, k * h : k * h + h]
            grad[f"U{d}"] = np.concatenate([held @ to_gates.reshape(-1, 2 * h), held @ to_share.reshape(-1, h)], 1)
        gc = shares.sum((0, 1)).reshape(2, h)
        rows = rows.reshape(-1, 6 * h)
        used = np.flatnonzero(mask)  # nothing comes to the others
        ge, ones = np.zeros((2, STRIDE, 256, 3 * h), u.dtype), np.ones(len(used), u.dtype)
        sorted_rows = _room("sorted", (len(used), 6 * h), u.dtype)
        for k in range(STRIDE):
            byte = x[..., k].ravel()[used]
            np.take(rows, used[np.argsort(byte, kind="stable")], 0, sorted_rows, "clip")
            counts, at = np.bincount(byte, minlength=256).tolist(), 0
            for value, count in enumerate(counts):
                if count:
                    ge[:, k, value] = (ones[:count] @ sorted_rows[at : at + count]).reshape(2, -1)
                    at += count
        gb = (np.ones(len(rows), u.dtype) @ rows).reshape(2, -1)
        for k, d in enumerate("fb"):
            grad[f"c{d}"], grad[f"b{d}"], grad[f"E{d}"] = gc[k], gb[k], ge[k]
        return loss, grad


def _bytes(text: str) -> bytes:
    """The bytes the network reads: without regard to case where that keeps every byte in its place."""
    low, raw = text.lower().encode(), text.encode()
    return low if len(low) == len(raw) else raw


def _steps(raw: bytes) -> np.ndarray:
    """Bytes as rows of STRIDE, padded with zeros."""
    n = max(1, -(-len(raw) // STRIDE))
    out = np.zeros(n * STRIDE, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, STRIDE)


def _pieces(text: str) -> list[bytes]:
    """Windows of a training text."""
    raw = _bytes(text)
    size = WINDOW * STRIDE
    return [raw[i : i + size] for i in range(0, max(1, len(raw) - size // 2), size)]


def _update(net: Network, grad: dict[str, np.ndarray], first: dict, second: dict, step: int, rate: float) -> None:
    norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
    for k, g in grad.items():
        g *= min(1.0, 2.0 / (norm + 1e-9))
        first[k] *= 0.9
        first[k] += 0.1 * g
        second[k] *= 0.995
        g *= g
        g *= 0.005
        second[k] += g
        spread = second[k] / (1 - 0.995**step)
        np.sqrt(spread, spread)
        spread += 1e-7
        np.divide(first[k], spread, spread)
        spread *= rate / (1 - 0.9**step)
        net.p[k] -= spread


def go_over(net: Network, docs: list[tuple[str, str]], seed: int) -> int:
    """Train the network on every window of the documents once; the number of windows. Half of them exchange their ends
    with one another, so that texts whose language changes are among them and no byte is left out."""
    size, windows, sizes, langs = WINDOW * STRIDE, [], [], []
    for lang, text in sorted(docs):
        raw = _bytes(text)
        count = -(-len(raw) // size)
        windows.append(raw.ljust(count * size, b"\0"))
        sizes += [size] * (count - 1) + [len(raw) - size * (count - 1)] if count else []
        langs += [net.labels.index(lang)] * count
    inputs = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW, STRIDE)
    lengths, langs = -(-np.array(sizes, np.int64) // STRIDE), np.array(langs, np.int64)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    parts = np.array_split(rng.permutation(len(lengths)), -(-len(lengths) // WIDE)) if len(lengths) else []
    for step, part in enumerate(parts, 1):
        x = inputs[part].transpose(1, 0, 2)
        y = np.repeat(langs[None, part], WINDOW, 0)
        mask = np.arange(WINDOW)[:, None] < lengths[part]
        source = np.repeat(np.arange(len(part))[None], WINDOW, 0)
        for b in range(0, len(part) // 2 - 1, 2):
            at = int(rng.integers(4, WINDOW * 3 // 4))
            if mask[at - 1, b] and mask[at - 1, b + 1]:
                source[at:, b], source[at:, b + 1] = b + 1, b
        x, y, mask = (a[np.arange(WINDOW)[:, None], source] for a in (x, y, mask))
        _, grad = net.gradients(x, mask, y)
        _update(net, grad, first, second, step, RATE * min(1.0, step / 20) * (1 - 0.9 * step / len(parts)))
    _ROOM.clear()
    return len(lengths)


def fit_all(docs: DataFrame, text: str, lang: str) -> Network | None:
    """The network of all labelled documents; the same one however they are partitioned."""
    net = fit(sample(docs, text, lang))
    if net is None:
        return None
    known = labelled(docs, text, lang)
    shards = -(-known.agg(F.sum(F.octet_length("t"))).first()[0] // SHARD)
    labels, start = net.labels, net.p

    def packed(p: dict[str, np.ndarray]) -> bytes:
        return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()

    def train(group: pa.Table) -> pa.Table:
        own = Network(labels)
        own.p = {k: v.copy() for k, v in start.items()}
        shard = group.column("shard")[0].as_py()
        n = go_over(own, list(zip(group.column("lang").to_pylist(), group.column("t").to_pylist(), strict=True)), shard)
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([n], pa.int64()), "p": pa.array([packed(own.p)], pa.binary())})

    def mean(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("shard", "n", "p")), strict=True))
        n = sum(r[1] for r in rows)
        p = sum(np.frombuffer(r[2], np.float32).astype(float) * (r[1] / n) for r in rows)
        return pa.table({"shard": pa.array([rows[0][0]], pa.int64()), "n": pa.array([n], pa.int64()), "p": pa.array([p.astype(np.float32).tobytes()], pa.binary())})

    schema = "shard long, n long, p binary"
    apart = known.withColumn("shard", F.pmod(F.xxhash64("t"), F.lit(shards)))
    trained = apart.groupBy("shard").applyInArrow(train, schema)
    held = trained.groupBy(F.floor(F.col("shard") / TOGETHER).alias("g")).applyInArrow(mean, schema).toArrow()
    values = np.frombuffer(mean(held).column("p")[0].as_py(), np.float32)
    net.p, at = {}, 0
    for k in sorted(start):
        net.p[k] = values[at : at + start[k].size].reshape(start[k].shape).copy()
        at += start[k].size
    return net


def fit(samples: list[tuple[str, str]], seed: int = 11, steps: int = STEPS) -> Network | None:
    """Train on (language, text) pairs, in a fixed order for a fixed result."""
    by: dict[str, list[bytes]] = {}
    for lang, text in sorted(samples):
        by.setdefault(lang, []).extend(_pieces(text))
    labels = sorted(by)
    if not labels:
        return None
    net = Network(labels, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        x = np.zeros((WINDOW, BATCH, STRIDE), np.uint8)
        y = np.zeros((WINDOW, BATCH), np.int64)
        mask = np.zeros((WINDOW, BATCH), bool)
        for b in range(BATCH):
            at = 0
            parts = 1 if rng.random() < 0.5 else 2
            for k in range(parts):
                label = int(rng.integers(len(labels)))
                pool = by[labels[label]]
                raw = pool[int(rng.integers(len(pool)))]
                shift = int(rng.integers(0, max(1, len(raw) // 3))) if len(raw) > 60 else 0
                raw = raw[shift:]
                if parts == 2:
                    raw = raw[: int(rng.integers(24, WINDOW * STRIDE * 3 // 4))]
                piece = _steps(raw)[: WINDOW - at]
                x[at : at + len(piece), b], y[at : at + len(piece), b], mask[at : at + len(piece), b] = piece, label, True
                at += len(piece)
                if at >= WINDOW:
                    break
        _, grad = net.gradients(x, mask, y)
        _update(net, grad, first, second, step, 0.012 * min(1.0, step / 20) * (1 - 0.9 * step / steps))
    return net


def position_scores(net: Network, texts: list[str], block: int = 256) -> list[np.ndarray]:
    """Cumulative log-probabilities over the positions of every text (one row more than positions)."""
    encoded = [_steps(_bytes(t)) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(encoded[i]))
    out: list[np.ndarray] = [np.zeros((1, len(net.labels)))] * len(texts)
    at = 0
    while at < len(order):
        longest = len(encoded[order[min(len(order), at + block) - 1]])
        size = max(8, min(block, 120_000 // max(1, longest)))  # bounded memory for long texts
        group = order[at : at + size]
        at += len(group)
        longest = len(encoded[group[-1]])
        x = np.zeros((longest, len(group), STRIDE), np.uint8)
        mask = np.zeros((longest, len(group)), bool)
        for b, i in enumerate(group):
            x[: len(encoded[i]), b], mask[: len(encoded[i]), b] = encoded[i], True
        scores = net.log_probabilities(x, mask)
        sums = np.zeros((longest + 1, *scores.shape[1:]))
        np.cumsum(scores, 0, out=sums[1:])
        for b, i in enumerate(group):
            out[i] = sums[: len(encoded[i]) + 1, b].copy()
    _ROOM.clear()
    return out


Segment = tuple[int, int, str, float, bool]


def segments(net: Network, texts: list[str]) -> list[list[Segment]]:
    """For every text its stretches of one language: first and last character, language, confidence, whether it holds a whole sentence."""
    known: dict[str, list[Segment]] = dict.fromkeys(texts, [])  # each text is read once, beside others of its length
    order = sorted(known, key=len)
    for at in range(0, len(order), TEXTS):
        some = order[at : at + TEXTS]
        known.update(zip(some, _segments(net, some), strict=True))
    return [known[t] for t in texts]


def _segments(net: Network, texts: list[str]) -> list[list[Segment]]:
    scores = position_scores(net, texts)
    cut = [_JOIN.sub(lambda m: "\n" * (len(m[0])), t) for t in texts]
    row, _, first, last = sent.sentence_offsets(pa.array(cut, pa.string()))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
        spans[r].append((a, b))
    return [_judge(net, t, s, c) for t, s, c in zip(texts, spans, scores, strict=True)]


def _judge(net: Network, text: str, spans: list[tuple[int, int]], scores: np.ndarray) -> list[Segment]:
    if not spans:
        return []
    place = None
    if not text.isascii():
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.r_[0, np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))]
    main = int(scores[-1].argmax())
    out: list[list] = []
    bounds = np.array(spans) if place is None else place[np.array(spans)]
    starts = bounds[:, 0] // STRIDE
    stops = np.minimum(np.maximum(starts + 1, -(-bounds[:, 1] // STRIDE)), len(scores) - 1)
    starts = np.minimum(starts, stops - 1)
    totals = scores[stops] - scores[starts]
    bests = totals.argmax(1)
    at = np.arange(len(spans))
    sizes = stops - starts
    weak = totals[at, bests] - totals[:, main] < np.maximum(LEAST_GAIN, MARGIN * sizes)
    bests[weak] = main
    means = np.exp(totals[at, bests] / sizes)
    for k, ((a, b), best, mean, size) in enumerate(zip(spans, bests.tolist(), means.tolist(), sizes.tolist(), strict=True)):
        # the last piece is a whole sentence only if it is closed; keywords, imprints and cut ends are not
        whole = True
        if k + 1 == len(spans):
            piece = trimmed(text[a:b])
            whole = closed(piece) or bool(piece) and bool(sent.tables()["thai"][ord(piece[-1])])
        if out and out[-1][2] == net.labels[best]:
            n = out[-1][5]
            out[-1][1] = b
            out[-1][3] = (out[-1][3] * n + mean * size) / (n + size)
            out[-1][4] |= whole
            out[-1][5] += size
        else:
            out.append([a, b, net.labels[best], mean, whole, size])
    if not any(s[4] for s in out):  # no whole sentence: the piece of the main language, if any, stands for the text
        for s in out:
            s[4] = s[2] == net.labels[main]
    return [tuple(s[:5]) for s in out]


def labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """All documents with a label of two letters: lang, t."""
    return docs.select(F.lower(F.trim(lang)).alias("lang"), F.col(text).alias("t")).where(
        F.col("lang").rlike("^[a-z]{2}$") & ~F.col("lang").isin("xx", "na") & (F.length("t") > 40)
    )


def sample(docs: DataFrame, text: str, lang: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most about per_language documents of each two-letter label, by hash, the same whatever the partitioning."""
    known = labelled(docs, text, lang)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    picked = known.where(F.pmod(F.xxhash64("t"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    bound = 2 * per_language * len(counts)
    return sorted((r["lang"], r["t"]) for r in picked.orderBy(F.xxhash64("t"), "t").limit(bound).collect())


def fitted(spark: SparkSession, docs: DataFrame, text: str, lang: str) -> Network | None:
    """The network of all labelled documents, trained once: it is kept in the shared folder under the digest of what it depends on."""
    row = F.xxhash64("lang", "t")
    state = labelled(docs, text, lang).agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    if not state[0]:
        return None
    digest = hashlib.sha256(repr((tuple(state), STRIDE, HIDDEN, STEPS, BATCH, WINDOW, SHARD, WIDE, RATE)).encode()).hexdigest()[:24]
    if digest not in _KEPT:
        path = f"{shared_dir(spark)}/models/languages-{digest}"
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            held = np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["model"])))
            net = Network([str(x) for x in held["labels"]])
            net.p = {k: held[k] for k in net.p}
        else:
            net = fit_all(docs, text, lang)
            out = io.BytesIO()
            np.savez(out, labels=np.array(net.labels), **net.p)
            spark.createDataFrame([(bytearray(out.getvalue()),)], "model binary").write.mode("overwrite").parquet(path)
        _KEPT[digest] = net
    return _KEPT[digest]


_KEPT: dict[str, Network] = {}


def label_texts(df: DataFrame, keys: list[str], text: str, net: Network | None) -> DataFrame:
    """One row per text that is not null, blank or N/A: the key columns, `text`, `langs` (languages with a whole sentence,
    in the order of the alphabet) and `segments` (stretches of one language with their confidence). Further columns are ignored.
    """
    chosen = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).where(
        F.col("t").isNotNull() & ~F.lower(F.regexp_replace("t", r"^\s+|\s+$", "")).isin(*_BLANK)
    )
    kinds = dict(chosen.dtypes)
    part = pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    names = [*[f"k{i}" for i in range(len(keys))], "text", "langs", "segments"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if net is None:
            return None
        found = segments(net, batch.column(len(keys)).to_pylist())
        langs = pa.array([sorted({s[2] for s in row if s[4]}) for row in found], pa.list_(pa.string()))
        spans = pa.array([[dict(zip(("char_start", "char_end", "lang", "confidence"), s[:4], strict=True)) for s in row] for row in found], pa.list_(part))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], langs, spans], names)

    schema = "".join(f"k{i} {kinds[f'k{i}']}, " for i in range(len(keys)))
    schema += "text string, langs array<string>, segments array<struct<char_start:int,char_end:int,lang:string,confidence:double>>"
    out = arrow_map(chosen, kernel, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "text", "langs", "segments")
