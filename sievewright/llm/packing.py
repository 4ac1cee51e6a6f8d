"""Texts laid into containers of permitted capacities with little unused space: variable-capacity best-fit.

Sizes are tokens of a public tokenizer, counted next to the data; only ids and sizes are shuffled. Items are spread by
hash over groups of about GROUP_ITEMS, each packed by itself, so no task holds an unbounded group and the unused space
that grouping costs is at most one container a group. Within a group items go largest first into the container with
the least room that takes them. If none does, a container is opened, and its capacity is chosen then: every permitted one
is tried with the items still to come, and the one that they leave least unused is taken. At the end each container is
downsized to the smallest permitted capacity that holds its contents. The layout is compared with those that open one
capacity only, and the best is kept.

Defined cases: a text of no tokens (null, empty) takes no container; a text longer than the largest capacity is
divided into full pieces and a rest, every other text stays whole; equal sizes are taken in the order of their ids;
repeated texts are items of their own; an empty table gives no rows; capacities that are null or below 1 are refused.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import arrow_map

GROUP_ITEMS = 20_000
#: More permitted capacities than this are refused: they are a list that people write.
MOST_CAPACITIES = 1000
#: Where the vocabulary file lies, and the pattern that divides text before merging (parameters, with public values).
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(key, `n_tokens`) of every text; null counts as empty. Further columns of df are ignored."""
    kind = dict(df.dtypes)[key]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path, pattern).encode_ordinary
        sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["k", "n_tokens"])

    return arrow_map(df.select(F.col(key).alias("k"), F.col(text).alias("t")), kernel, f"k {kind}, n_tokens long").withColumnRenamed("k", key)


def _fill(sizes: list[int], opening: list[int]) -> tuple[list[int], list[int]]:
    """Best fit in the given order: the container of each item, and the contents of each container.

    opening[i] is the capacity that item i opens if no open container takes it.
    """
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    where, contents = [], []
    for size, capacity in zip(sizes, opening, strict=True):
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, box = room.pop(at)
        else:
            left, box = capacity, len(contents)
            contents.append(0)
        where.append(box)
        contents[box] += size
        if left > size:
            bisect.insort(room, (left - size, box))
    return where, contents


def _choices(sizes: list[int], allowed: list[int]) -> list[int]:
    """For each item, largest first, the capacity that a container opened by it should have: the one that is best filled
    by the item and the largest of the later items that fit, one after the other; of equal ones the largest."""
    rising = sizes[::-1]  # ascending, so that the items after place i are rising[: n - 1 - i]
    n = len(sizes)
    known: dict[tuple[int, int], int] = {}
    out = []
    for i, size in enumerate(sizes):
        # items of one size that have many smaller ones behind them choose alike
        key = (size, (n - 1 - i) // 64)
        if key not in known:
            best = None
            for capacity in allowed:
                if capacity < size:
                    continue
                room, end = capacity - size, n - 1 - i
                while room > 0 and end > 0:
                    end = min(end, bisect.bisect_right(rising, room, 0, end))
                    if end:
                        end -= 1
                        room -= rising[end]
                cost = room / capacity
                if best is None or cost <= best[0]:
                    best = (cost, capacity)
            known[key] = best[1]
        out.append(known[key])
    return out


def pack(sizes: np.ndarray, capacities: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Containers of items sorted largest first, and the capacity of each container after downsizing."""
    allowed = np.array(sorted(set(capacities)))
    least = allowed[np.searchsorted(allowed, sizes)]  # the smallest capacity that takes the item
    items = sizes.tolist()
    best = None
    for opening in (_choices(items, allowed.tolist()), *(np.maximum(least, capacity).tolist() for capacity in allowed.tolist())):
        where, contents = _fill(items, opening)
        fitted = allowed[np.searchsorted(allowed, contents)]
        if best is None or fitted.sum() < best[0]:
            best = (int(fitted.sum()), where, fitted)
    return np.array(best[1]), best[2]


def pack_texts(counts: DataFrame, key: str, capacities: list[int], label: str | None = None) -> DataFrame:
    """One row per item: key, `piece_no`, `token_start`, `token_end`, `container`, `slot_start` and `capacity`.

    counts holds key and `n_tokens`. `container` is unique over all groups.
    """
    if not capacities or any(c is None or c < 1 for c in capacities):
        raise ValueError("capacities must be positive")
    top = max(capacities)
    kind = dict(counts.dtypes)[key]
    groups = max(1, -(-counts.count() // GROUP_ITEMS))
    pieces = counts.where("n_tokens > 0").select(
        F.col(key).alias("k"), "n_tokens", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / top).cast("int"))).alias("piece_no")
    )
    pieces = pieces.select(
        "k", "piece_no", (F.col("piece_no") * top).cast("long").alias("token_start"), F.least(F.col("n_tokens"), (F.col("piece_no") + 1) * top).cast("long").alias("token_end")
    ).withColumn("grp", F.pmod(F.xxhash64("k", "piece_no"), F.lit(groups)))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        size = (pdf.token_end - pdf.token_start).to_numpy()
        order = np.lexsort((pdf.piece_no.to_numpy(), pdf.k.to_numpy(), -size))
        pdf, size = pdf.iloc[order], size[order]
        box, capacity = pack(size, capacities)
        by_box = np.argsort(box, kind="stable")
        ends = np.cumsum(size[by_box])
        first = np.r_[True, np.diff(box[by_box]) > 0]
        base = (ends - size[by_box])[first][np.cumsum(first) - 1]
        start = np.empty(len(size), np.int64)
        start[by_box] = ends - size[by_box] - base
        return pd.DataFrame({
            key: pdf.k.to_numpy(), "piece_no": pdf.piece_no.to_numpy(), "token_start": pdf.token_start.to_numpy(), "token_end": pdf.token_end.to_numpy(),
            "container": pdf.grp.to_numpy().astype(np.int64) * (1 << 32) + box, "slot_start": start, "capacity": capacity[box],
        })

    schema = f"`{key}` {kind}, piece_no int, token_start long, token_end long, container long, slot_start long, capacity long"
    return pieces.groupBy("grp").applyInPandas(group, schema)
