"""String similarities by their public definitions, for use inside Arrow kernels."""

from __future__ import annotations

import difflib


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character of b (bit-parallel)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & places.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insertion-deletion similarity, 0 to 100; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """ratio of the tokens in the order of the alphabet."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio of the shared tokens and the shared tokens with either rest; containment is 100, an empty side 0."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    gap = 1 if shared else 0
    with_left, with_right = len(shared) + gap + len(only_left), len(shared) + gap + len(only_right)
    distance = len(only_left) + len(only_right) - 2 * lcs_length(only_left, only_right)
    best = 100.0 - 100.0 * distance / (with_left + with_right)
    if shared:
        for whole in (with_left, with_right):
            best = max(best, 100.0 - 100.0 * (whole - len(shared)) / (len(shared) + whole))
    return best


def sequence_ratio(a: str, b: str) -> float:
    """Ratio of matching blocks of the standard library, its treatment of popular characters included."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def block_coverage(short: str, long: str) -> float:
    """Share of the shorter text that its longest block inside the longer one covers."""
    if not short:
        return 0.0
    return difflib.SequenceMatcher(None, short, long, autojunk=False).find_longest_match(0, len(short), 0, len(long)).size / len(short)
