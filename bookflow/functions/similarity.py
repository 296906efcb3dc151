"""Similarity of normalised titles, over distinct pairs in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by one machine word of bits for each string."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def windows(short: str, long: str) -> float:
    """The best indel ratio of `short` with a part of `long`: its windows of that length, and shorter heads and tails."""
    n, best = len(short), 0.0
    letters = set(short)
    for i in range(1, n):
        if long[i - 1] in letters:
            best = max(best, indel(short, long[:i]))
        if long[-i] in letters:
            best = max(best, indel(short, long[-i:]))
    for i in range(len(long) - n + 1):
        if best == 1.0:
            break
        if long[i + n - 1] in letters or long[i] in letters:
            best = max(best, indel(short, long[i : i + n]))
    return best


def partial(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    if len(a) == len(b):
        return max(windows(a, b), windows(b, a))
    return windows(*sorted((a, b), key=len))


def similarity(a: str, b: str) -> float:
    """The largest of: indel ratio, indel ratio of the sorted words, best partial ratio; 0 to 1."""
    words = lambda s: " ".join(sorted(s.split()))
    return max(indel(a, b), indel(words(a), words(b)), partial(a, b))


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
