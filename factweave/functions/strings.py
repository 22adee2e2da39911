"""String similarity that Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str, scale: float = 0.1, longest_prefix: int = 4) -> float:
    """Jaro similarity, raised by the share of a common start of up to four letters."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    for x, y in zip(a[:longest_prefix], b[:longest_prefix]):
        if x != y:
            break
        start += 1
    return jaro + start * scale * (1 - jaro)


def _batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def jaro_winkler_udf(a, b):
    return F.pandas_udf(_batch, "double")(a, b)
