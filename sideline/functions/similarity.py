"""Exact indel similarity for candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row of the table."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        total = len(x) + len(y)
        out.append(100.0 if total == 0 else 100.0 * (1.0 - (total - 2 * _common_subsequence(x, y)) / total))
    return pd.Series(out)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - indel distance / total length)."""
    return _ratio(a, b)
