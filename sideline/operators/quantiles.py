"""Exact medians by distributed selection: nothing is sorted, gathered or shuffled by group."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 200  # quantiles of a bracket that one pass looks at
SMALL = 10_000  # rows of a bracket that are read off value by value
SKETCH = 10_000  # the sketch's rank error is at most a share of 1 / SKETCH


@dataclass
class _Bracket:
    """Where a group's middle ranks lie: rows of the group, the values that enclose them, and the slack of the next cut."""

    n: int = -1
    low: float = float("-inf")
    high: float = float("inf")
    slack: int = 1
    outer: tuple[float, float] = (float("-inf"), float("inf"))  # the last bracket known to hold the middle

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n + 1) // 2, self.n // 2 + 1

    def narrow(self, quantiles: list[float], below: int, inside: int) -> None:
        """Cut to the quantiles around the middle; ``below`` rows lie under the bracket and ``inside`` rows in it."""
        first, last = (min(1.0, max(0.0, (r - below) / inside)) for r in self.ranks)
        i, j = int(first * STEPS) - self.slack, int(last * STEPS) + 1 + self.slack
        self.outer = (self.low, self.high)
        self.low, self.high = quantiles[i] if i >= 0 else self.low, quantiles[j] if j <= STEPS else self.high


def _within(value: Column, group: Column, brackets: Mapping[object, _Bracket], test) -> Column:
    """A test of the value against its own group's bracket."""
    out = F.lit(False)
    for name, b in brackets.items():
        out = F.when(group.eqNullSafe(F.lit(name)), test(value, b)).otherwise(out)
    return out


def exact_medians(df: DataFrame, value: str, group: str | None = None) -> dict[object, float | None]:
    """Median of ``value`` per group, exact for groups of any size; groups are few (model names, or one for all rows).

    Every pass is one aggregate that combines before its shuffle: for each group's bracket it counts the rows below and inside
    and takes ``STEPS`` quantiles of those inside. The bracket is cut to the quantiles around the middle ranks, some hundredth of
    it, until at most ``SMALL`` rows or one value are left; those are counted value by value. A cut that misses the middle (a sketch is only
    approximate) is taken back and tried with twice the slack, so a miss costs a pass and never the result. ``df`` is read in
    every pass: store it first if it is costly. Nulls do not count; a group of nulls only is null.
    """
    g = F.col(group) if group else F.lit(None).cast("string")
    data = df.select(g.alias("g"), F.col(value).cast("double").alias("v"))
    open_: dict[object, _Bracket] = {}
    out: dict[object, float | None] = {}
    for r in data.groupBy("g").agg(F.count("v").alias("n")).collect():
        out[r["g"]] = None
        if r["n"]:
            open_[r["g"]] = _Bracket(r["n"])
    while open_:
        inside = _within(F.col("v"), F.col("g"), open_, lambda v, b: (v >= b.low) & (v <= b.high))
        below = _within(F.col("v"), F.col("g"), open_, lambda v, b: v < b.low)
        kept = F.when(inside, F.col("v"))
        at = [i / STEPS for i in range(STEPS + 1)]
        seen = data.where(F.col("v").isNotNull()).groupBy("g").agg(F.count_if(below).alias("below"), F.count(kept).alias("inside"), F.percentile_approx(kept, at, SKETCH).alias("q"))
        done: dict[object, int] = {}
        for r in seen.collect():
            b = open_.get(r["g"])
            if b is None:
                continue
            if not r["below"] < b.ranks[0] or b.ranks[1] > r["below"] + r["inside"]:
                b.low, b.high = b.outer
                b.slack *= 2
            elif b.low == b.high:
                out[r["g"]] = b.low
                del open_[r["g"]]
            elif r["inside"] <= SMALL:
                done[r["g"]] = r["below"]
            else:
                before = (b.low, b.high)
                b.narrow(r["q"], r["below"], r["inside"])
                if (b.low, b.high) == before:  # few values with many rows each: reading them off is small too
                    done[r["g"]] = r["below"]
        if done:
            last = {name: open_.pop(name) for name in done}
            inside = _within(F.col("v"), F.col("g"), last, lambda v, b: (v >= b.low) & (v <= b.high))
            counts: dict[object, dict[float, int]] = {name: {} for name in last}
            for r in data.where(inside).groupBy("g", "v").count().collect():
                counts[r["g"]][r["v"]] = r["count"]
            for name, b in last.items():
                out[name] = _middle(counts[name], done[name], b.ranks)
    return out


def _middle(counts: Mapping[float, int], below: int, ranks: tuple[int, int]) -> float:
    """Mean of the values at two ranks, from the values of the bracket and their counts."""
    found, at = [], below
    for v in sorted(counts):
        at += counts[v]
        found += [v] * (sum(at >= r for r in ranks) - len(found))
        if len(found) == 2:
            break
    return sum(found) / 2
