"""Numeric column helpers. Missing is always null here, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sums come back in any order on a cluster, so their last bits vary. Thresholds
# are therefore decided as if the value were rounded to nine places; a rerun
# then cannot flip a label. Comparing with half a unit of slack does the same
# as rounding, without its cost.
SLACK = 5e-10


def as_double(c: Column) -> Column:
    """Lenient cast: text that is no number, NaN included, becomes null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def number_or_zero(df: DataFrame, name: str) -> Column:
    """Numeric value of a column, 0 where it is missing, unreadable or not in the schema."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(as_double(F.col(name)), F.lit(0.0))


def number_or_null(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return as_double(F.col(name))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null unless |b| is clearly non-zero."""
    return F.when(F.abs(b) > 1e-9, a / b)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (plain least/greatest would drop it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def floor_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def finite_or_zero(c: Column) -> Column:
    """Model input cleaning: null, NaN and the infinities become 0."""
    # NaN sorts above infinity, so one comparison rejects all four.
    return F.when(F.abs(c) < F.lit(float("inf")), c).otherwise(0.0)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def above(c: Column, limit: float) -> Column:
    return c >= limit + SLACK


def at_least(c: Column, limit: float) -> Column:
    return c >= limit - SLACK


def below(c: Column, limit: float) -> Column:
    return c < limit - SLACK


def at_most(c: Column, limit: float) -> Column:
    return c < limit + SLACK


def row_std(values: Sequence[Column], fallback: float) -> Column:
    """Population std of the non-missing values in a row; fallback when fewer than two.

    The values are an array that is folded twice. Written out, the mean would stand in every term of the squares, and a row's code
    would be longer than what the JVM compiles.
    """
    finite = F.filter(F.array(*values), lambda v: F.abs(v) < F.lit(float("inf")))

    def deviation(kept: Column) -> Column:
        n = F.size(kept)
        mean = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v, lambda a: a / n)
        squares = F.transform(F.array(mean), lambda m: F.aggregate(kept, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
        return F.when(n >= 2, F.sqrt(squares[0] / n)).otherwise(F.lit(float(fallback)))

    return F.transform(F.array(finite), deviation)[0]


def points_cell(c: Column) -> Column:
    """Captured points cell: a dash is null, a plain number is a double, anything else null.

    Use :func:`is_points_cell` to tell a dash from an unreadable cell.
    """
    return F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("double"))


def is_points_cell(c: Column) -> Column:
    return c.rlike(r"^(?:[–—-]|-?\d+(?:\.\d+)?)$")
