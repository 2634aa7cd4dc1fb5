"""Plan-time schema work: alias resolution, defaults, uniqueness guards.

Alias resolution only looks at ``df.columns``; it starts no job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that exists in the schema, compared without case."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give every logical column its canonical name; the other candidates stay as they are.

    When the winning source is not the canonical name but a column of that name
    exists too, the existing one is dropped so that the name stays unambiguous.
    """
    renames = {}
    for target, candidates in aliases.items():
        found = first_present(df, candidates)
        if found and found != target:
            renames[found] = target
    shadowed = [c for c in df.columns if c in renames.values() and c not in renames]
    return df.drop(*shadowed).withColumnsRenamed(renames)


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are absent."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts (map-side combined)."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Eager cardinality guard: raises on the first duplicate key found."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{what} has duplicate keys {list(keys)}: {found[0].asDict()}")
    return df


def one_row_per_key(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Lazy cardinality guard: the query itself fails when a key is repeated.

    Rows are combined per key before the shuffle, so a hot duplicate key costs
    one counter, not one large group.
    """
    values = [c for c in df.columns if c not in keys]
    merged = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values]
    )
    checked = F.when(
        F.col("_n") > 1, F.raise_error(F.lit(f"{what}: duplicate key {list(keys)}")).cast("boolean")
    ).otherwise(F.lit(True))
    return merged.where(checked).select(*df.columns)
