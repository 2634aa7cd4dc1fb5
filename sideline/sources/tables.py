"""Reading and writing the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.functions.text import team_code
from sideline.operators.events import available_events, event_rollup
from sideline.operators.identity import standardize_master
from sideline.operators.schema import resolve_aliases
from sideline.operators.scoring import standardize_stats
from sideline.operators.status import standardize_depth, standardize_injuries
from sideline.operators.temporal import standardize_snaps
from sideline.schemas import SCHEDULE_ALIASES


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    *,
    loader: Callable[[SparkSession], DataFrame] | None = None,
    refresh: bool = False,
) -> DataFrame:
    """A stored Parquet table; where there is none, what the loader brings, stored for next time.

    A loader that fails leaves an empty table of the given schema, so a
    pipeline can go on without an optional feed. An empty result is not stored.
    """
    if not refresh:
        try:
            reader = spark.read.schema(schema) if schema is not None else spark.read
            return reader.parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    empty = spark.createDataFrame([], schema or T.StructType([]))
    if loader is None:
        return empty
    try:
        data = loader(spark)
        if data.limit(1).count() == 0:
            return data
    except Exception as exc:
        print(f"WARNING: unable to load {path}: {exc}")
        return empty
    data.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_weekly_stats(spark: SparkSession, stats_path: str, events_path: str | None = None, **options) -> DataFrame:
    """Weekly stat lines, standardised, with the stored event table where it exists.

    Tables partitioned by season are pruned by any later season filter.
    """
    events = None
    if events_path:
        found = load_table(spark, events_path)
        events = found if found.columns else None
    return standardize_stats(spark.read.parquet(stats_path), events, **options)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build_event_table(spark: SparkSession, plays: DataFrame, path: str) -> tuple[DataFrame, dict[str, bool]]:
    """Roll plays up to player-weeks, store them by season, report what the schema could give."""
    events = event_rollup(plays)
    # Rebalance, not repartition: a season with most of the rows is split over tasks.
    events.hint("rebalance", "season").write.mode("overwrite").partitionBy("season").parquet(path)
    return spark.read.parquet(path), available_events(plays)


def load_snaps(spark: SparkSession, path: str, **options) -> DataFrame:
    return standardize_snaps(spark.read.parquet(path), **options)


def load_master(spark: SparkSession, path: str, **options) -> DataFrame:
    return standardize_master(spark.read.parquet(path), **options)


def standardize_schedule(raw: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Schedule in canonical form."""
    df = resolve_aliases(raw, SCHEDULE_ALIASES)
    sides = {c: team_code(F.col(c), ascii_only=ascii_only) for c in ("home_team", "away_team") if c in df.columns}
    numbers = {c: F.col(c).try_cast("int") for c in ("season", "week") if c in df.columns}
    return df.withColumns(sides | numbers)


def load_schedule(spark: SparkSession, path: str, **options) -> DataFrame:
    return standardize_schedule(spark.read.parquet(path), **options)


def load_depth(spark: SparkSession, path: str, **options) -> DataFrame:
    return standardize_depth(spark.read.parquet(path), **options)


def load_injuries(spark: SparkSession, path: str, **options) -> DataFrame:
    return standardize_injuries(spark.read.parquet(path), **options)


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """CSV sink; nested columns are written as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).options(header=True, escape='"').csv(path)


def export_run(root: str, roster: DataFrame, projections: DataFrame, waiver: DataFrame) -> None:
    """The three files of a live run."""
    for name, df in (("roster_mapping", roster), ("projections", projections), ("waiver_candidates", waiver)):
        write_csv(df, f"{root}/{name}")
