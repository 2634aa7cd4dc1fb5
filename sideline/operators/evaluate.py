"""Backtest rows, grouped error metrics and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sideline.functions.numeric import as_double, at_most
from sideline.operators.forecast import project
from sideline.operators.quantiles import exact_medians
from sideline.operators.temporal import walk_forward
from sideline.schemas import OFFENSE
from sideline.session import stored

ALL_RECORDS = "All player records"
OFFENSE_LABEL = "Offense (QB/RB/WR/TE)"
GROUPS = (OFFENSE_LABEL, *OFFENSE, ALL_RECORDS)

FORECAST_LABELS = {
    "baseline_projection": "Baseline projection",
    "learned_weight_projection": "Machine Learned Weight Values",
    "ml_projection": "Machine Learned Points Projection",
}


def backtest(stats: DataFrame, *, seasons: Sequence[int] | None = None, dense=()) -> DataFrame:
    """Baseline forecast against the outcome for every player-week, without carry-over."""
    pairs = project(walk_forward(stats, carry=False, dense=dense, seasons=seasons))
    error = F.col("baseline_projection") - F.col("target_next_week")
    return pairs.select(
        "season", "target_week", "player_id", "baseline_projection",
        F.col("target_next_week").alias("fantasy_points_std_actual"),
        error.alias("error"), F.abs(error).alias("abs_error"),
        at_most(F.abs(error), 3).alias("within_3"), at_most(F.abs(error), 5).alias("within_5"),
    )


def backtest_summary(rows: DataFrame) -> DataFrame:
    """Examples, MAE, median signed error and the shares within 3 and 5, in one row.

    The four columns it needs are stored once; the totals and the passes of the median read them.
    """
    rows = stored(rows.select("error", "abs_error", "within_3", "within_5"), "backtest-errors")
    median = exact_medians(rows, "error").get(None)
    return rows.agg(
        F.count(F.lit(1)).alias("examples"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.col("within_3").cast("double")).alias("within_3"),
        F.avg(F.col("within_5").cast("double")).alias("within_5"),
        F.lit(median).cast("double").alias("median_error"),
    )


def position_groups(position: Column) -> Column:
    """The overlapping groups a row belongs to."""
    p = F.upper(F.coalesce(position, F.lit("")))
    offense = p.isin(*OFFENSE)
    return F.array_compact(F.array(F.when(offense, OFFENSE_LABEL), F.when(offense, p), F.lit(ALL_RECORDS)))


def forecast_metrics(
    rows: DataFrame,
    forecasts: Mapping[str, str] = FORECAST_LABELS,
    *,
    actual: str = "target_next_week",
    by: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """n, MAE, RMSE, bias (forecast minus actual) and shares within 3 and 5, per model and group.

    Every row lands in each of its groups; all models and groups come out of a
    single aggregation whose partial results are a few dozen rows per task.
    Pairs without a usable row stay in the result with 0 examples. ``by`` splits
    the report by further columns, each with the list of its values.
    """
    by = by or {}
    present = {c: label for c, label in forecasts.items() if c in rows.columns}
    target = as_double(F.col(actual))
    cells = F.array(*[F.struct(F.lit(label).alias("model"), as_double(F.col(c)).alias("forecast")) for c, label in present.items()])
    long = (
        rows.select(*by, target.alias("actual"), cells.alias("cells"), position_groups(F.col("position")).alias("g"))
        .select(*by, "actual", "cells", F.explode("g").alias("position"))
        .select(*by, "actual", "position", F.explode("cells").alias("c"))
        .select(*by, "position", "c.model", (F.col("c.forecast") - F.col("actual")).alias("error"))
    )
    absolute = F.abs("error")

    def share(limit):
        return F.avg(F.when(F.col("error").isNotNull(), F.when(at_most(absolute, limit), 1.0).otherwise(0.0)))

    measured = long.groupBy(*by, "position", "model").agg(
        F.count("error").alias("examples"),
        F.avg(absolute).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("error").alias("bias"),
        share(3).alias("within_3_points"),
        share(5).alias("within_5_points"),
    )
    skeleton = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("position"))
    for name, values in {"model": list(present.values()), **by}.items():
        skeleton = skeleton.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return skeleton.join(measured, ["position", "model", *by], "left").withColumn(
        "examples", F.coalesce("examples", F.lit(0))
    )
