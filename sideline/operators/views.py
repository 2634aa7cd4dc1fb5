"""Result views: waiver pool, top lists, recent form and roster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sideline.functions.numeric import clip, number_or_zero, zero_if_null
from sideline.functions.text import blank_to_null
from sideline.schemas import OFFENSE

ROSTER_VIEW_COLUMNS = (
    "projection", "baseline_projection", "ml_projection", "depth_role", "depth_note", "range_low", "range_high",
    "confidence", "games_played", "classification", "opportunity_momentum", "production_momentum", "trend_gap",
    "td_dependency", "volatility", "fantasy_points_ewma", "fantasy_points_roll3", "fantasy_points_roll5",
    "opportunity_score", "targets_ewma", "carries_ewma", "why",
)


def waiver_pool(projections: DataFrame, roster: DataFrame, *, id_column: str = "nflverse_player_id") -> DataFrame:
    """Unrostered offence players with a discovery score. Blank roster ids exclude nobody."""
    taken = roster.select(blank_to_null(F.col(id_column)).alias("player_id")).where("player_id IS NOT NULL").distinct()
    source = "projection" if "projection" in projections.columns else "baseline_projection"
    return (
        projections.where(F.col("position").isin(*OFFENSE))
        .join(taken, "player_id", "left_anti")
        .withColumn(
            "waiver_discovery_score",
            zero_if_null(F.col(source))
            + clip(zero_if_null(F.col("opportunity_momentum")), -3, 5)
            + clip(zero_if_null(F.col("trend_gap")), -2, 5),
        )
    )


def top_n(df: DataFrame, score: str, n: int, *, by: str | None = None, tie: str = "player_id") -> DataFrame:
    """Highest n rows, overall or per group, ties by id.

    The per-group form is a ranking filter, which Spark cuts down to n rows
    per group in every task before it shuffles.
    """
    if by is None:
        return df.orderBy(F.desc(score), tie).limit(n)
    w = Window.partitionBy(by).orderBy(F.desc(score), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _last_rows(history: DataFrame, n: int, keys=("player_id", "season")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("week"))
    return history.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)


def recent_form(history: DataFrame, games: int = 3) -> DataFrame:
    """Mean and the single scores of the last games per (player, season), oldest first."""
    source_week = F.col("source_week") if "source_week" in history.columns else F.col("week")
    source_season = F.col("source_season") if "source_season" in history.columns else F.col("season")
    label = F.concat(
        F.lit("Wk "), source_week.cast("string"),
        F.when(source_season != F.col("season"), F.concat(F.lit(" ("), source_season.cast("string"), F.lit(")"))).otherwise(""),
        F.lit(": "), F.format_string("%.1f", F.round("fantasy_points_std", 6)),
    )
    return (
        _last_rows(history, games)
        .groupBy("player_id", "season")
        .agg(
            F.avg("fantasy_points_std").alias("recent_average"),
            F.count(F.lit(1)).alias("recent_games"),
            F.sort_array(F.collect_list(F.struct("week", label.alias("label")))).alias("_s"),
        )
        .withColumn("recent_scores", F.col("_s.label"))
        .drop("_s")
    )


def form_series(history: DataFrame, points: int = 6) -> DataFrame:
    """Last production and opportunity values per (player, season), oldest first.

    Opportunity weighs what matters for the position of the newest row:
    attempts for quarterbacks, carries for backs, targets otherwise.
    """
    source = F.col("source_season") if "source_season" in history.columns else F.col("season")
    rows = _last_rows(history, points).withColumns(
        {c: number_or_zero(history, c) for c in ("targets", "carries", "offense_pct", "passing_attempts")}
    )
    newest = Window.partitionBy("player_id", "season").orderBy("_back")
    position = F.upper(F.coalesce(F.first("position").over(newest), F.lit(""))) if "position" in history.columns else F.lit("")
    snap = 0.03 * F.col("offense_pct")
    rows = rows.withColumn("_p", position).withColumn(
        "_opportunity",
        F.when(F.col("_p") == "QB", F.col("passing_attempts") + 0.50 * F.col("carries") + snap)
        .when(F.col("_p") == "RB", F.col("carries") + 0.75 * F.col("targets") + snap)
        .otherwise(F.col("targets") + 0.55 * F.col("carries") + snap),
    )
    packed = F.sort_array(
        F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col("fantasy_points_std").alias("production"), F.col("_opportunity").alias("opportunity")))
    )
    return (
        rows.groupBy("player_id", "season")
        .agg(packed.alias("_s"), F.count_if(source < F.col("season")).alias("prior_season_points"))
        .select(
            "player_id", "season",
            F.col("_s.production").alias("production"), F.col("_s.opportunity").alias("opportunity"),
            "prior_season_points",
        )
    )


def roster_view(
    roster: DataFrame, projections: DataFrame, *, manager: str | None = None, sort: str = "source",
    id_column: str = "nflverse_player_id",
) -> DataFrame:
    """Roster rows with their forecast, in source order or by projection.

    ``roster`` carries a ``source_order`` column; ``sort`` is "source", "asc" or "desc".
    """
    rows = roster if manager is None else roster.where(F.col("manager") == manager)
    have = [c for c in ROSTER_VIEW_COLUMNS if c in projections.columns]
    values = projections.select(F.col("player_id").alias("_pid"), *have)
    df = rows.drop(*have).join(values, blank_to_null(F.col(id_column)) == F.col("_pid"), "left").drop("_pid")
    order: dict[str, list[Column]] = {
        "source": [F.col("source_order")],
        "asc": [F.asc_nulls_first("projection"), F.col("source_order")],
        "desc": [F.desc_nulls_last("projection"), F.col("source_order")],
    }
    return df.orderBy(*order[sort])


def next_week(stats: DataFrame, season: int | None = None) -> int:
    """Week after the last completed one: the one scalar a live run brings to the driver."""
    rows = stats if season is None else stats.where(F.col("season") == season)
    latest = rows.agg(F.max(F.col("week").try_cast("int"))).first()[0]
    if latest is None:
        raise ValueError("No completed weeks.")
    return int(latest) + 1
