"""Whole pipelines: the live forecast and the holdout evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sideline.operators.evaluate import forecast_metrics
from sideline.operators.forecast import explain, final_projection, project
from sideline.operators.identity import first_per_player
from sideline.operators.matchup import add_matchup_feature, attach_opponent
from sideline.operators.models import (
    TREE_SETTINGS, RidgeModel, TreeModel, apply_fold_ridges, apply_fold_trees, apply_ridge, apply_trees, fit_fold_trees, ridge_of_seasons,
    season_products,
)
from sideline.operators.status import apply_depth
from sideline.operators.temporal import latest_per_history, player_features, walk_forward, with_carryover
from sideline.schemas import MODEL_FEATURES
from sideline.session import stored


def live_history(stats: DataFrame, season: int, target_week: int) -> DataFrame:
    """What is known before the target week: its season so far plus last season's final games."""
    recent = stats.where(F.col("season").isin(season - 1, season))
    return with_carryover(recent).where((F.col("season") == season) & (F.col("week") < target_week))


def current_projections(
    stats: DataFrame,
    season: int,
    target_week: int,
    *,
    schedule: DataFrame | None = None,
    master: DataFrame | None = None,
    ridge: RidgeModel | None = None,
    trees: TreeModel | None = None,
    depth: DataFrame | None = None,
    dense=(),
) -> DataFrame:
    """Live forecasts for one week: features, projection, opponent, reasons, master data, models, depth."""
    df = project(latest_per_history(player_features(live_history(stats, season, target_week), dense=dense)))
    if schedule is not None:
        df = attach_opponent(df, schedule.where(F.col("season") == season), target_week)
    df = explain(df)
    if master is not None:
        known = first_per_player(master, ["display_name", "position", "team"])
        known = known.withColumnsRenamed({"position": "_position", "team": "_team"})
        df = df.join(known, "player_id", "left")
        name = F.col("player_name") if "player_name" in df.columns else F.lit("")
        df = df.withColumns(
            {
                "player_name": F.coalesce("display_name", name),
                "position": F.coalesce("_position", F.col("position")),
                "team": F.coalesce(F.nullif(F.col("_team"), F.lit("")), F.col("team"), F.lit("")),
            }
        ).drop("_position", "_team", "display_name")
    df = final_projection(apply_ridge(apply_trees(df, trees), ridge))
    return apply_depth(df, depth)


def fold_pairs(stats: DataFrame, schedule: DataFrame | None, folds: Mapping[int, Sequence[int]], *, dense=()) -> DataFrame:
    """The walk-forward pairs of all folds' seasons from one pass, with the baseline forecast and, given a schedule, the matchup."""
    seasons = sorted({s for h, train in folds.items() for s in (*train, h)})
    if schedule is not None:
        stats = stored(stats, "fold-stats")  # read by the pairs and by the matchup
    pairs = walk_forward(stats, seasons=seasons, dense=dense)
    if schedule is not None:
        pairs = add_matchup_feature(pairs, stats.where(F.col("season").isin(seasons)), schedule)
    return project(pairs)


def fold_columns(pairs: DataFrame) -> DataFrame:
    """The columns that models and reports of folds read; the others, some hundred, need not be computed and stored."""
    wanted = ("season", "position", "target_next_week", "baseline_projection", *MODEL_FEATURES)
    return pairs.select(*[c for c in pairs.columns if c in wanted])


def fold_forecasts(pairs: DataFrame, folds: Mapping[int, Sequence[int]], *, tree_settings: dict | None = TREE_SETTINGS) -> DataFrame:
    """The holdout rows of all folds with the forecasts of models fitted on each fold's own training seasons.

    Ridges come from one pass of season sums, trees of all folds grow together, and one pass scores all holdouts.
    """
    test = pairs.where(F.col("season").isin(list(folds)))
    sums = season_products(pairs)
    ridges = {h: m for h, train in folds.items() if (m := ridge_of_seasons(sums, train)) is not None}
    test = apply_fold_ridges(test, ridges)
    if tree_settings is not None:
        trees = fit_fold_trees(pairs, folds, settings=tree_settings)
        if trees:
            test = apply_fold_trees(test, trees)
    return test


def fold_reports(pairs: DataFrame, folds: Mapping[int, Sequence[int]], *, tree_settings: dict | None = TREE_SETTINGS) -> DataFrame:
    """Reports of forecasts by groups for every fold, with ``holdout_season``; groups without rows have 0 examples."""
    pairs = stored(fold_columns(pairs), "fold-pairs")  # read by the season sums, the matrix of the trees, and the scoring
    test = fold_forecasts(pairs, folds, tree_settings=tree_settings).withColumn("holdout_season", F.col("season").cast("int"))
    return forecast_metrics(test, by={"holdout_season": sorted(folds)})


def holdout(
    stats: DataFrame,
    schedule: DataFrame | None,
    training_seasons: Sequence[int],
    holdout_season: int,
    *,
    tree_settings: dict | None = TREE_SETTINGS,
    dense=(),
) -> DataFrame:
    """Fit on earlier seasons, score the later one; a report of three forecasts by six groups.

    ``tree_settings=None`` leaves the trees out.
    """
    folds = {holdout_season: list(training_seasons)}
    return fold_reports(fold_pairs(stats, schedule, folds, dense=dense), folds, tree_settings=tree_settings).drop("holdout_season")


def fold_table(holdout_seasons: Sequence[int], span: int = 7, earliest: int | None = None) -> list[tuple[list[int], int]]:
    """(training seasons, holdout season) per fold: the ``span`` seasons before each holdout, none before ``earliest``."""
    return [(list(range(h - span if earliest is None else max(earliest, h - span), h)), h) for h in holdout_seasons]


def multi_fold(
    stats: DataFrame, schedule: DataFrame | None, holdout_seasons: Sequence[int], *, tree_settings: dict | None = TREE_SETTINGS, dense=()
) -> DataFrame:
    """Holdout reports of several folds over one stored set of pairs."""
    folds = {h: train for train, h in fold_table(holdout_seasons)}
    return fold_reports(fold_pairs(stats, schedule, folds, dense=dense), folds, tree_settings=tree_settings)
