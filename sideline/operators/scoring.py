"""Stat-line scoring with a versioned rule set."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sideline.functions.numeric import number_or_zero, zero_if_null
from sideline.functions.text import team_code
from sideline.operators.schema import one_row_per_key, require, resolve_aliases
from sideline.schemas import (
    EVENT_COLUMNS, SCORING_VERSION, STAT_ALIASES, STAT_DEFAULTS,
)


@dataclass(frozen=True)
class ScoringRules:
    """Points per unit. Defaults are the league's own rules."""

    # fixed values
    passing_yard: float = 1.0 / 25.0
    passing_touchdown: float = 6.0
    interception: float = -2.0
    rushing_yard: float = 1.0 / 10.0
    rushing_touchdown: float = 6.0
    reception: float = 0.0
    receiving_yard: float = 1.0 / 10.0
    receiving_touchdown: float = 6.0
    fumble_lost: float = -2.0
    two_point_conversion: float = 2.0
    long_touchdown_bonus: float = 1.0
    return_yard: float = 1.0 / 25.0
    return_touchdown: float = 6.0
    offensive_fumble_return_touchdown: float = 6.0
    extra_point_made: float = 1.0
    field_goal_yard: float = 1.0 / 10.0
    defense_sack: float = 1.0
    defense_interception: float = 2.0
    defense_fumble_recovery: float = 2.0
    defense_touchdown: float = 6.0
    defense_safety: float = 2.0
    defense_blocked_kick: float = 2.0
    defense_extra_point_return: float = 2.0
    version: str = SCORING_VERSION

    def touchdown_weights(self) -> dict[str, float]:
        return {
            "passing_tds": self.passing_touchdown,
            "rushing_tds": self.rushing_touchdown,
            "receiving_tds": self.receiving_touchdown,
            "passing_tds_40_plus": self.long_touchdown_bonus,
            "rushing_tds_40_plus": self.long_touchdown_bonus,
            "receiving_tds_40_plus": self.long_touchdown_bonus,
            "return_tds": self.return_touchdown,
            "offensive_fumble_return_tds": self.offensive_fumble_return_touchdown,
        }

    def other_weights(self) -> dict[str, float]:
        return {
            "passing_yards": self.passing_yard,
            "interceptions": self.interception,
            "rushing_yards": self.rushing_yard,
            "receptions": self.reception,
            "receiving_yards": self.receiving_yard,
            "fumbles_lost": self.fumble_lost,
            "two_point": self.two_point_conversion,
            "return_yards": self.return_yard,
            "extra_points_made": self.extra_point_made,
            "field_goal_yards_made": self.field_goal_yard,
        }

    def defense_weights(self) -> dict[str, float]:
        return {
            "sacks": self.defense_sack,
            "interceptions": self.defense_interception,
            "fumble_recoveries": self.defense_fumble_recovery,
            "defense_tds": self.defense_touchdown,
            "safeties": self.defense_safety,
            "blocked_kicks": self.defense_blocked_kick,
            "return_yards": self.return_yard,
            "return_tds": self.return_touchdown,
            "extra_point_returns": self.defense_extra_point_return,
        }


LEAGUE_RULES = ScoringRules()

# Points-allowed tiers: (highest value in the tier, points); above the last: -4.
ALLOWED_TIERS = ((0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0))
ALLOWED_WORST = -4.0


def rules_table(spark, rules: ScoringRules = LEAGUE_RULES) -> DataFrame:
    """The rule set as data: one row per rule."""
    items = [(k, float(v), rules.version) for k, v in asdict(rules).items() if k != "version"]
    return spark.createDataFrame(items, "rule string, points double, version string")


def _weighted(df: DataFrame, weights: Mapping[str, float]) -> Column:
    terms = [number_or_zero(df, c) * F.lit(w) for c, w in weights.items() if c in df.columns and w != 0]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def score_lines(
    df: DataFrame,
    rules: ScoringRules = LEAGUE_RULES,
    *,
    total: str = "fantasy_points_std",
    touchdown: str = "td_points",
    remainder: str | None = "non_td_fantasy_points",
) -> DataFrame:
    """Total points and their touchdown part. Columns not in the schema count 0."""
    df = df.withColumn(touchdown, _weighted(df, rules.touchdown_weights()))
    df = df.withColumn(total, _weighted(df, rules.other_weights()) + F.col(touchdown))
    return df.withColumn(remainder, F.col(total) - F.col(touchdown)) if remainder else df


def points_allowed_tier(allowed: Column) -> Column:
    tier = F.when(allowed <= ALLOWED_TIERS[0][0], ALLOWED_TIERS[0][1])
    for upper, points in ALLOWED_TIERS[1:]:
        tier = tier.when(allowed <= upper, points)
    return tier.otherwise(ALLOWED_WORST)


def score_defense(
    df: DataFrame, rules: ScoringRules = LEAGUE_RULES, *, total: str = "defense_points"
) -> DataFrame:
    """Team-defence line: weighted counts plus the points-allowed tier."""
    tier = points_allowed_tier(number_or_zero(df, "points_allowed"))
    return df.withColumn(total, _weighted(df, rules.defense_weights()) + tier)


def attach_events(stats: DataFrame, events: DataFrame) -> DataFrame:
    """Left-join event counts on (season, week, player_id); no event means 0.

    ``events`` must hold one row per key, as `operators.events.event_rollup` returns it; a repeated key fails the query
    instead of multiplying stat lines. The check groups by the join's own keys and so needs no shuffle of its own.
    """
    keys = ["season", "week", "player_id"]
    require(events, keys, "Scoring-event table")
    require(events, EVENT_COLUMNS, "Scoring-event table")
    payload = one_row_per_key(events.select(*keys, *EVENT_COLUMNS), keys, "Scoring-event table")
    joined = stats.drop(*EVENT_COLUMNS).join(payload, keys, "left")
    return joined.withColumns({c: zero_if_null(F.col(c).try_cast("double")) for c in EVENT_COLUMNS})


def standardize_stats(
    raw: DataFrame,
    events: DataFrame | None = None,
    rules: ScoringRules = LEAGUE_RULES,
    *,
    combine: str = "first",
    ascii_only: bool = False,
) -> DataFrame:
    """Weekly stat lines in canonical form, scored.

    ``combine="first"`` takes one source column per logical column;
    ``combine="sum"`` adds up all fumble and two-point columns that exist.
    """
    summed = {}
    if combine == "sum":
        for target in ("fumbles_lost", "two_point"):
            parts = [c for c in STAT_ALIASES[target] if c in raw.columns]
            if parts:
                total = sum((number_or_zero(raw, c) for c in parts[1:]), number_or_zero(raw, parts[0]))
                summed[target] = total
                raw = raw.withColumn(f"_sum_{target}", total)
    df = resolve_aliases(raw, STAT_ALIASES)
    for target in summed:
        df = df.withColumn(target, F.col(f"_sum_{target}")).drop(f"_sum_{target}")
    if "player_id" not in df.columns:
        raise ValueError("Player stats do not contain player ids.")
    numeric = {c: number_or_zero(df, c) for c in STAT_DEFAULTS}
    numeric |= {
        c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("season", "week") if c in df.columns
    }
    for side in ("team", "opponent"):
        known = side in df.columns
        numeric[side] = team_code(F.col(side), ascii_only=ascii_only) if known else F.lit("")
    df = df.withColumns(numeric).withColumn("player_id", F.col("player_id").cast("string"))
    if events is not None:
        df = attach_events(df, events)
    return score_lines(df, rules)


def scoring_audit(
    raw: DataFrame, events: DataFrame, rules: ScoringRules = LEAGUE_RULES, *, ascii_only: bool = False
) -> DataFrame:
    """What the events add to every player-week, both totals computed in one pass.

    Instead of scoring twice and joining the results, the events are joined
    once and the line is scored with and without the event columns.
    """
    df = standardize_stats(raw, events, rules, ascii_only=ascii_only)
    bare = df.drop(*EVENT_COLUMNS)
    core_expr = _weighted(bare, rules.other_weights()) + _weighted(bare, rules.touchdown_weights())
    info = [c for c in ("player_name", "position", "team") if c in df.columns]
    return df.select(
        "player_id", "season", "week", *info,
        core_expr.alias("fantasy_points_std_core"),
        F.col("fantasy_points_std").alias("fantasy_points_std_adjusted"),
        (F.col("fantasy_points_std") - core_expr).alias("pbp_adjustment"),
    )


def largest_adjustments(audit: DataFrame, n: int = 20) -> DataFrame:
    """The n largest changes; ties by player, season, week."""
    return (
        audit.where(F.abs("pbp_adjustment") > 0)
        .orderBy(F.desc("pbp_adjustment"), "player_id", "season", "week")
        .limit(n)
    )
