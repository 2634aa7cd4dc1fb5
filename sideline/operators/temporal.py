"""Leakage-safe temporal features over (player, season) histories.

All windows share one partitioning and one ordering. A history group holds at
most one row per week (``guard_history`` makes a repeated week fail the
query), so no group can grow with the data; the player-week roll-ups that feed
this module are combined map-side before they are shuffled.

Every season and every target week is served by a single pass: the features
of week W are those on the player's last row before W, so the target is the
``lead`` of the points column and nothing is rebuilt per week.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sideline.functions.numeric import as_double, number_or_null, safe_ratio, zero_if_null
from sideline.functions.text import team_code
from sideline.operators.schema import require, resolve_aliases
from sideline.schemas import (
    FEATURE_METRICS, MOMENTUM_METRICS, SNAP_ALIASES,
)

# fixed values
EWMA_ALPHA = 0.45
CARRYOVER_GAMES = 3
ROLLS = (2, 3, 5)

# The running-product form of the EWMA stays inside the double range up to here;
# a season has far fewer weeks.
MAX_HISTORY = 1000

HISTORY = ("player_id", "season")


def history_window(keys: Sequence[str] = HISTORY):
    return Window.partitionBy(*keys).orderBy("week")


# ------------------------------------------------------------------ usage


def standardize_snaps(raw: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Snap counts in canonical form; unreadable numbers and absent columns are null."""
    df = resolve_aliases(raw, SNAP_ALIASES)
    return df.withColumns(
        {
            "season": F.col("season").try_cast("int"),
            "week": F.col("week").try_cast("int"),
            "offense_snaps": number_or_null(df, "offense_snaps"),
            "offense_pct": number_or_null(df, "offense_pct"),
            "team": team_code(F.col("team") if "team" in df.columns else F.lit(""), ascii_only=ascii_only),
        }
    )


def merge_usage(stats: DataFrame, snaps: DataFrame | None) -> DataFrame:
    """Attach snap counts, the largest per player-week; null where there is none.

    A snap table without the three keys is not joined at all.
    """
    keys = ["player_id", "season", "week"]
    stats = stats.drop("offense_snaps", "offense_pct")
    if snaps is None or not set(keys) <= set(snaps.columns):
        return stats.withColumns({c: F.lit(None).cast("double") for c in ("offense_snaps", "offense_pct")})
    best = snaps.groupBy(*keys).agg(
        F.max("offense_snaps").alias("offense_snaps"), F.max("offense_pct").alias("offense_pct")
    )
    return stats.join(best, keys, "left")


# ------------------------------------------------------------- carry-over


def _renumbered(stats: DataFrame) -> DataFrame:
    """Rows plus their distance from the end of their (player, season): 1 is the last game."""
    w = Window.partitionBy(*HISTORY).orderBy(F.desc("week"))
    return stats.withColumn("_from_end", F.row_number().over(w))


def carryover(stats: DataFrame, games: int = CARRYOVER_GAMES) -> DataFrame:
    """Each player's last games of every season, relabelled as weeks -n..-1 of the next one."""
    require(stats, ["player_id", "season", "week"], "Stat table")
    return (
        _renumbered(stats)
        .where(F.col("_from_end") <= games)
        .withColumns(
            {
                "source_season": F.col("season"),
                "source_week": F.col("week"),
                "week": -F.col("_from_end"),
                "season": F.col("season") + 1,
            }
        )
        .drop("_from_end")
    )


def with_carryover(stats: DataFrame, games: int = CARRYOVER_GAMES, *, place: bool = True) -> DataFrame:
    """All seasons with their carry-over rows, in one scan and one shuffle.

    Each row emits itself and, if it is among its season's last games, a copy
    for the next season. Everything is placed by player once; both the ranking
    window here and the feature windows later reuse that placement.
    """
    if place:
        stats = stats.repartition("player_id")
    shifts = F.when(F.col("_from_end") <= games, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    moved = F.col("_shift") == 1
    return (
        _renumbered(stats)
        .select("*", F.explode(shifts).alias("_shift"))
        .withColumns(
            {
                "source_season": F.col("season"),
                "source_week": F.col("week"),
                "week": F.when(moved, -F.col("_from_end")).otherwise(F.col("week")),
                "season": F.col("season") + F.col("_shift"),
            }
        )
        .drop("_from_end", "_shift")
    )


def feature_history(season_stats: DataFrame, prior: DataFrame | None, target_week: int | Column) -> DataFrame:
    """Carry-over rows plus the season's rows before the target week."""
    current = season_stats.where(F.col("week") < target_week)
    return current if prior is None else prior.unionByName(current, allowMissingColumns=True)


def guard_history(df: DataFrame, keys: Sequence[str] = HISTORY) -> DataFrame:
    """Fail on a repeated week or an over-long history instead of computing wrong windows."""
    w = history_window(keys)
    n, before = F.row_number().over(w), F.lag("week").over(w)
    df = df.withColumns({"_row": n - 1, "_before": before})
    bad = (F.col("_before") == F.col("week")) | (F.col("_row") >= MAX_HISTORY)
    checked = F.when(
        F.coalesce(bad, F.lit(False)),
        F.raise_error(F.lit("history has a repeated week or too many rows")).cast("int"),
    ).otherwise(F.col("_row"))
    return df.withColumn("_row", checked).drop("_before")


# ------------------------------------------------------------------- EWMA


def add_ewma(
    df: DataFrame,
    metrics: Sequence[str],
    *,
    alpha: float = EWMA_ALPHA,
    dense: Collection[str] = (),
    keys: Sequence[str] = HISTORY,
    suffix: str = "_ewma",
) -> DataFrame:
    """Exponentially weighted mean by running sums only.

    The recursion ``y = a*y + (1-a)*x`` is linear, so with P the running
    product of the factors a, ``y = P * sum((1-a) * x / P)``. Both are plain
    running aggregates: linear time, no arrays. A gap of g rows since the last
    observation gives ``a = r^g / (r^g + alpha)`` with ``r = 1 - alpha``, which
    is the pandas rule for missing values that still age the past. Metrics
    named in ``dense`` are known to have no nulls; there a is always r and P
    is a power of the row number. ``df`` needs the ``_row`` column of
    :func:`guard_history`.
    """
    r, log_r = 1.0 - alpha, math.log(1.0 - alpha)
    running = history_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = history_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    sparse = [m for m in metrics if m not in dense]
    row = F.col("_row")

    if sparse:
        df = df.withColumns(
            {f"_seen_{m}": F.max(F.when(F.col(m).isNotNull(), row)).over(earlier) for m in sparse}
        )
        steps = {}
        for m in sparse:
            decay = F.pow(F.lit(r), row - F.col(f"_seen_{m}"))
            keep = F.when(F.col(m).isNotNull() & F.col(f"_seen_{m}").isNotNull(), decay / (decay + alpha))
            steps[f"_keep_{m}"] = keep
        df = df.withColumns(steps)
        df = df.withColumns({f"_log_{m}": zero_if_null(F.sum(F.log(f"_keep_{m}")).over(running)) for m in sparse})

    out = {}
    for m in metrics:
        x = F.col(m)
        if m in dense:
            term = F.when(row == 0, x).otherwise(alpha * x * F.exp(-row * log_r))
            out[m + suffix] = F.exp(row * log_r) * F.sum(term).over(running)
        else:
            weight = F.when(F.col(f"_keep_{m}").isNull(), 1.0).otherwise(1.0 - F.col(f"_keep_{m}"))
            term = F.when(x.isNotNull(), weight * x * F.exp(-F.col(f"_log_{m}")))
            out[m + suffix] = F.exp(F.col(f"_log_{m}")) * F.sum(term).over(running)
    df = df.withColumns(out)
    return df.drop(*[p + m for m in sparse for p in ("_seen_", "_keep_", "_log_")])


# --------------------------------------------------------------- features


def player_features(
    history: DataFrame,
    *,
    dense: Collection[str] = (),
    keys: Sequence[str] = HISTORY,
    with_target: bool = False,
) -> DataFrame:
    """Feature columns on every row of the history, each built from that row and earlier ones.

    ``with_target`` adds ``target_week`` and ``target_next_week``: the player's
    next row, i.e. the example this feature row predicts.
    """
    df = history.withColumns(
        {m: number_or_null(history, m) if m in history.columns else F.lit(0.0) for m in FEATURE_METRICS}
    )
    td = F.col("td_points")
    points = F.col("fantasy_points_std")
    df = df.withColumns(
        {
            "target_share_proxy": F.lit(None).cast("double"),
            "carry_share_proxy": F.lit(None).cast("double"),
            "fantasy_per_target": safe_ratio(points, F.col("targets")),
            "fantasy_per_carry": safe_ratio(points, F.col("carries")),
            "td_rate": safe_ratio(td, F.abs(points)),
        }
    )
    df = guard_history(df, keys)
    w = history_window(keys)
    simple: dict[str, Column] = {}
    for m in FEATURE_METRICS:
        simple[f"{m}_last"] = F.col(m)
        for n in ROLLS:
            simple[f"{m}_roll{n}"] = F.avg(m).over(w.rowsBetween(1 - n, 0))
    for m in MOMENTUM_METRICS:
        simple[f"{m}_momentum"] = F.avg(m).over(w.rowsBetween(-1, 0)) - F.avg(m).over(w.rowsBetween(-3, -2))
    if with_target:
        simple["target_week"] = F.lead("week").over(w)
        simple["target_next_week"] = F.lead("fantasy_points_std").over(w)
    df = df.withColumns(simple)
    df = add_ewma(df, FEATURE_METRICS, dense=dense, keys=keys)

    def z(name):
        return zero_if_null(F.col(name))

    df = df.withColumns(
        {f"fantasy_points_{s}": F.col(f"fantasy_points_std_{s}") for s in ("last", "roll2", "roll3", "roll5", "ewma")}
        | {
            "opportunity_score": z("targets_ewma") * 1.0
            + z("carries_ewma") * 0.55
            + z("offense_pct_ewma") * 0.06
            + (z("red_zone_targets_ewma") * 1.4 + z("red_zone_carries_ewma") * 1.1),
            "opportunity_momentum": z("targets_momentum")
            + 0.55 * z("carries_momentum")
            + 0.03 * z("offense_pct_momentum")
            + 0.5 * z("red_zone_targets_momentum")
            + 0.4 * z("red_zone_carries_momentum"),
            "production_momentum": F.col("fantasy_points_std_momentum"),
            "games_played": F.col("_row") + 1,
        }
    )
    production = z("fantasy_points_ewma")
    df = df.withColumns(
        {
            "efficiency_score": safe_ratio(production, F.col("opportunity_score")),
            "td_dependency": safe_ratio(F.col("td_points_ewma"), F.abs(production)),
            "trend_gap": F.col("opportunity_momentum") - z("production_momentum"),
        }
    ).withColumn("sustainability_risk", z("td_dependency") * 0.65)
    return df.drop("_row")


def latest_per_history(df: DataFrame, keys: Sequence[str] = HISTORY) -> DataFrame:
    """The last row of every history (reuses the feature windows' partitioning)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("week"))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def asof_join(requests: DataFrame, rows: DataFrame, *, keys: Sequence[str] = HISTORY, at: str = "target_week", week: str = "week",
              columns: Sequence[str]) -> DataFrame:
    """Every request with ``columns`` of the last row of its key before the request's week, and that row's week as ``as_of_week``.

    Requests and rows are sorted together, a request ahead of the rows of its own week, and the last row is carried along: one
    shuffle and one sort answer any number of weeks per key, without a range join. Requests without an earlier row, or
    without a week or key, come back with nulls; repeated requests each come back.
    """
    found = F.struct(F.col(week).alias("as_of_week"), *columns)
    kinds = rows.select(found.alias("_row")).schema["_row"].dataType, requests.select(F.struct(*requests.columns).alias("_request")).schema["_request"].dataType
    asked = requests.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(*requests.columns).alias("_request"), F.lit(None).cast(kinds[0]).alias("_row"))
    known = rows.select(*keys, F.col(week).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kinds[1]).alias("_request"), found.alias("_row"))
    so_far = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.lit(True)
    for c in (*keys, at):
        whole = whole & F.col(f"_request.{c}").isNotNull()
    both = asked.unionByName(known).withColumn("_last", F.last("_row", ignorenulls=True).over(so_far)).where("_request IS NOT NULL")
    return both.withColumn("_last", F.when(whole, F.col("_last"))).select("_request.*", "_last.*")


def features_asof(history: DataFrame, requests: DataFrame, columns: Sequence[str], *, dense: Collection[str] = ()) -> DataFrame:
    """Feature columns for a table of requests (player_id, season, target_week): each from the games before its own week."""
    return asof_join(requests, player_features(history, dense=dense), columns=columns)


def features_before(
    history: DataFrame, target_week: int, *, dense: Collection[str] = ()
) -> DataFrame:
    """One feature row per (player, season) from games before ``target_week``."""
    past = history.where(as_double(F.col("week")) < target_week)
    return latest_per_history(player_features(past, dense=dense))


def walk_forward(
    stats: DataFrame,
    *,
    carry: bool = True,
    dense: Collection[str] = (),
    seasons: Collection[int] | None = None,
) -> DataFrame:
    """Every (features before W, points at W) pair of every season, W > 1, in one pass.

    ``seasons`` restricts the target seasons; the one before each is still read
    for carry-over.
    """
    if seasons is not None:
        wanted = sorted({int(s) for s in seasons} | ({int(s) - 1 for s in seasons} if carry else set()))
        stats = stats.where(F.col("season").isin(wanted))
    history = with_carryover(stats) if carry else stats.repartition("player_id")
    if seasons is not None:
        history = history.where(F.col("season").isin(sorted(int(s) for s in seasons)))
    pairs = player_features(history, dense=dense, with_target=True)
    return pairs.where(F.col("target_week").isNotNull() & (F.col("target_week") > 1))
