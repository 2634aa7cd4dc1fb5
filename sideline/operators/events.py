"""Scoring events rebuilt from play-level rows.

One scan and one shuffle: every play emits one row per actor through a
row-local array, and the sums are combined before the shuffle. A
player or week that owns a large share of the plays therefore costs one
partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sideline.functions.numeric import number_or_zero
from sideline.functions.text import blank_to_null
from sideline.operators.schema import require
from sideline.schemas import EVENT_COLUMNS

_RETURNERS = ("returner_player_id", "kickoff_returner_player_id", "punt_returner_player_id")

# event -> (actor candidates, columns needed besides the actor)
EVENT_SOURCES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "passing_tds_40_plus": (("passer_player_id",), ("touchdown", "yards_gained", "pass_touchdown")),
    "rushing_tds_40_plus": (("rusher_player_id",), ("touchdown", "yards_gained", "rush_touchdown")),
    "receiving_tds_40_plus": (("receiver_player_id",), ("touchdown", "yards_gained", "pass_touchdown")),
    "return_yards": (_RETURNERS, ("return_yards",)),
    "return_tds": (_RETURNERS, ("return_touchdown",)),
    "offensive_fumble_return_tds": (("fumble_recovery_1_player_id",), ("fumble_return_touchdown",)),
    "extra_points_made": (("kicker_player_id",), ("extra_point_result",)),
    "field_goal_yards_made": (("kicker_player_id",), ("field_goal_result", "kick_distance")),
}


def available_events(plays: DataFrame) -> dict[str, bool]:
    """Which events this schema can reconstruct."""
    have = set(plays.columns)
    return {
        event: any(a in have for a in actors) and have.issuperset(needed)
        for event, (actors, needed) in EVENT_SOURCES.items()
    }


def availability_report(plays: DataFrame) -> DataFrame:
    """The availability map as a table, with the number of usable plays per event.

    The count says how many plays name an actor for the event, so a column
    that is present but empty shows up as such.
    """
    have = available_events(plays)
    counts = []
    for event, (actors, _) in EVENT_SOURCES.items():
        actor = _actor(plays, actors, "first")
        counts.append(F.count(actor).alias(event) if have[event] else F.lit(0).cast("long").alias(event))
    wide = plays.agg(*counts)
    flags = F.create_map(*[F.lit(x) for kv in have.items() for x in kv])
    return wide.unpivot([], list(EVENT_COLUMNS), "event", "plays_with_actor").select(
        "event", F.element_at(flags, F.col("event")).alias("available"), "plays_with_actor"
    )


def _actor(plays: DataFrame, candidates: Sequence[str], mode: str) -> Column | None:
    """Actor id. ``first``: first column present in the schema; ``coalesce``: first filled one."""
    present = [blank_to_null(F.col(c)) for c in candidates if c in plays.columns]
    if not present:
        return None
    return present[0] if mode == "first" else F.coalesce(*present)


def _equals(plays: DataFrame, column: str, word: str) -> Column:
    if column not in plays.columns:
        return F.lit(0.0)
    return F.when(F.lower(F.col(column).cast("string")) == word, 1.0).otherwise(0.0)


def event_rollup(plays: DataFrame, *, actor_mode: str = "first", time_keys: Sequence[Column] = ()) -> DataFrame:
    """Plays to one row per (season, week, player) with all eight event columns.

    Regular-season plays only when ``season_type`` exists. An event whose actor
    column is missing is not inferred. ``time_keys`` adds grouping columns (the
    streaming form passes its event-time window).
    """
    require(plays, ["season", "week"], "Play table")
    if "season_type" in plays.columns:
        plays = plays.where(F.upper(F.col("season_type").cast("string")).isin("REG", "REGULAR"))

    def n(c):
        return number_or_zero(plays, c)

    long_td = F.when((n("touchdown") == 1) & (n("yards_gained") >= 40), 1.0).otherwise(0.0)
    values = {
        "passing_tds_40_plus": long_td * n("pass_touchdown"),
        "rushing_tds_40_plus": long_td * n("rush_touchdown"),
        "receiving_tds_40_plus": long_td * n("pass_touchdown"),
        "return_yards": n("return_yards"),
        "return_tds": n("return_touchdown"),
        "offensive_fumble_return_tds": n("fumble_return_touchdown"),
        "extra_points_made": _equals(plays, "extra_point_result", "good"),
        "field_goal_yards_made": n("kick_distance") * _equals(plays, "field_goal_result", "made"),
    }
    # One struct per actor column, holding the values of all its events; the
    # other events are 0, so the sums need no case distinction.
    by_actor: dict[tuple[str, ...], list[str]] = {}
    for event, (actors, _) in EVENT_SOURCES.items():
        by_actor.setdefault(actors, []).append(event)
    entries = []
    for actors, own in by_actor.items():
        actor = _actor(plays, actors, actor_mode)
        if actor is not None:
            cells = [(values[e] if e in own else F.lit(0.0)).alias(e) for e in EVENT_COLUMNS]
            entries.append(F.struct(actor.alias("player_id"), *cells))
    if not entries:
        entries = [F.struct(F.lit(None).cast("string").alias("player_id"), *[F.lit(0.0).alias(e) for e in EVENT_COLUMNS])]
    season, week = F.col("season").try_cast("int"), F.col("week").try_cast("int")
    rows = plays.select(
        season.alias("season"), week.alias("week"), *time_keys, F.inline(F.array(*entries))
    )
    something = F.lit(False)
    for event in EVENT_COLUMNS:
        something = something | (F.col(event) != 0)
    rows = rows.where(
        F.col("season").isNotNull() & F.col("week").isNotNull()
        & F.col("player_id").isNotNull() & (F.col("player_id") != "<NA>") & something
    )
    extra = [c for c in rows.columns if c not in ("season", "week", "player_id", *EVENT_COLUMNS)]
    return rows.groupBy("season", "week", "player_id", *extra).agg(*[F.sum(e).alias(e) for e in EVENT_COLUMNS])


def event_totals(events: DataFrame) -> DataFrame:
    """Total per event over the table, non-zero ones only."""
    totals = events.agg(*[F.sum(c).alias(c) for c in EVENT_COLUMNS])
    return totals.unpivot([], list(EVENT_COLUMNS), "event", "total").where(F.col("total") != 0)
