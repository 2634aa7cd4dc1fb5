"""Reconcile captured rival projections with the roster mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sideline.functions.text import compact_key, strip_labels_and_status, team_code
from sideline.operators.schema import assert_unique, require


def _identity(name: Column, position: Column, team: Column) -> Column:
    own = F.when(position == "DEF", team_code(team)).otherwise(
        compact_key(strip_labels_and_status(name))
    )
    return F.concat_ws("|", position, own)


def _roster_identities(roster: DataFrame) -> DataFrame:
    """(identity, roster row): the displayed name and, as an exact alias, the resolved one."""
    shown = _identity(F.col("player"), F.col("position"), F.col("team"))
    has_alias = (F.coalesce(F.col("nflverse_name"), F.lit("")) != "") & (F.col("position") != "DEF")
    alias = F.when(has_alias, _identity(F.col("nflverse_name"), F.col("position"), F.col("team")))
    keys = F.array_distinct(F.array_compact(F.array(shown, alias)))
    return roster.select("_row", F.col("manager").alias("_owner"), F.explode(keys).alias("identity"))


def reconcile(
    captured: DataFrame, roster: DataFrame, *, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Coverage (one row per roster row) and the captured rows that fit nowhere.

    A captured row fits a roster row when position and name key (club for a
    team defence) agree, by the displayed or the resolved name, and the
    manager does too. With ``strict`` ambiguous identities, repeated captures
    and mixed weeks or leagues raise; without it the first capture by slot,
    name and source is kept, and the others of its roster row are returned with
    those that fit nowhere. Their ``reason`` is "duplicate" or "unmatched".
    """
    require(roster, ["manager", "player", "position", "team", "slot", "nflverse_player_id"], "Roster mapping")
    extra = [c for c in ("source_file", "captured_at_utc") if c in captured.columns]
    text = ["manager", "player", "position", "team", "slot", "nflverse_player_id"]
    roster = roster.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in text})
    if "nflverse_name" not in roster.columns:
        roster = roster.withColumn("nflverse_name", F.lit(""))
    roster = roster.withColumn("_row", F.to_json(F.struct(*text)))
    identities = _roster_identities(roster)
    rows = captured.withColumns(
        {
            "identity": _identity(F.col("player_name"), F.col("position"), F.col("team")),
            "_owner": compact_key(F.col("manager")),
        }
    )
    if strict:
        scope = captured.agg(
            F.min("week").alias("w0"), F.max("week").alias("w1"),
            F.min("league_id").alias("l0"), F.max("league_id").alias("l1"),
        ).first()
        if scope["w0"] is None:
            raise ValueError("No projections were captured.")
        if scope["w0"] != scope["w1"] or scope["l0"] != scope["l1"]:
            raise ValueError("Cannot combine different weeks or leagues.")
        assert_unique(identities, ["identity"], "Roster identities")
        assert_unique(roster, ["_row"], "Roster")

    owned = identities.withColumn("_owner", compact_key(F.col("_owner")))
    fits = rows.join(owned, ["identity", "_owner"], "left")
    if strict:
        assert_unique(fits.where(F.col("_row").isNotNull()), ["_row"], "Captured rows")

    ties = [c for c in ("source_file", "captured_at_utc", "yahoo_projection") if c in captured.columns]
    first = Window.partitionBy("_row").orderBy("slot", "player_name", *ties)
    held = fits.where(F.col("_row").isNotNull()).withColumn("_nth", F.row_number().over(first))
    record = F.struct(
        F.lit(True).alias("captured"), "yahoo_projection", F.col("slot").alias("yahoo_slot"),
        F.col("team").alias("_captured_team"), *extra,
    )
    found = held.where("_nth = 1").select("_row", record.alias("r"))
    team = team_code(F.col("team"))
    player_id = F.when(F.col("position") == "DEF", F.concat(F.lit("DEF:"), team)).otherwise(
        F.col("nflverse_player_id")
    )
    coverage = roster.join(found, "_row", "left").select(
        "manager",
        F.col("player").alias("player_name"),
        "position",
        team.alias("team"),
        F.col("slot").alias("roster_slot"),
        player_id.alias("player_id"),
        (player_id != "").alias("identity_resolved"),
        F.when(F.col("r").isNull(), "not_captured")
        .when(F.col("r.yahoo_projection").isNull(), "projection_unavailable")
        .otherwise("matched")
        .alias("coverage_status"),
        F.col("r.yahoo_projection").alias("yahoo_projection"),
        F.col("r.yahoo_slot").alias("yahoo_slot"),
        F.coalesce(F.col("r._captured_team") != team, F.lit(False)).alias("team_mismatch"),
        *[F.col(f"r.{c}").alias(c) for c in extra],
    )
    unmatched = fits.where(F.col("_row").isNull()).select(*captured.columns, F.lit("unmatched").alias("reason"))
    repeated = held.where("_nth > 1").select(*captured.columns, F.lit("duplicate").alias("reason"))
    return coverage, unmatched.union(repeated)


def coverage_summary(coverage: DataFrame, captured: DataFrame, unexpected: DataFrame) -> DataFrame:
    """One row of coverage counts."""
    cov = coverage.agg(
        F.count(F.lit(1)).alias("roster_entries"),
        F.count_if(F.col("coverage_status") != "not_captured").alias("matched_entries"),
        F.count("yahoo_projection").alias("numeric_projections"),
        F.count_if(F.col("coverage_status") == "not_captured").alias("missing_entries"),
        F.count_distinct("manager").alias("roster_managers"),
        F.count_if(~F.col("identity_resolved")).alias("unresolved_identities"),
    )
    stamp = F.count("captured_at_utc") if "captured_at_utc" in captured.columns else F.lit(0).cast("long")
    cap = captured.agg(
        F.count(F.lit(1)).alias("captured_entries"),
        F.count_distinct("manager").alias("captured_managers"),
        stamp.alias("timestamped_entries"),
    )
    odd = unexpected.agg(F.count(F.lit(1)).alias("unexpected_entries"))
    # Three one-row aggregates side by side.
    one = [d.withColumn("_one", F.lit(1)) for d in (cov, cap, odd)]
    joined = one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")
    return joined.withColumns(
        {
            "complete_roster_coverage": (F.col("missing_entries") == 0) & (F.col("unexpected_entries") == 0),
            "benchmark_eligible": F.lit(False),
            "benchmark_status": F.lit("pending_capture_cutoff_and_kickoff_validation"),
        }
    )
