"""Canonical column lists, aliases and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Names and versions below are part of the data format: files written by other
# tools carry them, so they are kept literally.

SCORING_VERSION = "ffc_yahoo_v1"
SNAPSHOT_SCHEMA_VERSION = "prediction_snapshot_v2"
BENCHMARK_SCHEMA_VERSION = "benchmark_v1"
PARSER_VERSION = "yahoo_matchup_clipboard_v1"

OFFENSE = ("QB", "RB", "WR", "TE")
DEFENSE_ALIASES = ("DEF", "D/ST", "DST")

EVENT_COLUMNS = (
    "passing_tds_40_plus",
    "rushing_tds_40_plus",
    "receiving_tds_40_plus",
    "return_yards",
    "return_tds",
    "offensive_fumble_return_tds",
    "extra_points_made",
    "field_goal_yards_made",
)

SNAPSHOT_COLUMNS = {
    "snapshot_id": "string",
    "captured_at_utc": "string",
    "schema_version": "string",
    "app_version": "string",
    "feature_version": "string",
    "scoring_version": "string",
    "primary_projection_model": "string",
    "season": "int",
    "target_week": "int",
    "player_id": "string",
    "player_name": "string",
    "position": "string",
    "team": "string",
    "snapshot_scope": "string",
    "fantasy_manager": "string",
    "roster_slot": "string",
    "forecast_status": "string",
    "baseline_projection": "double",
    "learned_weight_projection": "double",
    "ml_projection": "double",
    "final_projection": "double",
    "range_low": "double",
    "range_high": "double",
    "confidence": "double",
    "classification": "string",
    "depth_role": "string",
    "depth_adjustment": "string",
    "yahoo_projection": "double",
    "actual_points": "double",
    "actual_finalized_at_utc": "string",
}

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("captured_at_utc", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("target_week", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("snapshot_path", T.StringType()),
        T.StructField("app_version", T.StringType()),
        T.StructField("feature_version", T.StringType()),
        T.StructField("scoring_version", T.StringType()),
        T.StructField("primary_projection_model", T.StringType()),
    ]
)

# Club codes that sources spell differently; any other code stands for itself.
TEAM_ALIASES = {
    "JAC": "JAX", "LA": "LAR", "STL": "LAR", "SD": "LAC", "OAK": "LV", "WSH": "WAS",
    "NWE": "NE", "TAM": "TB", "SFO": "SF", "KAN": "KC", "GNB": "GB", "NOR": "NO",
}

# ------------------------------------------------------------ source aliases
# fixed values: logical column -> accepted source names, first one present wins.

STAT_ALIASES = {
    "player_id": ["player_id", "gsis_id", "id"],
    "player_name": ["player_name", "display_name", "full_name", "name"],
    "season": ["season"],
    "week": ["week"],
    "position": ["position", "position_group"],
    "team": ["recent_team", "team", "posteam"],
    "opponent": ["opponent_team", "opponent", "defteam"],
    "fantasy_points": ["fantasy_points", "fantasy_points_ppr", "fantasy_points_half_ppr"],
    "yahoo_status": ["yahoo_status", "injury_status", "player_status"],
    "passing_yards": ["passing_yards", "pass_yds", "passing_yd"],
    "passing_attempts": ["passing_attempts", "pass_attempts", "attempts"],
    "passing_tds": ["passing_tds", "pass_td"],
    "interceptions": ["interceptions", "interception", "ints"],
    "rushing_yards": ["rushing_yards", "rush_yds"],
    "rushing_tds": ["rushing_tds", "rush_td"],
    "carries": ["carries", "rush_attempts", "rushing_attempts"],
    "receiving_yards": ["receiving_yards", "rec_yds"],
    "receiving_tds": ["receiving_tds", "rec_td"],
    "targets": ["targets", "target"],
    "receptions": ["receptions", "rec"],
    "fumbles_lost": ["rushing_fumbles_lost", "receiving_fumbles_lost", "fumbles_lost"],
    "two_point": [
        "two_point_conversions", "two_point_conversions_pass",
        "two_point_conversions_rush", "two_point_conversions_rec",
    ],
}
STAT_DEFAULTS = (
    "passing_yards", "passing_attempts", "passing_tds", "interceptions",
    "rushing_yards", "rushing_tds", "carries",
    "receiving_yards", "receiving_tds", "targets", "receptions",
    "fumbles_lost", "two_point",
)
SNAP_ALIASES = {
    "player_id": ["player_id", "gsis_id"],
    "season": ["season"],
    "week": ["week"],
    "team": ["team", "recent_team"],
    "offense_snaps": ["offense_snaps", "offensive_snaps", "off_snap"],
    "offense_pct": ["offense_pct", "offense_snap_pct", "offensive_pct"],
}
MASTER_ALIASES = {
    "player_id": ["gsis_id", "player_id", "id"],
    "display_name": ["display_name", "full_name", "player_name", "name"],
    "position": ["position", "position_group"],
    "team": ["recent_team", "team"],
}
SCHEDULE_ALIASES = {
    "season": ["season"],
    "week": ["week"],
    "home_team": ["home_team", "home"],
    "away_team": ["away_team", "away"],
    "home_score": ["home_score", "home_score_final"],
    "away_score": ["away_score", "away_score_final"],
}
DEPTH_ALIASES = {
    "player_id": ["gsis_id", "player_id"],
    "season": ["season"],
    "week": ["week"],
    "team": ["team", "club_code"],
    "position": ["pos_abb", "position", "pos_id", "pos"],
    "depth_rank": ["pos_rank", "depth_rank", "depth", "depth_position", "depth_order"],
    "updated": ["dt", "updated_at", "date"],
}
INJURY_ALIASES = {
    "player_id": ["gsis_id", "player_id", "nfl_id"],
    "week": ["week"],
    "status": ["report_status", "game_status", "status"],
    "injury": ["report_primary_injury", "injury_description", "injury"],
    "updated": ["date_modified", "report_date", "date"],
}
ROSTER_ALIASES = {
    "manager": ["manager", "team_manager", "owner", "fantasy_team", "fantasy_manager"],
    "player": ["player", "player_name", "name", "full_name"],
    "team": ["team", "nfl_team", "nfl", "tm"],
    "position": ["position", "pos"],
    "slot": ["slot", "roster_slot", "status", "lineup_slot"],
}
ROSTER_COLUMNS = (
    "manager", "player", "team", "position", "slot", "yahoo_status", "player_normalized",
)

# ------------------------------------------------------------- model features

FEATURE_METRICS = (
    "fantasy_points_std", "targets", "carries", "receiving_yards", "rushing_yards",
    "receptions", "offense_snaps", "offense_pct", "td_points",
    "red_zone_targets", "red_zone_carries",
)
# Metrics that `standardize_stats` leaves without nulls.
DENSE_METRICS = (
    "fantasy_points_std", "targets", "carries", "receiving_yards", "rushing_yards",
    "receptions", "td_points",
)
MOMENTUM_METRICS = (
    "fantasy_points_std", "targets", "carries", "offense_pct", "offense_snaps",
    "red_zone_targets", "red_zone_carries",
)
MODEL_FEATURES = (
    "fantasy_points_last", "fantasy_points_roll2", "fantasy_points_roll3",
    "fantasy_points_roll5", "fantasy_points_ewma",
    "targets_last", "targets_roll2", "targets_roll3", "targets_roll5", "targets_ewma",
    "carries_last", "carries_roll2", "carries_roll3", "carries_roll5", "carries_ewma",
    "receiving_yards_ewma", "rushing_yards_ewma", "offense_snaps_ewma",
    "offense_pct_ewma", "td_points_ewma",
    "opportunity_score", "opportunity_momentum", "production_momentum",
    "trend_gap", "td_dependency", "opponent_points_allowed_per_game",
)
