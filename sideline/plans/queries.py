"""Registered queries: every operator over the given tables, whole.

Doubles are shown with six places. Short decimals often end exactly between
two sixth places; the 1e-9 shift decides such ties the same way in every
engine, whatever the order of its sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.functions import numeric as N
from sideline.functions import text as X
from sideline.operators import compare, evaluate, events, forecast, identity, matchup, models, reconcile, schema
from sideline.operators import scoring, status, temporal, views
from sideline.plans import bindings as B
from sideline.plans import live
from sideline.schemas import (
    DENSE_METRICS, EVENT_COLUMNS, FEATURE_METRICS, MODEL_FEATURES, MOMENTUM_METRICS,
)
from sideline.session import shared_dir, stored
from sideline.sources import captures, snapshots, tables
from sideline.sources.snapshots import new_id
from sideline.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SEASON, WEEK = 2001, 8  # live target of the given data: last season, its next week
METADATA = {
    "app_version": "1.0", "feature_version": "features_v1", "scoring_version": "ffc_yahoo_v1",
    "primary_projection_model": "baseline_heuristic",
}
KEYS = ("player_id", "season", "week")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.rint((c + 1e-9) * 1e6) / 1e6 + F.lit(0.0)


def show(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns, doubles rounded, arrays as joined text."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if kinds[c] == "double":
            out.append(r6(c).alias(c))
        elif kinds[c] == "array<string>":
            out.append(F.array_join(c, "|").alias(c))
        elif kinds[c] == "array<double>":
            out.append(F.array_join(F.transform(c, lambda v: F.format_string("%.4f", F.round(v + 1e-9, 4))), "|").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for what a query writes, in the cluster's shared place."""
    return f"{shared_dir(spark)}/sideline/{name}_{new_id()}"


# ------------------------------------------------------------ shared stages


def history_features(spark, sf_dir, **kw):
    return temporal.player_features(temporal.with_carryover(B.usage(spark, sf_dir)), dense=DENSE_METRICS, **kw)


def pairs(spark, sf_dir):
    return temporal.walk_forward(B.usage(spark, sf_dir), dense=DENSE_METRICS)


def live_projections_full(spark, sf_dir, **kw):
    return live.current_projections(B.usage(spark, sf_dir), SEASON, WEEK, schedule=B.schedule(spark, sf_dir), dense=DENSE_METRICS, **kw)


def contexts(spark, sf_dir):
    injuries = status.latest_status(status.standardize_injuries(B.raw_injuries(spark, sf_dir), ascii_only=True), 20)
    return status.depth_context(status.standardize_depth(B.raw_depth(spark, sf_dir), ascii_only=True), injuries)


def roster(spark, sf_dir):
    # Row ids are not part of the canonical roster; they are set aside and kept.
    raw = B.raw_roster(spark, sf_dir)
    return captures.standardize_roster(raw, keep=("row_id",), ascii_only=True)


def master(spark, sf_dir):
    return identity.standardize_master(B.raw_master(spark, sf_dir), ascii_only=True)


def sheets(spark, sf_dir):
    return captures.parse_matchups(B.matchup_sheets(spark, sf_dir), week=B.SHEET_WEEK, league_id=B.SHEET_LEAGUE)


def sheet_roster(spark, sf_dir):
    """Roster mapping for the sheets: two in nine sit on another team, some have no id."""
    e = B.sheet_entries(spark, sf_dir)
    moved = F.col("key") % 9 > 6
    unit = F.col("position") == "DEF"
    return e.select(
        F.when(moved, "Elsewhere").otherwise(F.col("manager")).alias("manager"),
        F.when(F.col("key") % 5 == 1, F.concat(F.substring("player_name", 1, 7), F.col("key").cast("string"))).otherwise(F.col("player_name")).alias("player"),
        "position",
        F.when(unit, F.concat(F.lit("U"), F.col("key").cast("string"))).when(F.col("key") % 4 == 1, "BUF").otherwise("DAL").alias("team"),
        "slot",
        F.when(F.col("key") % 11 == 3, "").otherwise(F.concat(F.lit("C"), F.col("key").cast("string"))).alias("nflverse_player_id"),
        F.when(unit, "").otherwise(F.col("player_name")).alias("nflverse_name"),
    )


def kickoffs(spark, sf_dir):
    return compare.schedule_kickoffs(B.schedule(spark, sf_dir))


def comparison_rows(spark, sf_dir):
    return compare.comparison(B.own_forecasts(spark, sf_dir), B.rival_forecasts(spark, sf_dir), kickoffs(spark, sf_dir))


FIXED_WEIGHTS = {f: (0.31 if f.startswith("fantasy") else 0.07) * (1 + i % 4) for i, f in enumerate(MODEL_FEATURES)}


def fixed_ridge() -> models.RidgeModel:
    """A stored model with plain numbers, so that applying it can be checked in SQL."""
    features = [f for f in MODEL_FEATURES if f != "opponent_points_allowed_per_game"]
    return models.RidgeModel(
        features, {f: 2.0 for f in features}, {f: 4.0 for f in features}, {f: FIXED_WEIGHTS[f] for f in features},
        6.5, {"QB": 1.25, "RB": 0.5, "TE": -0.75, "WR": 0.25}, 1000,
    )


# ------------------------------------------------------------------- scans


@query
def stat_lines(spark, sf_dir):
    return show(
        B.stats(spark, sf_dir), *KEYS, "player_name", "position", "team", "opponent", "passing_yards",
        "passing_attempts", "interceptions", "targets", "fumbles_lost", "two_point", *EVENT_COLUMNS,
        "fantasy_points_std", "td_points", "non_td_fantasy_points",
    )


@query
def snaps_scan(spark, sf_dir):
    return show(temporal.standardize_snaps(B.raw_snaps(spark, sf_dir), ascii_only=True), *KEYS, "team", "offense_snaps", "offense_pct")


@query
def master_scan(spark, sf_dir):
    return master(spark, sf_dir)


@query
def schedule_scan(spark, sf_dir):
    raw = B.schedule(spark, sf_dir).withColumnsRenamed({"home_team": "home", "away_team": "away"})
    return tables.standardize_schedule(raw, ascii_only=True)


@query
def depth_scan(spark, sf_dir):
    return show(status.standardize_depth(B.raw_depth(spark, sf_dir), ascii_only=True), "player_id", "team", "position", "depth_rank", "updated")


@query
def injury_scan(spark, sf_dir):
    return status.standardize_injuries(B.raw_injuries(spark, sf_dir), ascii_only=True)


@query
def cached_table(spark, sf_dir):
    path = scratch(spark, "cached")
    tables.load_table(spark, path, loader=lambda s: B.table(s, sf_dir, "orders"))
    again = tables.load_table(spark, path)
    return again.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice")).alias("total"))


@query
def event_table_sink(spark, sf_dir):
    stored, _ = tables.build_event_table(spark, B.plays(spark, sf_dir), scratch(spark, "events"))
    return show(stored, "season", "week", "player_id", *EVENT_COLUMNS)


@query
def weekly_stats_source(spark, sf_dir):
    root = scratch(spark, "weekly")
    B.raw_stats(spark, sf_dir).write.partitionBy("season").parquet(f"{root}/stats")
    tables.build_event_table(spark, B.plays(spark, sf_dir), f"{root}/events")
    df = tables.load_weekly_stats(spark, f"{root}/stats", f"{root}/events", ascii_only=True)
    return show(df, *KEYS, "fantasy_points_std", "td_points")


@query
def csv_export(spark, sf_dir):
    path = scratch(spark, "csv")
    tables.write_csv(live_projections_full(spark, sf_dir).select("player_id", r6("projection").alias("projection"), "why"), path)
    back = spark.read.schema("player_id string, projection double, why string").csv(path, header=True, escape='"')
    return back.select("player_id", "projection", F.array_join(F.from_json("why", "array<string>"), "|").alias("why"))


@query
def tabular_roster(spark, sf_dir):
    path = scratch(spark, "tsv")
    B.raw_roster(spark, sf_dir).write.option("header", True).option("sep", "\t").csv(path)
    return captures.read_tabular_roster(spark, path, "tsv", ascii_only=True)


@query
def html_rosters(spark, sf_dir):
    return captures.html_rosters(B.html_pages(spark, sf_dir), ascii_only=True).select("page_id", "player", "team", "position", "player_normalized")


@query
def html_cells(spark, sf_dir):
    cells = captures.html_table_cells(B.html_pages(spark, sf_dir))
    return cells.groupBy("table_no", "col_no").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("cell").alias("texts"))


# -------------------------------------------------------------------- text


@query
def clean_documents(spark, sf_dir):
    cleaned = X.clean_text(F.col("text"))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.length(cleaned).alias("n"), F.md5(cleaned).alias("digest"))


@query
def name_keys(spark, sf_dir):
    name = F.col("player_name")
    return B.raw_roster(spark, sf_dir).select(
        "row_id",
        X.name_key(name, ascii_only=True).alias("name_key"),
        X.compact_key(name).alias("compact_key"),
        X.strip_labels(name, ascii_only=True).alias("stripped"),
        X.strip_labels_and_status(name).alias("bare_name"),
        X.inline_status(name, ascii_only=True).alias("inline_status"),
    )


@query
def document_keys(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.compact_key(F.col("text"))).alias("digest"))


CODES = ("jac", "LA", " STL ", "SD", "OAK", "wsh", "NWE", "TAM", "SFO", "KAN", "GNB", "NOR", "BUF", None)


@query
def team_codes(spark, sf_dir):
    at = (F.col("c_custkey") % len(CODES) + 1).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), at)
    return B.table(spark, sf_dir, "customer").select("c_custkey", X.team_code(code, ascii_only=True).alias("team"))


@query
def points_cells(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    cell = (
        F.when(k == 0, "–").when(k == 1, "-").when(k == 2, F.format_string("%.2f", "o_totalprice"))
        .when(k == 3, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_orderpriority"))
    )
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", r6(N.points_cell(cell)).alias("points"), N.is_points_cell(cell).alias("readable")
    )


@query
def row_math(spark, sf_dir):
    d, q = F.col("l_discount"), F.col("l_quantity")
    ratio = N.safe_ratio(q, d)
    odd = F.when(F.col("l_linenumber") == 1, float("inf")).when(F.col("l_linenumber") == 2, float("nan")).otherwise(q)
    return B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r6(ratio).alias("ratio"),
        r6(N.clip(ratio, 100, 500)).alias("clipped"),
        r6(N.floor_zero(F.nullif(q, F.lit(1.0)) - 25)).alias("floored"),
        r6(N.finite_or_zero(odd)).alias("finite"),
        r6(N.row_std([q, ratio, F.when(d > 0.05, q * d), F.lit(None).cast("double")], 4.0)).alias("spread"),
    )


# ----------------------------------------------------------------- scoring


@query
def rule_contributions(spark, sf_dir):
    rules = scoring.LEAGUE_RULES.touchdown_weights() | scoring.LEAGUE_RULES.other_weights()
    stats = B.stats(spark, sf_dir)
    totals = stats.groupBy("season").agg(*[F.sum(F.col(c) * w).alias(c) for c, w in rules.items()])
    return show(totals.unpivot(["season"], list(rules), "stat", "points"))


@query
def score_audit(spark, sf_dir):
    return show(scoring.scoring_audit(B.raw_stats(spark, sf_dir), B.scoring_events(spark, sf_dir), ascii_only=True))


@query
def audit_top20(spark, sf_dir):
    audit = scoring.scoring_audit(B.raw_stats(spark, sf_dir), B.scoring_events(spark, sf_dir), ascii_only=True)
    return show(scoring.largest_adjustments(audit.withColumn("pbp_adjustment", r6("pbp_adjustment"))))


@query
def defense_scores(spark, sf_dir):
    q = F.col("l_quantity")
    n = F.col("l_linenumber")
    lines = B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(
        F.count(F.lit(1)).cast("double").alias("sacks"),
        F.count_if(n == 1).cast("double").alias("interceptions"), F.count_if(n == 2).cast("double").alias("fumble_recoveries"),
        F.count_if(q > 45).cast("double").alias("defense_tds"), F.count_if(n == 7).cast("double").alias("safeties"),
        F.count_if(n == 6).cast("double").alias("blocked_kicks"), F.sum(F.when(n == 3, q)).alias("return_yards"),
        F.max("l_quantity").alias("points_allowed"),
    )
    return show(scoring.score_defense(lines), "l_suppkey", "l_shipdate", "points_allowed", "defense_points")


# ------------------------------------------------------------------ events


@query
def event_rollup(spark, sf_dir):
    return show(B.scoring_events(spark, sf_dir))


@query
def event_actor_modes(spark, sf_dir):
    df = events.event_rollup(B.plays(spark, sf_dir), actor_mode="coalesce")
    return show(df, "season", "week", "player_id", "return_yards", "return_tds")


@query
def event_availability(spark, sf_dir):
    return events.availability_report(B.plays(spark, sf_dir).drop("rush_touchdown", "kick_distance"))


@query
def event_totals(spark, sf_dir):
    return show(events.event_totals(B.scoring_events(spark, sf_dir)))


# ---------------------------------------------------------- joins and sets


@query
def duplicate_guard(spark, sf_dir):
    return schema.duplicate_keys(temporal.standardize_snaps(B.raw_snaps(spark, sf_dir), ascii_only=True), KEYS)


@query
def team_games(spark, sf_dir):
    return matchup.team_games(B.schedule(spark, sf_dir)).select("season", "week", "team", "opponent", "game_id")


@query
def opponent_join(spark, sf_dir):
    stats = B.stats(spark, sf_dir).select(*KEYS, "team")
    return matchup.attach_opponent(stats, B.schedule(spark, sf_dir), "week", strict=True).select(*KEYS, "team", "opponent")


@query
def union_by_name(spark, sf_dir):
    prior = temporal.carryover(B.usage(spark, sf_dir))
    both = temporal.feature_history(B.stats(spark, sf_dir), prior, 99)
    return show(both, *KEYS, "source_season", "source_week", "fantasy_points_std", "offense_snaps")


@query
def first_per_player(spark, sf_dir):
    m = master(spark, sf_dir)
    return identity.first_per_player(m.unionByName(m.withColumn("display_name", F.upper("display_name"))), ["display_name", "team"])


# ---------------------------------------------------------------- temporal


@query
def usage_merge(spark, sf_dir):
    return show(B.usage(spark, sf_dir), *KEYS, "fantasy_points_std", "offense_snaps", "offense_pct")


@query
def carryover(spark, sf_dir):
    return show(temporal.carryover(B.usage(spark, sf_dir)), *KEYS, "source_season", "source_week", "fantasy_points_std", "offense_pct")


@query
def feature_history(spark, sf_dir):
    df = temporal.with_carryover(B.usage(spark, sf_dir)).where(F.col("week") < WEEK)
    return show(df, *KEYS, "source_season", "source_week", "fantasy_points_std")


@query
def rolling_features(spark, sf_dir):
    return show(history_features(spark, sf_dir), *KEYS, *[f"{m}_{s}" for m in FEATURE_METRICS for s in ("last", "roll2", "roll3", "roll5")])


@query
def ewma_features(spark, sf_dir):
    return show(history_features(spark, sf_dir), *KEYS, *[f"{m}_ewma" for m in FEATURE_METRICS])


@query
def momentum(spark, sf_dir):
    return show(history_features(spark, sf_dir), *KEYS, *[f"{m}_momentum" for m in MOMENTUM_METRICS])


SCORES = (
    "fantasy_per_target", "fantasy_per_carry", "td_rate", "opportunity_score", "opportunity_momentum", "efficiency_score",
    "td_dependency", "sustainability_risk", "production_momentum", "trend_gap", "games_played",
)


@query
def feature_scores(spark, sf_dir):
    return show(history_features(spark, sf_dir), *KEYS, *SCORES)


@query
def asof_requests(spark, sf_dir):
    """Many target weeks of every player-season at once."""
    usage = B.usage(spark, sf_dir)
    requests = usage.select("player_id", "season").distinct().select("*", F.explode(F.array(*[F.lit(w) for w in (1, 3, 6, 9, 12, 20)])).alias("target_week"))
    found = temporal.features_asof(temporal.with_carryover(usage), requests, ["fantasy_points_ewma", "targets_roll3", "opportunity_score", "games_played"], dense=DENSE_METRICS)
    return show(found)


@query
def live_features(spark, sf_dir):
    df = temporal.features_before(temporal.with_carryover(B.usage(spark, sf_dir)), WEEK, dense=DENSE_METRICS)
    return show(df, *KEYS, "fantasy_points_ewma", "targets_roll3", "opportunity_score", "games_played")


@query
def recent_form(spark, sf_dir):
    return show(views.recent_form(temporal.with_carryover(B.usage(spark, sf_dir))))


@query
def form_series(spark, sf_dir):
    return show(views.form_series(temporal.with_carryover(B.usage(spark, sf_dir))))


# ----------------------------------------------------------------- matchup


@query
def defense_history(spark, sf_dir):
    return show(matchup.defense_history(B.stats(spark, sf_dir), target_week=7))


@query
def defense_attached(spark, sf_dir):
    stats = B.stats(spark, sf_dir)
    history = matchup.defense_history(stats, target_week=7)
    rows = stats.where(F.col("week") == 7).withColumn("position_group", F.lower("position"))
    df = matchup.attach_defense(rows, history, target_week=7)
    return show(df, *KEYS, "opponent", "position_group", "opponent_points_allowed_per_game")


@query
def opponent_asof(spark, sf_dir):
    return show(matchup.defense_asof(B.stats(spark, sf_dir), B.schedule(spark, sf_dir)))


# ---------------------------------------------------------------- forecast


@query
def baseline_forecast(spark, sf_dir):
    df = forecast.project(history_features(spark, sf_dir))
    return show(df, *KEYS, "baseline_projection", "volatility", "range_low", "range_high", "confidence")


@query
def classification(spark, sf_dir):
    return show(forecast.project(history_features(spark, sf_dir)), *KEYS, "classification")


@query
def reasons(spark, sf_dir):
    return show(forecast.explain(forecast.project(history_features(spark, sf_dir))), *KEYS, "why")


@query
def signals(spark, sf_dir):
    return show(forecast.signal_chips(forecast.project(history_features(spark, sf_dir))), *KEYS, "signals")


@query
def explanations(spark, sf_dir):
    df = forecast.explanation_columns(forecast.project(history_features(spark, sf_dir)))
    return show(df, *KEYS, "consistency_part", "opportunity_part", "raw_confidence", "confidence_bound")


@query
def explanation_texts(spark, sf_dir):
    df = forecast.explanation_columns(forecast.project(history_features(spark, sf_dir)))
    return df.select(*KEYS, "signal_text", "confidence_text")


@query
def live_projections(spark, sf_dir):
    df = live_projections_full(spark, sf_dir, master=live_master(spark, sf_dir), ridge=fixed_ridge(), depth=contexts(spark, sf_dir))
    return show(
        df, "player_id", "player_name", "position", "team", "opponent", "projection", "baseline_projection",
        "learned_weight_projection", "range_low", "range_high", "confidence", "classification", "why",
        "depth_role", "depth_note", "depth_adjustment",
    )


def live_master(spark, sf_dir):
    """Supplier names as player master; every fourth player has no team there."""
    s = B.table(spark, sf_dir, "supplier")
    raw = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("player_id"), F.upper("s_name").alias("display_name"),
        F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("M"), F.col("s_nationkey").cast("string"))).alias("team"),
        F.element_at(F.array(*[F.lit(p) for p in B.POSITIONS]), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("position"),
    )
    return identity.standardize_master(raw, ascii_only=True)


@query
def final_projection(spark, sf_dir):
    df = forecast.project(history_features(spark, sf_dir))
    df = models.apply_ridge(df, fixed_ridge())
    df = df.withColumn("learned_weight_projection", F.when(F.col("week") % 2 == 0, F.col("learned_weight_projection")))
    return show(forecast.final_projection(df), *KEYS, "projection", "range_low", "range_high")


# -------------------------------------------------------- status and depth


@query
def latest_status(spark, sf_dir):
    return status.latest_status(status.standardize_injuries(B.raw_injuries(spark, sf_dir), ascii_only=True), 20)


@query
def latest_status_first(spark, sf_dir):
    injuries = status.standardize_injuries(B.raw_injuries(spark, sf_dir), ascii_only=True)
    return status.latest_status(injuries, 20, latest_first=True)


@query
def depth_context(spark, sf_dir):
    return show(contexts(spark, sf_dir))


@query
def depth_capped(spark, sf_dir):
    df = live_projections_full(spark, sf_dir, depth=contexts(spark, sf_dir))
    return show(df, "player_id", "position", "projection", "baseline_projection", "range_low", "range_high", "depth_role", "depth_adjustment")


# ---------------------------------------------------------------- identity

MATCHED = (
    "row_id", "player", "player_normalized", "nflverse_player_id", "nflverse_name", "nflverse_team", "nflverse_position",
    "match_method", "match_confidence",
)


def ladder(spark, sf_dir, fuzzy):
    return identity.match_ladder(roster(spark, sf_dir), master(spark, sf_dir), row_id="row_id", fuzzy=fuzzy, ascii_only=True)


@query
def roster_standard(spark, sf_dir):
    return roster(spark, sf_dir)


@query
def match_ladder(spark, sf_dir):
    return ladder(spark, sf_dir, False).select(*MATCHED)


@query
def match_overrides(spark, sf_dir):
    """The ladder with an audited identity for every tenth roster name."""
    rows = roster(spark, sf_dir)
    names = rows.where("position <> 'DEF'").groupBy("player_normalized").agg(F.min("row_id").alias("n")).where("n LIKE '%0'")
    audited = names.select(
        F.col("player_normalized").alias("name_normalized"), F.concat(F.lit("A"), F.col("n")).alias("player_id"),
        F.upper("player_normalized").alias("display_name"), F.lit("KC").alias("team"), F.lit("WR").alias("position"),
    )
    found = identity.match_ladder(rows, master(spark, sf_dir), row_id="row_id", fuzzy=False, ascii_only=True, overrides=audited)
    return found.select(*MATCHED)


@query
def match_fuzzy(spark, sf_dir):
    return ladder(spark, sf_dir, True).select(*MATCHED)


@query
def mapping_counters(spark, sf_dir):
    return identity.mapping_counters(ladder(spark, sf_dir, False))


@query
def unmatched_roster(spark, sf_dir):
    return identity.unmatched_rows(ladder(spark, sf_dir, False)).select("row_id", "player", "team")


@query
def reconcile_coverage(spark, sf_dir):
    captured, _ = sheets(spark, sf_dir)
    coverage, _ = reconcile.reconcile(captured, sheet_roster(spark, sf_dir), strict=False)
    return show(coverage.drop("source_file"))


@query
def reconcile_unexpected(spark, sf_dir):
    captured, _ = sheets(spark, sf_dir)
    _, unexpected = reconcile.reconcile(captured, sheet_roster(spark, sf_dir), strict=False)
    return show(unexpected, "player_name", "team", "position", "manager", "slot", "yahoo_projection", "source_file")


@query
def coverage_summary(spark, sf_dir):
    captured, _ = sheets(spark, sf_dir)
    coverage, unexpected = reconcile.reconcile(captured, sheet_roster(spark, sf_dir), strict=False)
    return reconcile.coverage_summary(coverage, captured, unexpected)


# ---------------------------------------------------------------- captures


@query
def parse_rosters(spark, sf_dir):
    return captures.parse_roster_pages(B.roster_pages(spark, sf_dir), ascii_only=True)


@query
def parse_matchups(spark, sf_dir):
    captured, _ = sheets(spark, sf_dir)
    return show(captured)


@query
def matchup_rejects(spark, sf_dir):
    return sheets(spark, sf_dir)[1]


@query
def capture_filters(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), F.col("text").alias("value"))
    everything = docs.unionByName(B.roster_pages(spark, sf_dir)).unionByName(B.matchup_sheets(spark, sf_dir))
    return everything.select(
        "source_file", captures.roster_line_count(F.col("value")).alias("team_lines"),
        captures.is_roster_capture(F.col("value")).alias("roster"), captures.is_matchup_capture(F.col("value")).alias("matchup"),
    )


@query
def import_batch(spark, sf_dir):
    root = scratch(spark, "imports")
    B.matchup_sheets(spark, sf_dir).write.partitionBy("source_file").text(f"{root}/texts")
    files = f"{root}/texts/source_file=*/*.txt"
    summary = captures.import_captures(
        spark, files, sheet_roster(spark, sf_dir), root, season=2026, week=B.SHEET_WEEK, league_id=B.SHEET_LEAGUE,
        batch_id=new_id(), strict=False,
    )
    return summary.drop("imported_at_utc", "batch_id")


# -------------------------------------------------------------- comparison


@query
def kickoff_times(spark, sf_dir):
    return kickoffs(spark, sf_dir)


@query
def pregame_gate(spark, sf_dir):
    df = compare.pregame_gate(B.rival_forecasts(spark, sf_dir), kickoffs(spark, sf_dir))
    return df.select("player_id", "season", "target_week", "team", "kickoff_utc", "kickoff_status")


@query
def comparison_refused(spark, sf_dir):
    df = compare.refused(B.rival_forecasts(spark, sf_dir), kickoffs(spark, sf_dir))
    return df.select("player_id", "season", "target_week", "team", "kickoff_status")


@query
def comparison(spark, sf_dir):
    return show(
        comparison_rows(spark, sf_dir), *compare.KEYS, "player_name_ours", "final_projection", "yahoo_projection", "our_error",
        "kickoff_status", "benchmark_schema_version",
    )


@query
def comparison_finalized(spark, sf_dir):
    df = compare.attach_actuals(comparison_rows(spark, sf_dir), B.actuals(spark, sf_dir))
    return show(
        df, *compare.KEYS, "actual_points", "actual_status", "our_error", "rival_error", "our_absolute_error", "rival_absolute_error"
    )


@query
def head_to_head(spark, sf_dir):
    return show(compare.head_to_head(compare.attach_actuals(comparison_rows(spark, sf_dir), B.actuals(spark, sf_dir))))


@query
def comparison_batch(spark, sf_dir):
    root = scratch(spark, "comparison")
    batch = snapshots.save_comparison(comparison_rows(spark, sf_dir), root)
    stored = spark.read.parquet(root).where(F.col("batch_id") == batch)
    return show(stored, *compare.KEYS, "final_projection", "yahoo_projection")


# --------------------------------------------------------------- snapshots


def league(spark, sf_dir):
    p = B.people(spark, sf_dir)
    forecasts = p.select(
        F.when((F.col("key") % 10 == 4) | (F.col("key") % 17 == 1), " ").otherwise(F.concat(F.lit("C"), F.col("key").cast("string"))).alias("player_id"),
        F.col("full_name").alias("player_name"), "position", "team",
        F.when(F.col("key") % 19 != 2, F.abs("balance") / 100).alias("projection"),
        (F.abs("balance") / 120).alias("baseline_projection"), (F.col("balance") / 50).alias("confidence"),
        F.lit("Stable").alias("classification"),
    )
    return snapshots.league_scope(B.mapped_roster(spark, sf_dir), forecasts)


@query
def league_snapshot(spark, sf_dir):
    return show(
        league(spark, sf_dir), "key", "player_id", "player_name", "position", "team", "fantasy_manager", "roster_slot",
        "projection", "snapshot_scope", "forecast_status",
    )


@query
def snapshot_frame(spark, sf_dir):
    df = snapshots.snapshot_frame(
        league(spark, sf_dir), snapshot_id="fixed", captured_at_utc="2001-08-01T00:00:00Z", season=SEASON, target_week=WEEK, metadata=METADATA
    )
    return show(df)


@query
def snapshot_manifest(spark, sf_dir):
    root = scratch(spark, "snapshots")
    for week in (WEEK - 1, WEEK):
        snapshots.save_snapshot(league(spark, sf_dir), root, season=SEASON, target_week=week, metadata=METADATA)
    return snapshots.snapshot_index(spark, root).select(
        "schema_version", "season", "target_week", "row_count", "app_version", "feature_version", "scoring_version", "primary_projection_model"
    )


@query
def report_archive(spark, sf_dir):
    root = scratch(spark, "reports")
    report = show(evaluate.forecast_metrics(forecast.project(pairs(spark, sf_dir))))
    snapshots.save_report(report, root, [1996, 1997], 1998)
    snapshots.save_report(report, root, [1996], 1997, experiment="defensive_matchup_candidate")
    return snapshots.load_reports(spark, root).select(
        "position", "model", "examples", "mae", "holdout_season", "training_seasons", "experiment", "source", "precision", "review_status"
    )


@query
def project_report(spark, sf_dir):
    root = scratch(spark, "project")
    report = show(evaluate.forecast_metrics(forecast.project(pairs(spark, sf_dir))))
    snapshots.save_report(report, root, [1996, 1997], 1998)
    snapshots.save_snapshot(league(spark, sf_dir), root, season=SEASON, target_week=WEEK, metadata=METADATA)
    parts = snapshots.project_report(spark, root, root, root)
    holdout = parts["holdout"].select("model", F.col("examples").alias("n"), r6("mae").alias("value"))
    latest = parts["snapshots"].select(F.lit("snapshot").alias("model"), F.col("row_count").alias("n"), F.lit(None).cast("double").alias("value"))
    ready = parts["status"].select(F.col("coverage").alias("model"), F.col("imports").alias("n"), F.lit(None).cast("double").alias("value"))
    return holdout.unionByName(latest).unionByName(ready)


# ------------------------------------------------------------------- views


def forecast_pool(spark, sf_dir):
    return forecast.final_projection(forecast.explain(forecast.project(live_latest(spark, sf_dir))))


def live_latest(spark, sf_dir):
    history = live.live_history(B.usage(spark, sf_dir), SEASON, WEEK)
    return temporal.latest_per_history(temporal.player_features(history, dense=DENSE_METRICS))


def taken(spark, sf_dir):
    """Two thirds of the suppliers are on rosters; some roster ids are blank."""
    s = B.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.when(k % 3 == 0, F.concat(F.lit(" S"), k.cast("string"))).when(k % 3 == 1, "").otherwise(F.concat(F.lit("X"), k.cast("string"))).alias("nflverse_player_id"))


def waiver(spark, sf_dir):
    df = views.waiver_pool(forecast_pool(spark, sf_dir), taken(spark, sf_dir))
    return df.withColumn("waiver_discovery_score", r6("waiver_discovery_score"))


@query
def waiver_pool(spark, sf_dir):
    return waiver(spark, sf_dir).select("player_id", "position", "waiver_discovery_score")


@query
def waiver_top30(spark, sf_dir):
    return views.top_n(waiver(spark, sf_dir), "waiver_discovery_score", 30).select("player_id", "waiver_discovery_score")


@query
def waiver_top30_position(spark, sf_dir):
    df = views.top_n(waiver(spark, sf_dir), "waiver_discovery_score", 30, by="position")
    return df.select("player_id", "position", "rank", "waiver_discovery_score")


@query
def top20_projections(spark, sf_dir):
    df = forecast_pool(spark, sf_dir).withColumn("projection", r6("projection"))
    return show(views.top_n(df, "projection", 20), "player_id", "player_name", "position", "projection", "range_low", "range_high", "confidence", "classification")


@query
def roster_view(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    rows = s.select(
        F.col("s_suppkey").alias("source_order"), B.manager_name(F.col("s_suppkey")).alias("manager"), F.col("s_name").alias("player"),
        F.when(F.col("s_suppkey") % 8 == 0, "").otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("nflverse_player_id"),
    )
    df = views.roster_view(rows, forecast_pool(spark, sf_dir), sort="desc")
    return show(df, "source_order", "manager", "player", "projection", "confidence", "classification", "why")


@query
def target_week(spark, sf_dir):
    return B.stats(spark, sf_dir).groupBy("season").agg((F.max("week") + 1).alias("target_week"))


# -------------------------------------------------- learning and evaluation


@query
def walk_forward(spark, sf_dir):
    return show(
        pairs(spark, sf_dir), "player_id", "season", "target_week", "target_next_week", "position", "fantasy_points_ewma",
        "opportunity_score", "trend_gap", "td_dependency", "games_played",
    )


@query
def walk_forward_matchup(spark, sf_dir):
    stats = B.usage(spark, sf_dir)
    df = matchup.add_matchup_feature(temporal.walk_forward(stats, dense=DENSE_METRICS), stats, B.schedule(spark, sf_dir))
    return show(df, "player_id", "season", "target_week", "opponent", "opponent_points_allowed_per_game", "target_next_week")


@query
def backtest_rows(spark, sf_dir):
    return show(evaluate.backtest(B.usage(spark, sf_dir), dense=DENSE_METRICS))


@query
def backtest_summary(spark, sf_dir):
    return show(evaluate.backtest_summary(evaluate.backtest(B.usage(spark, sf_dir), dense=DENSE_METRICS)))


@query
def holdout_metrics_grouped(spark, sf_dir):
    test = models.apply_ridge(forecast.project(pairs(spark, sf_dir)), fixed_ridge())
    return show(evaluate.forecast_metrics(test))


@query
def feature_moments(spark, sf_dir):
    rows = models.design_matrix(pairs(spark, sf_dir))
    names = [c for c in rows.columns]
    return show(
        rows.agg(*[F.avg(c).alias(f"{c}__mean") for c in names], *[F.stddev_pop(c).alias(f"{c}__std") for c in names])
        .unpivot([], [f"{c}__{k}" for c in names for k in ("mean", "std")], "statistic", "value")
    )


@query
def design_matrix(spark, sf_dir):
    return show(models.design_matrix(pairs(spark, sf_dir), keep=["player_id", "season", "target_week"]))


@query
def ridge_scores(spark, sf_dir):
    df = models.apply_ridge(pairs(spark, sf_dir), fixed_ridge())
    return show(df, "player_id", "season", "target_week", "learned_weight_projection")


@query
def ridge_weights(spark, sf_dir):
    return show(models.fit_ridge(pairs(spark, sf_dir)).report(spark))


@query
def fold_ridge_metrics(spark, sf_dir):
    """Every season but the first as the holdout of a ridge on all seasons before it."""
    seasons = range(1996, 2002)
    folds = {h: train for train, h in live.fold_table(seasons, earliest=1995)}
    rows = stored(live.fold_columns(forecast.project(pairs(spark, sf_dir))), "fold-rows")
    report = evaluate.forecast_metrics(live.fold_forecasts(rows, folds, tree_settings=None), by={"season": list(seasons)})
    return show(report.where("examples > 0"))


@query
def gbt_scores(spark, sf_dir):
    wanted = {"player_id", "target_week", "season", "position", "target_next_week", *MODEL_FEATURES}
    rows = pairs(spark, sf_dir)
    rows = stored(rows.select(*[c for c in rows.columns if c in wanted]), "tree-rows")  # read for bins, blocks, and the scoring
    trees = models.fit_trees(rows, SEASON)
    return models.apply_trees(rows, trees).select("player_id", "season", "target_week", "ml_projection")


@query
def holdout_report(spark, sf_dir):
    return live.holdout(B.usage(spark, sf_dir), B.schedule(spark, sf_dir), range(1995, 2001), 2001, dense=DENSE_METRICS)


@query
def multi_fold_report(spark, sf_dir):
    return live.multi_fold(B.usage(spark, sf_dir), B.schedule(spark, sf_dir), (2000, 2001), dense=DENSE_METRICS)


# --------------------------------------------------------------- streaming


def _stream(spark, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """The rows as a file stream: written once, then read as they arrive, so many files a batch if given."""
    path = scratch(spark, name)
    df.write.parquet(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _drain(spark, stream: DataFrame, name: str) -> DataFrame:
    out, state = scratch(spark, f"{name}_out"), streams.checkpoint_location(spark, f"{name}_{new_id()}")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_events(spark, sf_dir):
    timed = B.plays(spark, sf_dir, F.col("l_shipdate").cast("timestamp").alias("ts"))
    # One play without any event, far in the future, closes every real week.
    last = timed.agg(F.max("season").alias("season"), F.max("week").alias("week"), F.max("ts").alias("ts"))
    closing = last.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 400 DAYS"), "season_type": F.lit("REG"), "kicker_player_id": F.lit("none")})
    stream = _stream(spark, timed.unionByName(closing, allowMissingColumns=True), "plays")
    month_end = F.add_months(F.make_date("season", "week", F.lit(1)), 1).cast("timestamp")
    rolled = streams.stream_event_rollup(stream, week_end=month_end, delay="1 day")
    return show(_drain(spark, rolled, "events"), "season", "week", "player_id", *EVENT_COLUMNS)


@query
def stream_status(spark, sf_dir):
    injuries = status.standardize_injuries(B.raw_injuries(spark, sf_dir), ascii_only=True)
    path = scratch(spark, "status")
    files = spark.sparkContext.defaultParallelism  # of each of four batches, so that every core writes and reads its share
    arriving = _stream(spark, injuries.repartition(4 * files), "injuries", files=files)
    streams.write_changes(streams.stream_latest_status(arriving, 20), path, f"status_{new_id()}").awaitTermination()
    return streams.current_status(spark, path).select("player_id", "injury_flag", "injury_note", "season_ending")


@query
def stream_gate(spark, sf_dir):
    stream = _stream(spark, B.rival_forecasts(spark, sf_dir), "captures")
    gated = streams.stream_pregame_gate(stream, kickoffs(spark, sf_dir)).drop("kickoff_utc", "capture_time", "kickoff_time")
    return _drain(spark, gated, "gate").select("player_id", "season", "target_week", "team", "kickoff_status")
