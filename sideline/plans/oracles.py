"""The registered queries in SQL, written independently of the DataFrame code.

Views are common table expressions with named dependencies; ``_sql`` puts the
needed ones in front of a final select. The EWMA here is the plain recursion
as a list fold, the windows are spelled out, the ladder is one join per rung.
"""

from __future__ import annotations

from sideline.operators.forecast import SIGNAL_TEXT
from sideline.schemas import (
    EVENT_COLUMNS, FEATURE_METRICS, MODEL_FEATURES, MOMENTUM_METRICS, OFFENSE, SNAPSHOT_COLUMNS,
)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
ORACLES: dict[str, str] = {}
SEASON, WEEK = 2001, 8
KEYS = "player_id, season, week"


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def _ordered(names: tuple[str, ...], seen: dict[str, None]) -> None:
    for n in names:
        if n not in seen:
            _ordered(CTES[n][1], seen)
            seen[n] = None


def _sql(final: str, *needs: str) -> str:
    seen: dict[str, None] = {}
    _ordered(needs, seen)
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in seen)
    return f"WITH {head}\n{final}" if head else final


def r6(expr: str, alias: str | None = None) -> str:
    out = f"round(({expr}) + 1e-9, 6) + 0.0::DOUBLE"
    return f"{out} AS {alias}" if alias else out


def r6s(*columns: str) -> str:
    return ", ".join(r6(c, c) for c in columns)


def z(c: str) -> str:
    return f"coalesce({c}, 0.0::DOUBLE)"


def t(c: str) -> str:
    """Threshold value."""
    return f"round({z(c)}, 9)"


def sum_when(cond: str, value: str = "1.0::DOUBLE") -> str:
    return f"sum(CASE WHEN {cond} THEN {value} ELSE 0.0::DOUBLE END)"


# ------------------------------------------------------------------ bindings

POS5 = "(['QB','RB','WR','TE','K'])"
POS4 = "(['QB','RB','WR','TE'])"

cte("raw_stats", f"""
SELECT 'S' || s_suppkey AS player_id, s_name AS player_name, {POS5}[(s_suppkey % 5 + 1)::INT] AS position,
  'T' || s_nationkey AS team,
  CASE WHEN (season * 12 + week - s_nationkey) % 25 = s_nationkey THEN ''
       ELSE 'T' || ((season * 12 + week - s_nationkey) % 25) END AS opponent,
  w.* EXCLUDE (k)
FROM (SELECT l_suppkey AS k, year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS week,
  {sum_when("l_returnflag='A'", 'l_quantity')} AS passing_yards, {sum_when("l_returnflag='A'")} AS passing_attempts,
  {sum_when("l_returnflag='A' AND l_quantity > 40")} AS passing_tds,
  {sum_when("l_returnflag='A' AND l_quantity <= 5")} AS interceptions,
  {sum_when("l_returnflag='N'", 'l_quantity')} AS rushing_yards, {sum_when("l_returnflag='N'")} AS carries,
  {sum_when("l_returnflag='N' AND l_quantity > 40")} AS rushing_tds,
  {sum_when("l_returnflag='N' AND l_quantity <= 5")} AS fumbles_lost,
  {sum_when("l_returnflag='R'", 'l_quantity')} AS receiving_yards, {sum_when("l_returnflag='R'")} AS targets,
  {sum_when("l_returnflag='R' AND l_quantity > 40")} AS receiving_tds,
  {sum_when("l_returnflag='R' AND l_linestatus='F'")} AS receptions,
  {sum_when("l_linenumber=7 AND l_quantity > 45")} AS two_point,
  {sum_when("l_returnflag='R' AND l_quantity <= 20")} AS red_zone_targets,
  {sum_when("l_returnflag='N' AND l_quantity <= 20")} AS red_zone_carries
  FROM lineitem GROUP BY ALL) w JOIN supplier ON s_suppkey = w.k""")

cte("snaps", """
SELECT 'S' || k AS player_id, season, week, off_snap AS offense_snaps,
  CASE WHEN (k + week) % 5 <> 0 THEN pct END AS offense_pct
FROM (SELECT l_suppkey AS k, year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS week, l_linestatus,
  count(*) * 3.0::DOUBLE AS off_snap, count(*) * 5.0::DOUBLE AS pct FROM lineitem GROUP BY ALL)""")

cte("plays", """
SELECT year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS week, l_quantity AS q, l_linenumber AS n,
  l_returnflag AS ret, l_linestatus AS st, 'S' || l_suppkey AS supplier, 'P' || l_partkey AS part
FROM lineitem WHERE month(l_shipdate) <> 12""")


def _event_rows(returner: str) -> str:
    rows = [
        ("supplier", "passing_tds_40_plus", "1.0", "ret='R' AND st='O' AND q >= 40"),
        ("supplier", "rushing_tds_40_plus", "1.0", "ret='R' AND st='F' AND q >= 40"),
        ("part", "receiving_tds_40_plus", "1.0", "ret='R' AND st='O' AND q >= 40 AND n <> 1"),
        (returner, "return_yards", "q", "n % 3 = 0"),
        (returner, "return_tds", "1.0", "n % 3 = 0 AND q > 49"),
        ("supplier", "offensive_fumble_return_tds", "1.0", "n = 6 AND q > 48"),
        ("supplier", "extra_points_made", "1.0", "n = 4"),
        ("supplier", "field_goal_yards_made", "q", "n = 5 AND q >= 20"),
    ]
    return " UNION ALL ".join(
        f"SELECT season, week, {who} AS player_id, '{event}' AS event, {value}::DOUBLE AS value FROM plays WHERE {cond}"
        for who, event, value, cond in rows
    )


def _events(source: str) -> str:
    sums = ", ".join(f"sum(CASE WHEN event='{e}' THEN value ELSE 0.0::DOUBLE END) AS {e}" for e in EVENT_COLUMNS)
    return f"SELECT season, week, player_id, {sums} FROM ({source}) GROUP BY season, week, player_id"


cte("events_t", _events(_event_rows("supplier")), "plays")

TD = {
    "passing_tds": 6.0, "rushing_tds": 6.0, "receiving_tds": 6.0, "passing_tds_40_plus": 1.0, "rushing_tds_40_plus": 1.0,
    "receiving_tds_40_plus": 1.0, "return_tds": 6.0, "offensive_fumble_return_tds": 6.0,
}
OTHER = {
    "passing_yards": 0.04, "interceptions": -2.0, "rushing_yards": 0.1, "receiving_yards": 0.1, "fumbles_lost": -2.0,
    "two_point": 2.0, "return_yards": 0.04, "extra_points_made": 1.0, "field_goal_yards_made": 0.1,
}


def _points(weights: dict[str, float], skip: tuple[str, ...] = ()) -> str:
    return " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in weights.items() if c not in skip)


cte("stats", f"""
SELECT *, td_points + {_points(OTHER)} AS fantasy_points_std, {_points(OTHER)} AS non_td_fantasy_points
FROM (SELECT *, {_points(TD)} AS td_points FROM (
  SELECT r.*, {", ".join(f"{z('e.' + c)} AS {c}" for c in EVENT_COLUMNS)}
  FROM raw_stats r LEFT JOIN events_t e USING (season, week, player_id)))""", "raw_stats", "events_t")

cte("usage_t", """
SELECT s.*, b.offense_snaps, b.offense_pct FROM stats s LEFT JOIN (
  SELECT player_id, season, week, max(offense_snaps) AS offense_snaps, max(offense_pct) AS offense_pct
  FROM snaps GROUP BY ALL) b USING (player_id, season, week)""", "stats", "snaps")

cte("ranked", "SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY week DESC)::INT AS back FROM usage_t", "usage_t")
cte("carry", """
SELECT * EXCLUDE (back) REPLACE (season + 1 AS season, -back AS week), ranked.season AS source_season, ranked.week AS source_week
FROM ranked WHERE back <= 3""", "ranked")
cte("history", """
SELECT * EXCLUDE (back), season AS source_season, week AS source_week FROM ranked
UNION ALL BY NAME SELECT * FROM carry""", "ranked", "carry")
cte("live_hist", f"SELECT * FROM history WHERE season = {SEASON} AND week < {WEEK}", "history")

# ------------------------------------------------------------------ features

W = "PARTITION BY player_id, season ORDER BY week"


def _features(source: str) -> str:
    cols = []
    for m in FEATURE_METRICS:
        cols.append(f"{m} AS {m}_last")
        for n in (2, 3, 5):
            cols.append(f"avg({m}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {m}_roll{n}")
        seen = f"list({{'y': {m}::DOUBLE, 'ow': 1.0::DOUBLE}}) OVER ({W} ROWS UNBOUNDED PRECEDING)"
        cols.append(
            f"list_reduce({seen}, lambda a, b: CASE WHEN a.y IS NULL THEN b"
            " WHEN b.y IS NULL THEN {'y': a.y, 'ow': a.ow * 0.55::DOUBLE}"
            " ELSE {'y': (a.ow * 0.55::DOUBLE * a.y + 0.45::DOUBLE * b.y) / (a.ow * 0.55::DOUBLE + 0.45::DOUBLE),"
            f" 'ow': 1.0::DOUBLE}} END).y AS {m}_ewma"
        )
    for m in MOMENTUM_METRICS:
        cols.append(
            f"avg({m}) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
            f" - avg({m}) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS {m}_momentum"
        )
    first = (
        f"SELECT *, {', '.join(cols)}, row_number() OVER ({W})::INT AS games_played,"
        f" lead(week) OVER ({W}) AS target_week, lead(fantasy_points_std) OVER ({W}) AS target_next_week FROM {source}"
    )
    second = f"""
SELECT *, {", ".join(f"fantasy_points_std_{s} AS fantasy_points_{s}" for s in ("last", "roll2", "roll3", "roll5", "ewma"))},
  {z('targets_ewma')} + {z('carries_ewma')} * 0.55 + {z('offense_pct_ewma')} * 0.06
    + {z('red_zone_targets_ewma')} * 1.4 + {z('red_zone_carries_ewma')} * 1.1 AS opportunity_score,
  {z('targets_momentum')} + 0.55 * {z('carries_momentum')} + 0.03 * {z('offense_pct_momentum')}
    + 0.5 * {z('red_zone_targets_momentum')} + 0.4 * {z('red_zone_carries_momentum')} AS opportunity_momentum,
  fantasy_points_std_momentum AS production_momentum,
  CASE WHEN abs(targets) > 1e-9 THEN fantasy_points_std / targets END AS fantasy_per_target,
  CASE WHEN abs(carries) > 1e-9 THEN fantasy_points_std / carries END AS fantasy_per_carry,
  CASE WHEN abs(fantasy_points_std) > 1e-9 THEN td_points / abs(fantasy_points_std) END AS td_rate
FROM ({first})"""
    return f"""
SELECT *, 0.65 * {z('td_dependency')} AS sustainability_risk FROM (
SELECT *, CASE WHEN abs(opportunity_score) > 1e-9 THEN {z('fantasy_points_ewma')} / opportunity_score END AS efficiency_score,
  CASE WHEN abs({z('fantasy_points_ewma')}) > 1e-9 THEN td_points_ewma / abs(fantasy_points_ewma) END AS td_dependency,
  opportunity_momentum - {z('production_momentum')} AS trend_gap FROM ({second}))"""


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


VOL = "[fantasy_points_last, fantasy_points_roll2, fantasy_points_roll3, fantasy_points_roll5, fantasy_points_ewma]"
LABEL = f"""CASE WHEN {t('opportunity_momentum')} > 2 AND {t('trend_gap')} > 1 THEN 'Emerging opportunity'
 WHEN {t('td_dependency')} > 0.55 AND {t('production_momentum')} > 0 THEN 'TD-dependent production'
 WHEN {t('production_momentum')} < -1 AND {t('opportunity_momentum')} < -1 THEN 'Downtrend confirmed'
 WHEN {t('production_momentum')} > 1 AND {t('opportunity_momentum')} > 1 THEN 'Momentum confirmed'
 WHEN {t('production_momentum')} > 1 AND {t('opportunity_momentum')} < -1 THEN 'Efficiency / regression watch'
 ELSE 'Stable' END"""
WHY = f"""[CASE WHEN {t('opportunity_score')} >= 12 THEN 'Strong recent opportunity'
  WHEN {t('opportunity_score')} >= 7 THEN 'Healthy recent opportunity'
  WHEN {t('opportunity_score')} < 3 THEN 'Limited recent opportunity' END,
 CASE WHEN {t('opportunity_momentum')} >= 2 THEN 'Role is trending upward'
  WHEN {t('opportunity_momentum')} <= -2 THEN 'Role is trending downward' END,
 CASE WHEN {t('trend_gap')} >= 2 THEN 'Opportunity rising faster than production' END,
 CASE WHEN {t('production_momentum')} >= 2 THEN 'Recent production is improving'
  WHEN {t('production_momentum')} <= -2 THEN 'Recent production is declining' END,
 CASE WHEN {t('td_dependency')} >= 0.55 THEN 'Production has significant TD dependence' END]"""
CHIPS = f"""[CASE WHEN {t('production_momentum')} > 1 THEN 'Production rising' WHEN {t('production_momentum')} < -1 THEN 'Production falling' END,
 CASE WHEN {t('opportunity_momentum')} > 1 THEN 'Usage rising' WHEN {t('opportunity_momentum')} < -1 THEN 'Usage falling' END,
 CASE WHEN {t('td_dependency')} > 0.55 THEN 'TD risk' END]"""


def _joined(array: str, fallback: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter({array}, lambda x: x IS NOT NULL)[1:4], '|'), ''), '{fallback}')"


def _projected(source: str) -> str:
    ewma = z("fantasy_points_ewma")
    base = (
        f"0.45 * {ewma} + 0.25 * coalesce(fantasy_points_roll3, {ewma}) + 0.15 * coalesce(fantasy_points_roll5, {ewma}) + 0.15 * {ewma}"
    )
    return f"""
SELECT *, greatest(0.0::DOUBLE, baseline_projection - 1.15 * volatility) AS range_low,
  baseline_projection + 1.15 * volatility AS range_high,
  CASE WHEN games_played >= 3 THEN {clip('raw_confidence', 20, 90)} END AS confidence
FROM (SELECT *, 50 + consistency_part + opportunity_part AS raw_confidence FROM (
SELECT *, {clip('12 - volatility', -10, 10)} AS consistency_part, {clip(z('opportunity_score'), 0, 15)} AS opportunity_part
FROM (SELECT *, greatest(0.0::DOUBLE, {base} + {clip('0.35 * ' + z('opportunity_momentum'), -2.5, 2.5)}
   - {clip('(' + z('td_dependency') + ' - 0.45) * 2.0', 0, 2)}) AS baseline_projection,
  CASE WHEN len(list_filter({VOL}, lambda x: x IS NOT NULL)) >= 2 THEN list_aggregate({VOL}, 'stddev_pop') ELSE 4.0 END AS volatility,
  {LABEL} AS classification, {_joined(WHY, 'Projection primarily follows recent baseline')} AS why,
  {_joined(CHIPS, 'Stable')} AS signals
FROM {source})))"""


cte("feats", _features("history"), "history")
cte("proj", _projected("feats"), "feats")
cte("pairs", "SELECT * FROM proj WHERE target_week > 1", "proj")
cte("bt_feats", _features("usage_t"), "usage_t")
cte("bt", _projected("bt_feats"), "bt_feats")
cte("live_feats", _features("live_hist"), "live_hist")
cte("live_latest", "SELECT * FROM live_feats QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY week DESC) = 1", "live_feats")
cte("live", _projected("live_latest"), "live_latest")
cte("pool", "SELECT *, baseline_projection AS projection FROM live", "live")

RIDGE_FEATURES = [f for f in MODEL_FEATURES if f != "opponent_points_allowed_per_game"]
WEIGHTS = {f: (0.31 if f.startswith("fantasy") else 0.07) * (1 + i % 4) for i, f in enumerate(MODEL_FEATURES)}
RIDGE = (
    "greatest(0.0::DOUBLE, 6.5 + "
    + " + ".join(f"({z(f)} - 2.0) / 4.0 * {WEIGHTS[f]!r}::DOUBLE" for f in RIDGE_FEATURES)
    + " + CASE position WHEN 'QB' THEN 1.25 WHEN 'RB' THEN 0.5 WHEN 'TE' THEN -0.75 WHEN 'WR' THEN 0.25 ELSE 0.0 END)"
)

# ------------------------------------------------------------------ schedule

cte("weeks", "SELECT DISTINCT year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS week FROM lineitem")
cte("schedule", """
SELECT season, week, season || '_' || week || '_' || home || '_' || away AS game_id,
  CASE WHEN week = 12 THEN 'POST' ELSE 'REG' END AS game_type, 'T' || home AS home_team, 'T' || away AS away_team,
  season || '-' || lpad(week::VARCHAR, 2, '0') || '-15' AS gameday,
  CASE WHEN (home + away) % 2 = 0 THEN '13:00' ELSE '20:15' END AS gametime
FROM (SELECT season, week, a.n_nationkey AS home, b.n_nationkey AS away FROM weeks, nation a, nation b
  WHERE a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 25 = (season * 12 + week) % 25)""", "weeks")
cte("games", """
SELECT season, week, home_team AS team, away_team AS opponent, game_id, game_type, gameday, gametime FROM schedule
UNION ALL SELECT season, week, away_team, home_team, game_id, game_type, gameday, gametime FROM schedule""", "schedule")
cte("kicks", """
SELECT season, week, team, game_id,
  timezone('America/New_York', (gameday || ' ' || gametime || ':00')::TIMESTAMP)::TIMESTAMPTZ AS kickoff_tz,
  ((gameday || ' ' || gametime || ':00')::TIMESTAMP
    + CASE WHEN week IN (5, 6, 7, 8, 9, 10) OR (week = 4) THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END) AS kickoff_utc
FROM games WHERE game_type = 'REG'""", "games")
cte("asof_t", f"""
SELECT season, defense_team, position_group, week, sum(played) OVER b AS games, sum(points) OVER b AS points_allowed FROM (
  SELECT season, defense_team, position_group, week, sum(points) AS points, max(played) AS played FROM (
    SELECT season, opponent AS defense_team, position AS position_group, week, sum(fantasy_points_std) AS points, 1 AS played
    FROM stats WHERE position <> 'K' GROUP BY ALL
    UNION ALL SELECT season, team, p, week, NULL, 0 FROM games, (SELECT unnest([{", ".join(f"'{p}'" for p in OFFENSE)}]) AS p))
  GROUP BY ALL)
WINDOW b AS (PARTITION BY season, defense_team, position_group ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "stats", "games")

# -------------------------------------------------------------------- people

cte("people", f"""
SELECT c_custkey AS key, upper(w[1:1]) || w[2:5] AS first, upper(w[6:6]) || w[7:10] AS last,
  upper(w[1:1]) || w[2:5] || ' ' || upper(w[6:6]) || w[7:10] AS full_name, 'T' || c_nationkey AS team,
  {POS4}[(c_custkey % 4 + 1)::INT] AS position, c_acctbal AS balance
FROM (SELECT *, translate(lpad(((c_custkey * 1103515245 + 12345) % 2147483647)::VARCHAR, 10, '0'), '0123456789', 'abdegiklno') AS w FROM customer)""")


def name_key_sql(x: str) -> str:
    s = f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    s = f"regexp_replace(regexp_replace({s}, '\\[[^\\]]*\\]', ' ', 'g'), '\\([^)]*\\)', ' ', 'g')"
    s = f"replace(regexp_replace({s}, '\\b(jr|sr|ii|iii|iv|v)\\.?\\b', ' ', 'g'), '''', '')"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"


cte("master", f"""
SELECT *, {name_key_sql('display_name')} AS name_normalized FROM (
SELECT 'C' || key AS player_id, CASE WHEN key % 7 = 3 THEN first[1:1] || '.' || last
   WHEN key % 7 = 5 THEN 'Zed Q. ' || last || ' III' ELSE full_name END AS display_name, position, team FROM people
UNION ALL SELECT 'P' || p_partkey, p_name, upper(p_type), upper(p_brand) FROM part)""", "people")

cte("raw_roster", """
SELECT 'R' || key AS row_id, 'Manager ' || (key // 12) AS owner,
  CASE key % 10 WHEN 1 THEN full_name || 'O' WHEN 2 THEN full_name || 'IR-R' WHEN 3 THEN full_name || ' Jr.'
    WHEN 4 THEN full_name || 'Video ForecastNew Player Note' WHEN 5 THEN first[1:2] || first[4:5] || ' ' || last
    WHEN 6 THEN lower(full_name) || ' [x] (y)' WHEN 8 THEN first[1:1] || '. ' || last ELSE full_name END AS player_name,
  CASE key % 10 WHEN 7 THEN 'T99' WHEN 0 THEN '' ELSE team END AS nfl_team,
  CASE WHEN key % 10 = 9 THEN 'D/ST' ELSE position END AS pos,
  CASE WHEN key % 3 = 0 THEN 'BN' ELSE position END AS roster_slot
FROM people
UNION ALL SELECT 'Q' || p_partkey, 'Manager ' || (p_partkey // 12), p_name, p_brand, p_type, 'BN' FROM part""", "people")

cte("roster", f"""
SELECT min(row_id) AS row_id, manager, player, team, position, slot, yahoo_status, player_normalized FROM (
SELECT row_id, owner AS manager, player_name AS player, nfl_team AS team,
  CASE WHEN upper(pos) IN ('D/ST', 'DST') THEN 'DEF' WHEN upper(pos) = 'BN' THEN 'BENCH' ELSE upper(pos) END AS position,
  upper(roster_slot) AS slot, '' AS yahoo_status, {name_key_sql('player_name')} AS player_normalized FROM raw_roster) GROUP BY ALL""", "raw_roster")

cte("mapped_roster", """
SELECT key, 'Manager ' || (key // 12) AS manager, CASE WHEN key % 3 = 0 THEN 'BN' ELSE position END AS slot,
  CASE WHEN key % 5 = 1 THEN full_name || 'Q' ELSE full_name END AS player,
  CASE WHEN key % 13 = 0 THEN 'DEF' ELSE position END AS position,
  CASE WHEN key % 13 = 0 THEN 'U' || key ELSE team END AS team,
  CASE WHEN key % 13 = 0 OR key % 11 < 3 THEN '' ELSE 'C' || key END AS rid FROM people""", "people")

# ---------------------------------------------------------- status and depth

cte("injuries", """
SELECT player_id, week, status, injury, updated, CASE WHEN status IN ('IR', 'RESERVE/INJURED') THEN 'IR' WHEN status = 'OUT' THEN 'O' ELSE '' END AS injury_flag
FROM (SELECT 'S' || user_id AS player_id, day(ts)::INT AS week,
  CASE event_type WHEN 'error' THEN 'OUT' WHEN 'signup' THEN 'RESERVE/INJURED' WHEN 'purchase' THEN 'IR' ELSE 'QUESTIONABLE' END AS status,
  CASE WHEN value > 40 THEN 'Out for season - knee' WHEN value > 15 THEN 'Ankle' ELSE '' END AS injury, ts AS updated FROM events)""")


def _latest_status(first: bool) -> str:
    keep = "" if first else "AND injury_flag <> ''"
    return f"""
SELECT player_id, injury_flag, concat_ws(' · ', CASE status WHEN 'OUT' THEN 'Out' WHEN 'IR' THEN 'Ir' ELSE 'Reserve/Injured' END, nullif(injury, '')) AS injury_note,
  regexp_matches(status || ' ' || injury, '(?i)OUT FOR SEASON|SEASON[- ]ENDING') AS season_ending
FROM (SELECT * FROM injuries WHERE week <= 20 {keep} QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY week DESC, updated DESC, status DESC, injury DESC) = 1)
WHERE injury_flag <> ''"""


cte("status", _latest_status(False), "injuries")
cte("depth_rows", f"""
SELECT 'S' || s_suppkey AS player_id, 'T' || (s_nationkey % 3) AS team, {POS5}[(s_suppkey % 5 + 1)::INT] AS position,
  rank::DOUBLE AS depth_rank, dt::TIMESTAMP AS updated
FROM (SELECT *, (s_suppkey // 5) % 3 + 1 AS rank, '2024-09-01' AS dt FROM supplier
  UNION ALL SELECT *, (s_suppkey // 5) % 4 + 1, '2024-09-08' FROM supplier)""")
cte("depth_ctx", """
SELECT player_id, depth_rank, CASE WHEN out THEN 'unavailable' WHEN depth_rank > 1 AND out_above > 0 AND healthy_above = 0
    THEN CASE WHEN ended_above > 0 THEN 'replacement' ELSE 'temporary_surge' END
  WHEN depth_rank <= 1 THEN 'starter' ELSE 'backup' END AS depth_role,
  position || depth_rank::INT || ' on the depth chart.' || CASE WHEN out THEN ' Listed as ' || injury_flag || '.'
    WHEN depth_rank > 1 AND out_above > 0 AND healthy_above = 0 THEN CASE WHEN ended_above > 0
      THEN ' Moves up: a player ahead is out for the season.'
      ELSE ' Fills in for a player ahead who is O or IR.' END
    WHEN depth_rank > 1 AND healthy_above > 0 THEN ' A player ahead is active, so recent use is no sign of a starting role.'
    ELSE '' END AS depth_note,
  CASE WHEN NOT out AND depth_rank > 1 AND healthy_above > 0 THEN 'healthy_backup' ELSE '' END AS depth_adjustment
FROM (SELECT *, count(*) FILTER (WHERE out) OVER above AS out_above, count(*) FILTER (WHERE NOT out) OVER above AS healthy_above,
    count(*) FILTER (WHERE out AND season_ending) OVER above AS ended_above
  FROM (SELECT d.*, s.injury_flag, s.season_ending, s.player_id IS NOT NULL AS out FROM depth_rows d LEFT JOIN status s USING (player_id)
    WHERE updated = '2024-09-08'::TIMESTAMP AND position <> 'K')
  WINDOW above AS (PARTITION BY team, position ORDER BY depth_rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "depth_rows", "status")

# ---------------------------------------------------------------- comparison

cte("forecasts", """
SELECT m.*, 'C' || key AS player_id, c_name AS player_name, 'T' || c_nationkey AS team FROM (
  SELECT o_custkey AS key, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS target_week,
    sum(o_totalprice) / count(*) AS mean_price, min(o_totalprice) AS low_price, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
  FROM orders GROUP BY ALL) m JOIN customer ON c_custkey = m.key""")
cte("ours", "SELECT player_id, player_name, team, season, target_week, mean_price / 10000 AS final_projection, first_order AS captured FROM forecasts", "forecasts")
cte("rival", """
SELECT player_id, player_name, team, season, target_week, CASE WHEN key % 6 <> 0 THEN low_price / 10000 END AS yahoo_projection,
  CASE WHEN (key + target_week) % 11 <> 0 THEN last_order END AS captured FROM forecasts""", "forecasts")


def _gated(side: str) -> str:
    return f"""SELECT r.*, k.kickoff_utc, CASE WHEN captured IS NULL OR kickoff_utc IS NULL THEN 'missing_kickoff'
  WHEN captured >= kickoff_utc THEN 'post_kickoff' ELSE 'pregame' END AS kickoff_status
FROM {side} r LEFT JOIN kicks k ON r.season = k.season AND r.target_week = k.week AND r.team = k.team"""


cte("ours_g", _gated("ours"), "ours", "kicks")
cte("rival_g", _gated("rival"), "rival", "kicks")
cte("cmp", """
SELECT o.player_id, o.team, o.season, o.target_week, o.player_name AS player_name_ours, o.final_projection, r.yahoo_projection, r.kickoff_status
FROM ours_g o JOIN rival_g r USING (player_id, team, season, target_week) WHERE o.kickoff_status = 'pregame' AND r.kickoff_status = 'pregame'""", "ours_g", "rival_g")
cte("actuals", """
SELECT 'C' || o_custkey AS player_id, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS target_week, sum(l_quantity) / 10 AS actual_points
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
cte("final_cmp", """
SELECT c.*, actual_points, CASE WHEN actual_points IS NULL THEN 'pending' ELSE 'finalized' END AS actual_status,
  actual_points - final_projection AS our_error, actual_points - yahoo_projection AS rival_error
FROM cmp c LEFT JOIN actuals USING (player_id, season, target_week)""", "cmp", "actuals")

# ------------------------------------------------------------------ captures

SHEET_SLOTS = ["QB", "RB", "RB", "WR", "WR", "TE", "W/R/T", "K", "DEF"] + ["BN"] * 6 + ["IR"]
SHEET_POSITIONS = ["QB", "RB", "RB", "WR", "WR", "TE", "WR", "K", "DEF", "QB", "RB", "WR", "TE", "RB", "WR", "RB"]
cte("sheet", f"""
SELECT *, {SHEET_SLOTS}[pair + 1] AS slot, {SHEET_POSITIONS}[pair + 1] AS position,
  CASE WHEN key % 9 <> 0 THEN floor(abs(balance)) % 40 + 0.5 END AS yahoo_projection,
  CASE WHEN pair < 9 THEN 'starters' ELSE 'bench' END AS "table",
  'Team ' || sheet || CASE WHEN key % 2 = 0 THEN ' A' ELSE ' B' END AS manager, 'sheet_' || sheet AS source_file,
  sheet % 7 = 6 AS wrong_week, sheet % 11 = 10 AS started
FROM (SELECT * EXCLUDE (position), key // 32 AS sheet, ((key % 32) // 2)::INT AS pair, full_name AS player_name FROM people)""", "people")
cte("captured", """SELECT player_name, 'DAL' AS team, position, manager, slot, yahoo_projection, "table", source_file FROM sheet WHERE NOT wrong_week AND NOT started""", "sheet")
cte("sheet_roster", """
SELECT CASE WHEN key % 9 > 6 THEN 'Elsewhere' ELSE manager END AS manager,
  CASE WHEN key % 5 = 1 THEN player_name[1:7] || key ELSE player_name END AS player, position,
  CASE WHEN position = 'DEF' THEN 'U' || key WHEN key % 4 = 1 THEN 'BUF' ELSE 'DAL' END AS team, slot,
  CASE WHEN key % 11 = 3 THEN '' ELSE 'C' || key END AS nflverse_player_id, player_name AS canonical FROM sheet""", "sheet")
# Player names are unique, so the only captured row that can fit is the player's own; a team unit fits by club.
cte("fit", """
SELECT r.*, c.player_name AS cap, c.yahoo_projection, c.slot AS yahoo_slot, c.source_file FROM sheet_roster r
LEFT JOIN captured c ON r.position <> 'DEF' AND c.player_name = r.canonical AND c.position = r.position AND c.manager = r.manager""", "sheet_roster", "captured")

# ------------------------------------------------------------------- oracles

O = ORACLES
O["stat_lines"] = _sql(
    f"SELECT {KEYS}, player_name, position, team, opponent, "
    + r6s("passing_yards", "passing_attempts", "interceptions", "targets", "fumbles_lost", "two_point", *EVENT_COLUMNS,
          "fantasy_points_std", "td_points", "non_td_fantasy_points") + " FROM stats", "stats")
O["snaps_scan"] = _sql(f"SELECT {KEYS}, '' AS team, {r6s('offense_snaps', 'offense_pct')} FROM snaps", "snaps")
O["master_scan"] = _sql("SELECT player_id, display_name, position, team, name_normalized FROM master", "master")
O["schedule_scan"] = _sql("SELECT * FROM schedule", "schedule")
O["depth_scan"] = _sql(f"SELECT player_id, team, position, {r6('depth_rank', 'depth_rank')}, updated FROM depth_rows", "depth_rows")
O["injury_scan"] = _sql("SELECT player_id, week, status, injury, updated, injury_flag FROM injuries", "injuries")
O["cached_table"] = f"SELECT o_orderstatus, count(*) AS n, {r6('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1"
O["event_rollup"] = _sql(f"SELECT season, week, player_id, {r6s(*EVENT_COLUMNS)} FROM events_t", "events_t")
O["event_table_sink"] = O["event_rollup"]
O["weekly_stats_source"] = _sql(f"SELECT {KEYS}, {r6s('fantasy_points_std', 'td_points')} FROM stats", "stats")
O["csv_export"] = _sql(f"SELECT player_id, {r6('projection', 'projection')}, why FROM pool", "pool")
O["tabular_roster"] = _sql("SELECT DISTINCT manager, player, team, position, slot, yahoo_status, player_normalized FROM roster", "roster")
O["html_rosters"] = f"""
SELECT page_id, player, team, position, {name_key_sql('player')} AS player_normalized FROM (
SELECT DISTINCT p_partkey % (SELECT count(*) FROM pages) AS page_id, p_name || ' ' || p_partkey AS player, p_brand AS team, p_type AS position FROM part)
JOIN pages USING (page_id)"""
O["html_cells"] = """
WITH cells AS (SELECT 1 AS table_no, c.col_no, c.cell FROM part, unnest([{'col_no': 0, 'cell': p_name || ' ' || p_partkey}, {'col_no': 1, 'cell': p_brand}, {'col_no': 2, 'cell': p_type}]) u(c)
 UNION ALL SELECT 1, c.col_no, c.cell FROM pages, unnest([{'col_no': 0, 'cell': 'Player Name'}, {'col_no': 1, 'cell': 'NFL Team'}, {'col_no': 2, 'cell': 'Pos'}]) u(c)
 UNION ALL SELECT 0, 0, c FROM pages, unnest(['Ad', 'x']) u(c))
SELECT table_no, col_no, count(*) AS cells, count(DISTINCT cell) AS texts FROM cells GROUP BY 1, 2"""
_CLEAN = "trim(regexp_replace(translate(nfc_normalize(text), chr(160) || '’`', ' '''''), '\\s+', ' ', 'g'))"
O["clean_documents"] = f"SELECT doc_id, length({_CLEAN})::INT AS n, md5({_CLEAN}) AS digest FROM documents"


def compact_sql(x: str) -> str:
    s = f"lower(regexp_replace(strip_accents(replace(replace({x}, 'œ', ''), 'ß', '')), '[^\\x00-\\x7F]', '', 'g'))"
    return f"regexp_replace(regexp_replace({s}, '\\b(?:jr|sr|ii|iii|iv|v)\\.?\\b', '', 'g'), '[^a-z0-9]', '', 'g')"


O["document_keys"] = f"SELECT doc_id, md5({compact_sql('text')}) AS digest FROM documents"
O["name_keys"] = _sql(f"""
SELECT row_id, {name_key_sql('player_name')} AS name_key, {compact_sql('player_name')} AS compact_key,
  replace(player_name, 'Video ForecastNew Player Note', '') AS stripped,
  CASE WHEN row_id LIKE 'R%' THEN regexp_replace(replace(player_name, 'Video ForecastNew Player Note', ''), '([a-z.])(IR-R|PUP-R|IR|PUP|CEL|Q|O|D|P)$', '\\1') ELSE player_name END AS bare_name,
  upper(regexp_extract(player_name, '(?i)^.*?(IR-R|PUP-R|IR|O|Q|D|P)(?:Video Forecast|New Player Note|Player Note|No new player Notes|$)', 1)) AS inline_status
FROM raw_roster""", "raw_roster")
O["team_codes"] = """
SELECT c_custkey, ['JAX','LAR','LAR','LAC','LV','WAS','NE','TB','SF','KC','GB','NO','BUF',''][(c_custkey % 14 + 1)::INT] AS team FROM customer"""
O["points_cells"] = f"""
SELECT o_orderkey, {r6("CASE o_orderkey % 5 WHEN 2 THEN round(o_totalprice, 2) WHEN 3 THEN -o_custkey::DOUBLE END", 'points')},
  o_orderkey % 5 <> 4 AS readable FROM orders"""
_RATIO = "CASE WHEN abs(l_discount) > 1e-9 THEN l_quantity / l_discount END"
_SPREAD = f"[l_quantity, {_RATIO}, CASE WHEN l_discount > 0.05 THEN l_quantity * l_discount END]"
O["row_math"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6(_RATIO, 'ratio')},
  {r6(f"CASE WHEN {_RATIO} IS NOT NULL THEN {clip(_RATIO, 100, 500)} END", 'clipped')},
  {r6("CASE WHEN l_quantity <> 1 THEN greatest(l_quantity - 25, 0) END", 'floored')},
  {r6("CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_quantity END", 'finite')},
  {r6(f"CASE WHEN len(list_filter({_SPREAD}, lambda x: x IS NOT NULL)) >= 2 THEN list_aggregate({_SPREAD}, 'stddev_pop') ELSE 4.0 END", 'spread')}
FROM lineitem"""
_RULES = TD | OTHER | {"receptions": 0.0}
O["rule_contributions"] = _sql(
    " UNION ALL ".join(f"SELECT season, '{c}' AS stat, {r6(f'sum({c} * {w!r}::DOUBLE)', 'points')} FROM stats GROUP BY season" for c, w in _RULES.items()), "stats")
_CORE = _points(OTHER, EVENT_COLUMNS) + " + " + _points(TD, EVENT_COLUMNS)
cte("audit", f"""SELECT player_id, season, week, player_name, position, team, {r6(_CORE, 'fantasy_points_std_core')},
  {r6('fantasy_points_std', 'fantasy_points_std_adjusted')}, {r6(f'fantasy_points_std - ({_CORE})', 'pbp_adjustment')} FROM stats""", "stats")
O["score_audit"] = _sql("SELECT * FROM audit", "audit")
O["audit_top20"] = _sql("SELECT * FROM audit WHERE abs(pbp_adjustment) > 0 ORDER BY pbp_adjustment DESC, player_id, season, week LIMIT 20", "audit")
O["defense_scores"] = f"""
SELECT l_suppkey, l_shipdate, {r6('max(l_quantity)', 'points_allowed')}, {r6('''count(*) + 2.0 * count(*) FILTER (WHERE l_linenumber = 1)
  + 2.0 * count(*) FILTER (WHERE l_linenumber = 2) + 6.0 * count(*) FILTER (WHERE l_quantity > 45) + 2.0 * count(*) FILTER (WHERE l_linenumber = 7)
  + 2.0 * count(*) FILTER (WHERE l_linenumber = 6) + coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 3), 0) * 0.04::DOUBLE
  + CASE WHEN max(l_quantity) <= 0 THEN 10 WHEN max(l_quantity) <= 6 THEN 7 WHEN max(l_quantity) <= 13 THEN 4 WHEN max(l_quantity) <= 20 THEN 1
    WHEN max(l_quantity) <= 27 THEN 0 WHEN max(l_quantity) <= 34 THEN -1 ELSE -4 END''', 'defense_points')} FROM lineitem GROUP BY 1, 2"""
O["event_actor_modes"] = _sql(
    f"SELECT season, week, player_id, {r6s('return_yards', 'return_tds')} FROM ({_events(_event_rows('supplier'))})", "plays")
O["event_availability"] = """
SELECT v.event, v.available, CASE WHEN v.available THEN CASE v.event WHEN 'receiving_tds_40_plus' THEN named WHEN 'return_yards' THEN thirds WHEN 'return_tds' THEN thirds ELSE n END ELSE 0 END AS plays_with_actor
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 1) AS named, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS thirds FROM lineitem),
 (VALUES ('passing_tds_40_plus', true), ('rushing_tds_40_plus', false), ('receiving_tds_40_plus', true), ('return_yards', true),
  ('return_tds', true), ('offensive_fumble_return_tds', true), ('extra_points_made', true), ('field_goal_yards_made', false)) v(event, available)"""
O["event_totals"] = _sql(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS event, {r6(f'sum({e})', 'total')} FROM events_t" for e in EVENT_COLUMNS) + ") WHERE total <> 0", "events_t")
O["duplicate_guard"] = _sql(f"SELECT {KEYS}, count(*) AS count FROM snaps GROUP BY ALL HAVING count(*) > 1", "snaps")
O["team_games"] = _sql("SELECT season, week, team, opponent, game_id FROM games", "games")
O["opponent_join"] = _sql(f"SELECT {KEYS}, team, coalesce(g.opponent, '') AS opponent FROM stats s LEFT JOIN games g USING (season, week, team)", "stats", "games")
O["union_by_name"] = _sql(
    f"""SELECT {KEYS}, source_season, source_week, {r6s('fantasy_points_std', 'offense_snaps')} FROM carry
UNION ALL SELECT {KEYS}, NULL, NULL, {r6('fantasy_points_std')}, NULL FROM stats""", "carry", "stats")
O["first_per_player"] = _sql("SELECT player_id, least(display_name, upper(display_name)) AS display_name, team FROM master", "master")
O["usage_merge"] = _sql(f"SELECT {KEYS}, {r6s('fantasy_points_std', 'offense_snaps', 'offense_pct')} FROM usage_t", "usage_t")
O["carryover"] = _sql(f"SELECT {KEYS}, source_season, source_week, {r6s('fantasy_points_std', 'offense_pct')} FROM carry", "carry")
O["feature_history"] = _sql(f"SELECT {KEYS}, source_season, source_week, {r6s('fantasy_points_std')} FROM history WHERE week < {WEEK}", "history")
O["rolling_features"] = _sql(f"SELECT {KEYS}, {r6s(*[f'{m}_{s}' for m in FEATURE_METRICS for s in ('last', 'roll2', 'roll3', 'roll5')])} FROM feats", "feats")
O["ewma_features"] = _sql(f"SELECT {KEYS}, {r6s(*[f'{m}_ewma' for m in FEATURE_METRICS])} FROM feats", "feats")
O["momentum"] = _sql(f"SELECT {KEYS}, {r6s(*[f'{m}_momentum' for m in MOMENTUM_METRICS])} FROM feats", "feats")
O["feature_scores"] = _sql(
    f"""SELECT {KEYS}, {r6s('fantasy_per_target', 'fantasy_per_carry', 'td_rate', 'opportunity_score', 'opportunity_momentum',
 'efficiency_score', 'td_dependency', 'sustainability_risk', 'production_momentum', 'trend_gap')}, games_played FROM feats""", "feats")
cte("before_feats", _features(f"(SELECT * FROM history WHERE week < {WEEK})"), "history")
O["asof_requests"] = _sql(f"""
SELECT r.player_id, r.season, r.target_week, f.week AS as_of_week, {r6s('fantasy_points_ewma', 'targets_roll3', 'opportunity_score')}, games_played
FROM (SELECT player_id, season, unnest([1, 3, 6, 9, 12, 20]) AS target_week FROM (SELECT DISTINCT player_id, season FROM usage_t)) r
ASOF LEFT JOIN feats f ON r.player_id = f.player_id AND r.season = f.season AND r.target_week > f.week""", "usage_t", "feats")
O["live_features"] = _sql(
    f"""SELECT {KEYS}, {r6s('fantasy_points_ewma', 'targets_roll3', 'opportunity_score')}, games_played FROM before_feats
QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY week DESC) = 1""", "before_feats")
# Six places, then one, halves away from zero in decimal, no sign on a zero that rounding left. printf('%.1f', round(x, 6)) writes
# -0.0 where the sum of points ends at -1e-16, and rounds 2.25 by what the double holds.
HALF_UP = "CASE WHEN round(fantasy_points_std, 6) < 0 THEN '-' ELSE '' END || round(abs(fantasy_points_std)::DECIMAL(18,6), 1)::VARCHAR"
O["recent_form"] = _sql(f"""
SELECT player_id, season, {r6('avg(fantasy_points_std)', 'recent_average')}, count(*) AS recent_games,
  string_agg('Wk ' || source_week || CASE WHEN source_season <> season THEN ' (' || source_season || ')' ELSE '' END || ': ' || {HALF_UP}, '|' ORDER BY week) AS recent_scores
FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY week DESC) AS b FROM history) WHERE b <= 3 GROUP BY 1, 2""", "history")
O["form_series"] = _sql("""
SELECT player_id, season, string_agg(printf('%.4f', round(fantasy_points_std + 1e-9, 4)), '|' ORDER BY week) AS production,
  string_agg(printf('%.4f', round(opp + 1e-9, 4)), '|' ORDER BY week) AS opportunity, count(*) FILTER (WHERE source_season < season) AS prior_season_points
FROM (SELECT *, CASE position WHEN 'QB' THEN passing_attempts + 0.5 * carries WHEN 'RB' THEN carries + 0.75 * targets
    ELSE targets + 0.55 * carries END + 0.03 * coalesce(offense_pct, 0.0) AS opp,
  row_number() OVER (PARTITION BY player_id, season ORDER BY week DESC) AS b FROM history) WHERE b <= 6 GROUP BY 1, 2""", "history")
cte("hist7", """
SELECT season, opponent AS defense_team, position AS position_group, count(DISTINCT week) AS games, sum(fantasy_points_std) AS points_allowed,
  sum(fantasy_points_std) / count(DISTINCT week) AS points_allowed_per_game FROM stats WHERE week < 7 AND position <> 'K' GROUP BY ALL""", "stats")
O["defense_history"] = _sql(f"SELECT season, defense_team, position_group, games, {r6s('points_allowed', 'points_allowed_per_game')} FROM hist7", "hist7")
O["defense_attached"] = _sql(
    f"""SELECT {KEYS}, opponent, position AS position_group, {r6('points_allowed_per_game', 'opponent_points_allowed_per_game')} FROM stats s
LEFT JOIN hist7 h ON s.season = h.season AND s.opponent = h.defense_team AND s.position = h.position_group WHERE week = 7""".replace(
        f"SELECT {KEYS}", "SELECT player_id, s.season, week"), "stats", "hist7")
O["opponent_asof"] = _sql(
    f"SELECT season, defense_team, position_group, week, games::BIGINT AS games, {r6s('points_allowed')}, {r6('points_allowed / games', 'points_allowed_per_game')} FROM asof_t WHERE games > 0", "asof_t")
O["baseline_forecast"] = _sql(f"SELECT {KEYS}, {r6s('baseline_projection', 'volatility', 'range_low', 'range_high', 'confidence')} FROM proj", "proj")
O["classification"] = _sql(f"SELECT {KEYS}, classification FROM proj", "proj")
O["reasons"] = _sql(f"SELECT {KEYS}, why FROM proj", "proj")
O["signals"] = _sql(f"SELECT {KEYS}, signals FROM proj", "proj")
O["explanations"] = _sql(
    f"""SELECT {KEYS}, {r6s('consistency_part', 'opportunity_part', 'raw_confidence')},
CASE WHEN round(raw_confidence, 9) > 90 THEN 'Held at 90%.' WHEN round(raw_confidence, 9) < 20 THEN 'Held at 20%.' ELSE '' END AS confidence_bound FROM proj""", "proj")
_TENTHS = lambda c: f"floor(({c} + 5e-10) * 10 + 0.5) / 10"
_SAY = "CASE classification " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNAL_TEXT.items()) + f" ELSE '{SIGNAL_TEXT['Stable']}' END"
O["explanation_texts"] = _sql(f"""
SELECT {KEYS}, printf('%s: %s Momentum of use %.1f and of points %.1f, gap %.1f, touchdown share %d%%.', classification, {_SAY}, {_TENTHS(z('opportunity_momentum'))},
    {_TENTHS(z('production_momentum'))}, {_TENTHS(z('trend_gap'))}, floor({z('td_dependency')} * 100 + 5e-10 + 0.5)::BIGINT) AS signal_text,
  CASE WHEN games_played < 3 THEN printf('%d games so far; a confidence needs three.', games_played)
  ELSE printf('50%% and %.1f for consistency and %.1f for opportunity make %.1f%%.%s Based on a volatility of %.1f, an opportunity score of %.1f and %d games.',
    {_TENTHS('consistency_part')}, {_TENTHS('opportunity_part')}, {_TENTHS('raw_confidence')},
    CASE WHEN round(raw_confidence, 9) > 90 THEN ' Held at 90%.' WHEN round(raw_confidence, 9) < 20 THEN ' Held at 20%.' ELSE '' END,
    {_TENTHS('volatility')}, {_TENTHS(z('opportunity_score'))}, games_played) END AS confidence_text
FROM proj""", "proj")
cte("final", f"SELECT *, CASE WHEN week % 2 = 0 THEN {RIDGE} ELSE baseline_projection END AS projection FROM proj", "proj")
O["final_projection"] = _sql(
    f"""SELECT {KEYS}, {r6s('projection')}, {r6('greatest(0.0::DOUBLE, projection - 1.15 * volatility)', 'range_low')},
{r6('projection + 1.15 * volatility', 'range_high')} FROM final""", "final")
cte("live_game", f"SELECT l.*, coalesce(g.opponent, '') AS next_opponent FROM live l LEFT JOIN games g ON g.season = {SEASON} AND g.week = {WEEK} AND g.team = l.team", "live", "games")
_CAP = "position = 'QB' AND depth_adjustment = 'healthy_backup'"
O["live_projections"] = _sql(f"""
SELECT player_id, upper(player_name) AS player_name, position, CASE WHEN key % 4 = 0 THEN team ELSE 'M' || team[2:] END AS team, next_opponent AS opponent,
  {r6(f"CASE WHEN {_CAP} THEN least(ridge, 0.0) ELSE ridge END", 'projection')},
  {r6(f"CASE WHEN {_CAP} THEN least(baseline_projection, 0.0) ELSE baseline_projection END", 'baseline_projection')},
  {r6('ridge', 'learned_weight_projection')},
  {r6(f"CASE WHEN {_CAP} THEN 0.0 ELSE greatest(0.0::DOUBLE, ridge - 1.15 * volatility) END", 'range_low')},
  {r6(f"CASE WHEN {_CAP} THEN 0.0 ELSE ridge + 1.15 * volatility END", 'range_high')}, {r6s('confidence')}, classification, why,
  coalesce(depth_role, '') AS depth_role, coalesce(depth_note, '') AS depth_note, coalesce(depth_adjustment, '') AS depth_adjustment
FROM (SELECT *, {RIDGE} AS ridge, player_id[2:]::INT AS key FROM live_game) LEFT JOIN depth_ctx USING (player_id)""", "live_game", "depth_ctx")
O["latest_status"] = _sql("SELECT * FROM status", "status")
O["latest_status_first"] = _sql(_latest_status(True), "injuries")
O["depth_context"] = _sql(f"SELECT player_id, {r6s('depth_rank')}, depth_role, depth_note, depth_adjustment FROM depth_ctx", "depth_ctx")
_DCAP = "position = 'QB' AND coalesce(depth_adjustment, '') = 'healthy_backup'"
O["depth_capped"] = _sql(f"""
SELECT player_id, position, {r6(f"CASE WHEN {_DCAP} THEN least(projection, 0.0) ELSE projection END", 'projection')},
  {r6(f"CASE WHEN {_DCAP} THEN least(baseline_projection, 0.0) ELSE baseline_projection END", 'baseline_projection')},
  {r6(f"CASE WHEN {_DCAP} THEN 0.0 ELSE range_low END", 'range_low')}, {r6(f"CASE WHEN {_DCAP} THEN 0.0 ELSE range_high END", 'range_high')},
  coalesce(depth_role, '') AS depth_role, coalesce(depth_adjustment, '') AS depth_adjustment FROM pool LEFT JOIN depth_ctx USING (player_id)""", "pool", "depth_ctx")

# ---- ladder: one join per rung, candidates counted per roster row

cte("rows_v", """
SELECT *, CASE WHEN len(vs) > 0 THEN vs[1] ELSE player_normalized END AS fb FROM (SELECT *, list_filter([
  CASE WHEN n LIKE '%ir r' THEN trim(n[:-5]) END, CASE WHEN n LIKE '%pup r' THEN trim(n[:-6]) END, CASE WHEN n LIKE '%cel' THEN trim(n[:-4]) END,
  CASE WHEN n LIKE '% o' THEN trim(n[:-3]) END, CASE WHEN n LIKE '% q' THEN trim(n[:-3]) END, CASE WHEN n LIKE '% d' THEN trim(n[:-3]) END, CASE WHEN n LIKE '% p' THEN trim(n[:-3]) END,
  CASE WHEN n[-1:] IN ('o', 'q', 'd', 'p') THEN trim(n[:-2]) END], lambda x: x IS NOT NULL) AS vs
FROM (SELECT *, player_normalized AS n, upper(team) AS tm FROM roster WHERE position <> 'DEF'))""", "roster")
cte("mm", "SELECT *, string_split(name_normalized, ' ') AS toks FROM master WHERE name_normalized <> ''", "master")


def _rung(no: int, method: str, cond: str, source: str = "rows_v r", extra: str = "true", order: str = "0") -> str:
    return f"""SELECT row_id, {no} + {order} AS rung, '{method}' AS method, any_value(m.player_id) AS pid, any_value(m.display_name) AS dn, any_value(m.team) AS mt,
  any_value(m.position) AS mp, any_value(m.name_normalized) AS mn FROM {source} JOIN mm m ON {cond} WHERE {extra} GROUP BY row_id{', ' + order if order != '0' else ''} HAVING count(*) = 1"""


_NARROW = "(r.tm = '' OR m.team = r.tm) AND (r.position = '' OR m.position = r.position)"
_SURNAME = "m.toks[-1] = string_split(r.fb, ' ')[-1] AND m.name_normalized[1:1] = r.fb[1:1]"
cte("hits", " UNION ALL ".join([
    _rung(10, "yahoo_status_suffix_exact", f"m.name_normalized = r.v AND {_NARROW}", "(SELECT *, unnest(vs) AS v, generate_subscripts(vs, 1) AS vi FROM rows_v) r", order="vi"),
    _rung(30, "exact", "m.name_normalized = r.n"),
    _rung(31, "exact_name_team", "m.name_normalized = r.n AND m.team = r.tm", extra="r.tm <> ''"),
    _rung(40, "surname_initial_team_position", f"{_SURNAME} AND {_NARROW}", extra="r.fb LIKE '% %'"),
    _rung(41, "surname_initial_position", f"{_SURNAME} AND (r.position = '' OR m.position = r.position)", extra="r.fb LIKE '% %'"),
    _rung(50, "unique_last_name_position", "list_contains(m.toks, string_split(r.fb, ' ')[-1]) AND m.position = r.position", extra="r.fb <> '' AND r.position <> ''"),
]), "rows_v", "mm")
cte("ladder", """
SELECT r.row_id, CASE WHEN h.pid IS NOT NULL AND len(vs) > 0 THEN dn ELSE player END AS player, CASE WHEN h.pid IS NOT NULL AND len(vs) > 0 THEN mn ELSE player_normalized END AS player_normalized,
  coalesce(pid, '') AS nflverse_player_id, coalesce(dn, '') AS nflverse_name, coalesce(mt, '') AS nflverse_team, coalesce(mp, '') AS nflverse_position,
  coalesce(method, 'unmatched') AS match_method, CASE method WHEN 'surname_initial_team_position' THEN 98.0 WHEN 'surname_initial_position' THEN 94.0
   WHEN 'unique_last_name_position' THEN 90.0 WHEN NULL THEN 0.0 ELSE CASE WHEN method IS NULL THEN 0.0 ELSE 100.0 END END::DOUBLE AS match_confidence, team, position
FROM rows_v r LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rung) = 1) h USING (row_id)
UNION ALL SELECT row_id, player, player_normalized, '', '', upper(team), 'DEF', 'team_defense', 100.0, team, position FROM roster WHERE position = 'DEF'""", "rows_v", "hits", "roster")
O["roster_standard"] = _sql("SELECT * FROM roster", "roster")
O["match_ladder"] = _sql("SELECT * EXCLUDE (team, position) FROM ladder", "ladder")
O["match_overrides"] = _sql("""
SELECT row_id, CASE WHEN a.n IS NULL THEN l.player ELSE r.player END AS player, CASE WHEN a.n IS NULL THEN l.player_normalized ELSE r.player_normalized END AS player_normalized,
  CASE WHEN a.n IS NULL THEN nflverse_player_id ELSE 'A' || a.n END AS nflverse_player_id, CASE WHEN a.n IS NULL THEN nflverse_name ELSE upper(r.player_normalized) END AS nflverse_name,
  CASE WHEN a.n IS NULL THEN nflverse_team ELSE 'KC' END AS nflverse_team, CASE WHEN a.n IS NULL THEN nflverse_position ELSE 'WR' END AS nflverse_position,
  CASE WHEN a.n IS NULL THEN match_method ELSE 'explicit_override' END AS match_method, CASE WHEN a.n IS NULL THEN match_confidence ELSE 100.0 END AS match_confidence
FROM ladder l JOIN (SELECT row_id, player, player_normalized, position FROM roster) r USING (row_id) LEFT JOIN (
  SELECT player_normalized AS k, min(row_id) AS n FROM roster WHERE position <> 'DEF' GROUP BY 1 HAVING min(row_id) LIKE '%0') a ON r.position <> 'DEF' AND a.k = r.player_normalized""", "ladder", "roster")

# Spelling rung: every open name against every master name that the edit distance leaves, similarity by a bit-parallel common subsequence.
cte("open_rows", "SELECT row_id, fb, tm FROM rows_v WHERE fb <> '' AND row_id NOT IN (SELECT row_id FROM hits)", "rows_v", "hits")
cte("near_names", """
SELECT fb, name, first, len(fb) + len(name) AS total,
  list_transform(range(1, len(name) + 1), lambda j: list_sum(list_transform(range(1, len(fb) + 1), lambda i: CASE WHEN fb[i] = name[j] THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT) AS masks,
  (1::HUGEINT << len(fb)::INT) - 1 AS every
FROM (SELECT DISTINCT fb FROM open_rows) JOIN (SELECT name_normalized AS name, min(player_id) AS first FROM mm GROUP BY 1)
  ON abs(len(fb) - len(name)) * 10 <= len(fb) + len(name) AND levenshtein(fb, name) <= (len(fb) + len(name)) // 10""", "open_rows", "mm")
cte("near_scores", """
SELECT fb, name, first, 100.0::DOUBLE * (1.0::DOUBLE - (total - 2 * common)::DOUBLE / total) AS score FROM (
  SELECT *, len(fb) - bit_count(list_reduce(list_concat([every], masks), lambda x, m: ((x + (x & m)) | (x - (x & m))) & every)) AS common FROM near_names)
WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY fb ORDER BY score DESC, first) = 1""", "near_names")
cte("near_hits", " UNION ALL ".join(
    f"""SELECT row_id, {no} AS rung, '{method}' AS method, any_value(m.player_id) AS pid, any_value(m.display_name) AS dn, any_value(m.team) AS mt, any_value(m.position) AS mp,
  any_value(m.name_normalized) AS mn, any_value(score) AS score FROM open_rows r JOIN near_scores s USING (fb) JOIN mm m ON m.name_normalized = s.name AND {cond} GROUP BY row_id HAVING count(*) = 1"""
    for no, method, cond in ((1, "fuzzy_name_team", "m.team = r.tm AND r.tm <> ''"), (2, "fuzzy_name", "true"))), "open_rows", "near_scores", "mm")
O["match_fuzzy"] = _sql("""
SELECT row_id, CASE WHEN h.pid IS NOT NULL AND len(vs) > 0 THEN dn ELSE l.player END AS player, CASE WHEN h.pid IS NOT NULL AND len(vs) > 0 THEN mn ELSE l.player_normalized END AS player_normalized,
  coalesce(pid, l.nflverse_player_id) AS nflverse_player_id, coalesce(dn, l.nflverse_name) AS nflverse_name, coalesce(mt, l.nflverse_team) AS nflverse_team,
  coalesce(mp, l.nflverse_position) AS nflverse_position, coalesce(method, l.match_method) AS match_method, coalesce(round(score, 1), l.match_confidence) AS match_confidence
FROM ladder l LEFT JOIN (SELECT * FROM near_hits QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rung) = 1) h USING (row_id)
LEFT JOIN (SELECT row_id, vs FROM rows_v) USING (row_id)""", "ladder", "near_hits", "rows_v")
O["mapping_counters"] = _sql("""
SELECT count(*) FILTER (WHERE position <> 'DEF') AS individuals, count(*) FILTER (WHERE position <> 'DEF' AND nflverse_player_id <> '') AS matched_individuals,
  count(*) FILTER (WHERE position = 'DEF') AS team_defenses, count(*) FILTER (WHERE position <> 'DEF' AND nflverse_player_id = '') AS unmatched_individuals FROM ladder""", "ladder")
O["unmatched_roster"] = _sql("SELECT row_id, player, team FROM ladder WHERE position <> 'DEF' AND nflverse_player_id = ''", "ladder")

O["reconcile_coverage"] = _sql(f"""
SELECT manager, player AS player_name, position, team, slot AS roster_slot, CASE WHEN position = 'DEF' THEN 'DEF:' || team ELSE nflverse_player_id END AS player_id,
  position = 'DEF' OR nflverse_player_id <> '' AS identity_resolved,
  CASE WHEN cap IS NULL THEN 'not_captured' WHEN yahoo_projection IS NULL THEN 'projection_unavailable' ELSE 'matched' END AS coverage_status,
  {r6('yahoo_projection', 'yahoo_projection')}, yahoo_slot, cap IS NOT NULL AND team <> 'DAL' AS team_mismatch FROM fit""", "fit")
cte("unexpected", """SELECT c.* FROM captured c WHERE c.position = 'DEF' OR NOT EXISTS (SELECT 1 FROM sheet_roster r WHERE r.canonical = c.player_name AND r.position = c.position AND r.manager = c.manager)""", "captured", "sheet_roster")
O["reconcile_unexpected"] = _sql(f"SELECT player_name, team, position, manager, slot, {r6('yahoo_projection', 'yahoo_projection')}, source_file FROM unexpected", "unexpected")
_SUMMARY = """
SELECT count(*) AS roster_entries, count(cap) AS matched_entries, count(yahoo_projection) AS numeric_projections, count(*) - count(cap) AS missing_entries,
  count(DISTINCT manager) AS roster_managers, count(*) FILTER (WHERE position <> 'DEF' AND nflverse_player_id = '') AS unresolved_identities,
  (SELECT count(*) FROM captured) AS captured_entries, (SELECT count(DISTINCT manager) FROM captured) AS captured_managers, 0::BIGINT AS timestamped_entries,
  (SELECT count(*) FROM unexpected) AS unexpected_entries, count(*) = count(cap) AND (SELECT count(*) FROM unexpected) = 0 AS complete_roster_coverage,
  false AS benchmark_eligible, 'pending_capture_cutoff_and_kickoff_validation' AS benchmark_status{extra} FROM fit"""
O["coverage_summary"] = _sql(_SUMMARY.format(extra=""), "fit", "unexpected")
O["import_batch"] = _sql(_SUMMARY.format(extra=", 'yahoo_matchup_clipboard_v1' AS parser_version, 2026 AS season, 3 AS week"), "fit", "unexpected")
_LABELLED = "CASE key % 4 WHEN 0 THEN 'Video ForecastNew Player Note' WHEN 1 THEN 'OPlayer Note' WHEN 2 THEN 'New Player Note' ELSE '' END"
O["parse_rosters"] = _sql(f"""
SELECT source_file, source_order, manager, CASE WHEN yahoo_status IN ('O', 'Q') AND upper(glued) LIKE '%' || yahoo_status THEN glued[:-2] ELSE glued END AS player, 'ABC' AS team, position, slot,
  yahoo_status, {name_key_sql("CASE WHEN yahoo_status IN ('O', 'Q') AND upper(glued) LIKE '%' || yahoo_status THEN glued[:-2] ELSE glued END")} AS player_normalized
FROM (SELECT 'page_' || (key // 12) AS source_file, 1000000000 + key % 12 AS source_order, 'Manager ' || (key // 12) AS manager, CASE WHEN key % 4 = 1 THEN full_name || 'O' ELSE full_name END AS glued,
  position, CASE WHEN key % 3 = 0 THEN 'BN' ELSE position END AS slot,
  upper(regexp_extract(full_name || {_LABELLED}, '(?i)^.*?(IR-R|PUP-R|IR|O|Q|D|P)(?:Video Forecast|New Player Note|Player Note|No new player Notes|$)', 1)) AS yahoo_status FROM people)""", "people")
O["parse_matchups"] = _sql(f"""
SELECT player_name, 'DAL' AS team, position, 'Sun 12:00 pm @ Buf' AS game_label, manager, slot, {r6('yahoo_projection', 'yahoo_projection')}, 3 AS week, '52040' AS league_id, "table", source_file FROM captured""", "captured")
O["matchup_rejects"] = _sql("""
SELECT DISTINCT source_file, CASE WHEN wrong_week THEN 'displayed week differs' ELSE 'starter table has an unexpected layout' END AS error FROM sheet WHERE wrong_week OR started""", "sheet")
O["capture_filters"] = _sql("""
SELECT source_file, team_lines::INT AS team_lines, team_lines >= 8 AS roster, sheet AND team_lines >= 8 AS matchup FROM (
 SELECT 'doc_' || doc_id AS source_file, 0 AS team_lines, false AS sheet FROM documents
 UNION ALL SELECT 'page_' || (key // 12), count(*), false FROM people GROUP BY 1
 UNION ALL SELECT source_file, count(*), true FROM sheet GROUP BY 1)""", "people", "sheet")

O["kickoff_times"] = _sql("SELECT season, week, team, game_id, kickoff_utc FROM kicks", "kicks")
O["pregame_gate"] = _sql("SELECT player_id, season, target_week, team, kickoff_utc, kickoff_status FROM rival_g", "rival_g")
_BLANK = " OR ".join(f"coalesce(trim({c}::VARCHAR), '') = ''" for c in ("player_id", "team", "season", "target_week"))
O["comparison_refused"] = _sql(
    f"SELECT player_id, season, target_week, team, CASE WHEN {_BLANK} THEN 'missing_identity' ELSE kickoff_status END AS kickoff_status FROM rival_g"
    f" WHERE kickoff_status <> 'pregame' OR {_BLANK}", "rival_g")
_C4 = "player_id, team, season, target_week"
O["comparison"] = _sql(
    f"SELECT {_C4}, player_name_ours, {r6s('final_projection', 'yahoo_projection')}, NULL::DOUBLE AS our_error, kickoff_status, 'benchmark_v1' AS benchmark_schema_version FROM cmp", "cmp")
O["comparison_batch"] = _sql(f"SELECT {_C4}, {r6s('final_projection', 'yahoo_projection')} FROM cmp", "cmp")
O["comparison_finalized"] = _sql(
    f"""SELECT {_C4}, {r6s('actual_points')}, actual_status, {r6s('our_error', 'rival_error')}, {r6('abs(our_error)', 'our_absolute_error')},
{r6('abs(rival_error)', 'rival_absolute_error')} FROM final_cmp""", "final_cmp")
O["head_to_head"] = _sql(f"""
SELECT model, count(*) AS examples, {r6('avg(abs(e))', 'mae')}, {r6('sqrt(avg(e * e))', 'rmse')}, {r6('avg(e)', 'bias')}, {r6('median(abs(e))', 'median_absolute_error')},
  {", ".join(r6(f"avg(CASE WHEN round(abs(e), 9) <= {n} THEN 1.0::DOUBLE ELSE 0.0 END)", f"within_{n}_points") for n in (2, 3, 5))}
FROM (SELECT unnest(['Ours', 'Rival']) AS model, unnest([our_error, rival_error]) AS e FROM final_cmp WHERE actual_points IS NOT NULL AND yahoo_projection IS NOT NULL) GROUP BY model""", "final_cmp")

cte("league", """
SELECT r.key, CASE WHEN r.position = 'DEF' THEN 'DEF:' || r.team ELSE rid END AS player_id, player AS player_name, r.position, r.team, manager AS fantasy_manager, slot AS roster_slot,
  f.projection, f.baseline_projection, f.confidence, f.classification FROM mapped_roster r LEFT JOIN (
  SELECT 'C' || key AS pid, CASE WHEN key % 19 <> 2 THEN abs(balance) / 100 END AS projection, abs(balance) / 120 AS baseline_projection, balance / 50 AS confidence, 'Stable' AS classification
  FROM people) f ON r.rid = f.pid AND r.key % 10 <> 4 AND r.key % 17 <> 1 AND r.position <> 'DEF'""", "mapped_roster", "people")
_STATUS = "CASE WHEN player_id = '' THEN 'identity_unresolved' WHEN projection IS NULL THEN 'forecast_unavailable' ELSE 'available' END"
O["league_snapshot"] = _sql(
    f"SELECT key, player_id, player_name, position, team, fantasy_manager, roster_slot, {r6s('projection')}, 'league_roster' AS snapshot_scope, {_STATUS} AS forecast_status FROM league", "league")
_SNAP = {
    "snapshot_id": "'fixed'", "captured_at_utc": "'2001-08-01T00:00:00Z'", "schema_version": "'prediction_snapshot_v2'", "app_version": "'1.0'",
    "feature_version": "'features_v1'", "scoring_version": "'ffc_yahoo_v1'", "primary_projection_model": "'baseline_heuristic'", "season": str(SEASON),
    "target_week": str(WEEK), "snapshot_scope": "'league_roster'", "forecast_status": _STATUS, "learned_weight_projection": "NULL::DOUBLE",
    "ml_projection": "NULL::DOUBLE", "final_projection": r6("projection"), "baseline_projection": r6("baseline_projection"), "range_low": "NULL::DOUBLE",
    "range_high": "NULL::DOUBLE", "confidence": r6("confidence"), "classification": "coalesce(classification, '')", "depth_role": "''", "depth_adjustment": "''",
    "yahoo_projection": "NULL::DOUBLE", "actual_points": "NULL::DOUBLE", "actual_finalized_at_utc": "NULL::VARCHAR",
}
O["snapshot_frame"] = _sql("SELECT " + ", ".join(f"{_SNAP.get(c, c)} AS {c}" for c in SNAPSHOT_COLUMNS) + " FROM league", "league")
O["snapshot_manifest"] = """
SELECT 'prediction_snapshot_v2' AS schema_version, 2001 AS season, unnest([7, 8]) AS target_week, (SELECT count(*) FROM customer) AS row_count, '1.0' AS app_version,
  'features_v1' AS feature_version, 'ffc_yahoo_v1' AS scoring_version, 'baseline_heuristic' AS primary_projection_model"""

GROUPS = ["Offense (QB/RB/WR/TE)", *OFFENSE, "All player records"]


def _metrics(source: str, forecasts: dict[str, str], by: str = "") -> str:
    labels = "[" + ", ".join(f"'{m}'" for m in forecasts) + "]"
    values = "[" + ", ".join(forecasts.values()) + "]"
    groups = "CASE WHEN position IN ('QB','RB','WR','TE') THEN ['Offense (QB/RB/WR/TE)', position, 'All player records'] ELSE ['All player records'] END"
    return f"""SELECT {by}position, model, count(*) AS examples, {r6('avg(abs(e))', 'mae')}, {r6('sqrt(avg(e * e))', 'rmse')}, {r6('avg(e)', 'bias')},
  {", ".join(r6(f"avg(CASE WHEN round(abs(e), 9) <= {n} THEN 1.0::DOUBLE ELSE 0.0 END)", f"within_{n}_points") for n in (3, 5))}
FROM (SELECT {by}g AS position, unnest({labels}) AS model, unnest({values}) - target_next_week AS e FROM (SELECT * EXCLUDE (position), unnest({groups}) AS g FROM {source})) WHERE e IS NOT NULL GROUP BY ALL"""


cte("ridged", f"SELECT *, {RIDGE} AS ridge FROM pairs", "pairs")
O["holdout_metrics_grouped"] = _sql(_metrics("ridged", {"Baseline projection": "baseline_projection", "Machine Learned Weight Values": "ridge"}), "ridged")
cte("base_metrics", _metrics("pairs", {"Baseline projection": "baseline_projection"}), "pairs")
O["report_archive"] = _sql("""
SELECT position, model, examples, mae, h AS holdout_season, s AS training_seasons, x AS experiment, 'computed' AS source, 'full' AS precision, n AS review_status FROM base_metrics,
(VALUES (1998, '1996,1997', 'defensive_matchup_opponent_v2', 'Research only; not approved for production'), (1997, '1996', 'defensive_matchup_candidate', 'INVALID matchup evidence: own-team join')) v(h, s, x, n)""", "base_metrics")

O["project_report"] = _sql("""
SELECT model, examples AS n, mae AS value FROM base_metrics WHERE position = 'Offense (QB/RB/WR/TE)'
UNION ALL SELECT 'snapshot', (SELECT count(*) FROM customer), NULL UNION ALL SELECT 'PENDING', 0, NULL""", "base_metrics")

cte("taken", "SELECT 'S' || s_suppkey AS player_id FROM supplier WHERE s_suppkey % 3 = 0")
cte("waiver", f"""
SELECT player_id, position, {r6(f"projection + {clip(z('opportunity_momentum'), -3, 5)} + {clip(z('trend_gap'), -2, 5)}", 'waiver_discovery_score')}
FROM pool WHERE position <> 'K' AND player_id NOT IN (SELECT player_id FROM taken)""", "pool", "taken")
O["waiver_pool"] = _sql("SELECT * FROM waiver", "waiver")
O["waiver_top30"] = _sql("SELECT player_id, waiver_discovery_score FROM waiver ORDER BY waiver_discovery_score DESC, player_id LIMIT 30", "waiver")
O["waiver_top30_position"] = _sql("""
SELECT player_id, position, row_number() OVER (PARTITION BY position ORDER BY waiver_discovery_score DESC, player_id)::INT AS rank, waiver_discovery_score FROM waiver
QUALIFY rank <= 30""", "waiver")
O["top20_projections"] = _sql(
    f"SELECT player_id, player_name, position, {r6s('projection', 'range_low', 'range_high', 'confidence')}, classification FROM pool ORDER BY {r6('projection')} DESC, player_id LIMIT 20", "pool")
O["roster_view"] = _sql(f"""
SELECT s_suppkey AS source_order, 'Manager ' || (s_suppkey // 12) AS manager, s_name AS player, {r6s('projection', 'confidence')}, classification, why
FROM supplier LEFT JOIN pool ON s_suppkey % 8 <> 0 AND player_id = 'S' || s_suppkey""", "pool")
O["target_week"] = _sql("SELECT season, max(week) + 1 AS target_week FROM stats GROUP BY season", "stats")
_P3 = "player_id, season, target_week"
O["walk_forward"] = _sql(
    f"SELECT {_P3}, {r6s('target_next_week')}, position, {r6s('fantasy_points_ewma', 'opportunity_score', 'trend_gap', 'td_dependency')}, games_played FROM pairs", "pairs")
O["walk_forward_matchup"] = _sql(f"""
SELECT {_P3}, coalesce(g.opponent, '') AS opponent, {r6('points_allowed / nullif(games, 0)', 'opponent_points_allowed_per_game')}, {r6s('target_next_week')}
FROM (SELECT * EXCLUDE (opponent) FROM pairs) p LEFT JOIN (SELECT season, week AS target_week, team, opponent FROM games) g USING (season, target_week, team)
LEFT JOIN (SELECT season, week AS target_week, defense_team AS opponent, position_group AS position, games, points_allowed FROM asof_t WHERE defense_team <> '') a USING (season, target_week, opponent, position)""",
    "pairs", "games", "asof_t")
cte("bt_rows", f"""
SELECT season, target_week, player_id, baseline_projection, target_next_week AS fantasy_points_std_actual, baseline_projection - target_next_week AS error FROM bt WHERE target_week > 1""", "bt")
O["backtest_rows"] = _sql(f"""
SELECT season, target_week, player_id, {r6s('baseline_projection', 'fantasy_points_std_actual', 'error')}, {r6('abs(error)', 'abs_error')},
  round(abs(error), 9) <= 3 AS within_3, round(abs(error), 9) <= 5 AS within_5 FROM bt_rows""", "bt_rows")
O["backtest_summary"] = _sql(f"""
SELECT count(*) AS examples, {r6('avg(abs(error))', 'mae')}, {r6('avg((round(abs(error), 9) <= 3)::INT)', 'within_3')}, {r6('avg((round(abs(error), 9) <= 5)::INT)', 'within_5')},
  {r6('median(error)', 'median_error')} FROM bt_rows""", "bt_rows")
_DESIGN = [f"{z(f)} AS {f}" for f in RIDGE_FEATURES] + [f"(position = '{p}')::INT::DOUBLE AS position_{p.lower()}" for p in OFFENSE]
_NAMES = RIDGE_FEATURES + [f"position_{p.lower()}" for p in OFFENSE]
cte("design", f"SELECT {_P3}, {', '.join(_DESIGN)} FROM pairs", "pairs")
O["design_matrix"] = _sql(f"SELECT {_P3}, {r6s(*_NAMES)} FROM design", "design")
O["feature_moments"] = _sql(
    " UNION ALL ".join(
        f"SELECT '{n}__{k}' AS statistic, {r6(f'{fn}({n})', 'value')} FROM design" for n in _NAMES for k, fn in (("mean", "avg"), ("std", "stddev_pop"))), "design")
O["ridge_scores"] = _sql(f"SELECT {_P3}, {r6('ridge', 'learned_weight_projection')} FROM ridged", "ridged")
# Ridges in SQL: sums of products of standardised columns per fold, then Gauss-Jordan steps over the list of its rows.
_N = len(RIDGE_FEATURES)
cte("folds", "SELECT 0 AS h, -9999 AS a, 9999 AS b UNION ALL SELECT unnest(range(1996, 2002)), 1995, unnest(range(1995, 2001))")
cte("fit_rows", f"""
SELECT row_number() OVER () AS rid, season, target_next_week AS y, [{", ".join(z(f) for f in RIDGE_FEATURES)}] AS x, [{", ".join(f"(position = '{p}')::INT::DOUBLE" for p in OFFENSE)}] AS q
FROM pairs WHERE target_next_week IS NOT NULL""", "pairs")
cte("fold_cells", f"SELECT h, rid, y, q, i, x[i] AS v FROM fit_rows JOIN folds ON season BETWEEN a AND b, unnest(range(1, {_N + 1})) u(i)", "fit_rows", "folds")
cte("fold_moments", "SELECT h, i, avg(v) AS m, stddev_pop(v) AS s FROM fold_cells GROUP BY h, i HAVING count(*) >= 500", "fold_cells")
cte("fold_z", f"""
SELECT h, rid, i, CASE WHEN s > 0 THEN (v - m) / s ELSE 0.0::DOUBLE END AS v FROM fold_cells JOIN fold_moments USING (h, i)
UNION ALL SELECT h, rid, {_N} + k, q[k] FROM fold_cells JOIN fold_moments USING (h, i), unnest(range(1, 5)) u(k) WHERE i = 1
UNION ALL SELECT h, rid, 0, 1.0 FROM fold_cells JOIN fold_moments USING (h, i) WHERE i = 1
UNION ALL SELECT h, rid, {_N + 5}, y FROM fold_cells JOIN fold_moments USING (h, i) WHERE i = 1""", "fold_cells", "fold_moments")
cte("fold_matrix", f"""
SELECT h, list(r ORDER BY i) AS m FROM (
  SELECT h, i, list(v ORDER BY j) AS r FROM (
    SELECT a.h, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i AND a.i > 0 THEN 12 ELSE 0 END AS v FROM fold_z a JOIN fold_z b ON a.h = b.h AND a.rid = b.rid WHERE a.i < {_N + 5} GROUP BY a.h, a.i, b.i
  ) GROUP BY h, i
) GROUP BY h""", "fold_z")
cte("fold_steps", f"""
SELECT h, 1 AS k, m FROM fold_matrix UNION ALL
SELECT h, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END)
FROM fold_steps WHERE k <= {_N + 5}""", "fold_matrix")
cte("fold_weights", f"SELECT h, list_transform(m, lambda r: r[{_N + 6}]) AS w FROM fold_steps WHERE k = {_N + 6}", "fold_steps")
O["ridge_weights"] = _sql(f"""
SELECT CASE WHEN i <= {_N} THEN 'metric' ELSE 'position_adjustment' END AS kind, names[i] AS name, {r6('w[i + 1]', 'learned_standardized_weight')}, {r6('abs(w[i + 1])', 'absolute_weight')},
  CASE WHEN w[i + 1] >= 0 THEN 'raises projection' ELSE 'lowers projection' END AS direction
FROM (SELECT w, [{", ".join(f"'{n}'" for n in [*RIDGE_FEATURES, *OFFENSE])}] AS names FROM fold_weights WHERE h = 0), unnest(range(1, {_N + 5})) u(i)
WHERE i <= {_N} OR EXISTS (SELECT 1 FROM pairs WHERE position = names[i])""", "fold_weights", "pairs").replace("WITH ", "WITH RECURSIVE ", 1)
cte("fold_scored", f"""
SELECT p.*, greatest(0.0::DOUBLE, w[1] + list_sum(list_transform(range(1, {_N + 1}), lambda i: CASE WHEN s[i] > 0 THEN (x[i] - m[i]) / s[i] * w[i + 1] ELSE 0 END)) + list_sum(list_transform(range(1, 5), lambda k: q[k] * w[{_N} + 1 + k]))) AS ridge
FROM (SELECT *, [{", ".join(z(f) for f in RIDGE_FEATURES)}] AS x, [{", ".join(f"(position = '{p}')::INT::DOUBLE" for p in OFFENSE)}] AS q FROM pairs WHERE season > 1995) p
LEFT JOIN (SELECT h, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM fold_moments GROUP BY h) f ON f.h = p.season LEFT JOIN fold_weights USING (h)""", "pairs", "fold_moments", "fold_weights")
O["fold_ridge_metrics"] = _sql(_metrics("fold_scored", {"Baseline projection": "baseline_projection", "Machine Learned Weight Values": "ridge"}, "season, "), "fold_scored").replace("WITH ", "WITH RECURSIVE ", 1)
cte("timed_events", "SELECT * FROM events_t", "events_t")
O["stream_events"] = O["event_rollup"]
O["stream_status"] = _sql("SELECT * FROM status", "status")
O["stream_gate"] = _sql("SELECT player_id, season, target_week, team, kickoff_status FROM rival_g", "rival_g")
