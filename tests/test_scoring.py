import pytest
from pyspark.sql import functions as F

from sideline.operators import scoring
from sideline.operators.schema import assert_unique, duplicate_keys, one_row_per_key, resolve_aliases
from sideline.schemas import EVENT_COLUMNS


def score(spark, **line):
    df = spark.createDataFrame([tuple(float(v) for v in line.values())], list(line))
    return scoring.score_lines(df).first()


def test_passing_line(spark):
    row = score(spark, passing_yards=250, passing_tds=3, interceptions=1, rushing_yards=40, two_point=1)
    assert row.fantasy_points_std == pytest.approx(10 + 18 - 2 + 4 + 2)
    assert row.td_points == pytest.approx(18)
    assert row.non_td_fantasy_points == pytest.approx(14)


def test_event_fields_and_kicker(spark):
    row = score(
        spark, receiving_yards=55, receiving_tds=1, receiving_tds_40_plus=1, return_yards=50, return_tds=1,
        offensive_fumble_return_tds=1, extra_points_made=3, field_goal_yards_made=47, receptions=9, fumbles_lost=1,
    )
    assert row.td_points == pytest.approx(6 + 1 + 6 + 6)
    assert row.fantasy_points_std == pytest.approx(5.5 + 2 + 3 + 4.7 - 2 + 19)


def test_unreadable_and_missing_count_zero(spark):
    df = spark.createDataFrame([("x", None, float("nan"))], "passing_yards string, passing_tds double, rushing_yards double")
    row = scoring.score_lines(df).first()
    assert (row.fantasy_points_std, row.td_points) == (0.0, 0.0)


@pytest.mark.parametrize(
    "allowed,points",
    [(0, 10), (1, 7), (6, 7), (7, 4), (13, 4), (14, 1), (20, 1), (21, 0), (27, 0), (28, -1), (34, -1), (35, -4)],
)
def test_tier_edges(spark, allowed, points):
    assert spark.range(1).select(scoring.points_allowed_tier(F.lit(float(allowed)))).first()[0] == points


def test_defense_line(spark):
    df = spark.createDataFrame(
        [(4.0, 2.0, 1.0, 1.0, 1.0, 1.0, 50.0, 1.0, 1.0, 10.0)],
        "sacks double, interceptions double, fumble_recoveries double, defense_tds double, safeties double,"
        "blocked_kicks double, return_yards double, return_tds double, extra_point_returns double, points_allowed double",
    )
    assert scoring.score_defense(df).first().defense_points == pytest.approx(4 + 4 + 2 + 6 + 2 + 2 + 2 + 6 + 2 + 4)


def test_rules_are_data(spark):
    table = scoring.rules_table(spark)
    assert table.count() == 23 and table.select("version").distinct().count() == 1


def test_aliases_first_present_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "PASS_YDS int, recent_team int, team int")
    out = resolve_aliases(df, {"passing_yards": ["passing_yards", "pass_yds"], "team": ["recent_team", "team"]})
    assert out.first().asDict() == {"passing_yards": 1, "team": 2}


def weekly(spark):
    return spark.createDataFrame(
        [("a1", "Ann", "qb", "JAC", 2024, 3, 200.0, 1.0)],
        "gsis_id string, player_display string, position string, recent_team string, season int, week int, pass_yds double, pass_td double",
    )


def event_rows(spark, n=1):
    row = (2024, 3, "a1", 1.0) + (0.0,) * 7
    return spark.createDataFrame([row] * n, "season int, week int, player_id string," + ",".join(f"{c} double" for c in EVENT_COLUMNS))


def test_standardize_joins_events(spark):
    row = scoring.standardize_stats(weekly(spark), event_rows(spark)).first()
    assert (row.fantasy_points_std, row.td_points, row.team) == (15.0, 7.0, "JAX")


def test_standardize_rejects_bad_events(spark):
    with pytest.raises(ValueError):
        scoring.standardize_stats(weekly(spark), event_rows(spark).drop("week"))
    with pytest.raises(ValueError):
        scoring.standardize_stats(weekly(spark), event_rows(spark).drop("return_tds"))
    with pytest.raises(ValueError):
        scoring.standardize_stats(weekly(spark).drop("gsis_id"))


def test_combine_sum(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0)], "player_id string, rushing_fumbles_lost double, receiving_fumbles_lost double")
    assert scoring.standardize_stats(df).first().fumbles_lost == 1.0
    assert scoring.standardize_stats(df, combine="sum").first().fumbles_lost == 3.0


def test_guards(spark):
    twice = event_rows(spark, 2)
    keys = ["season", "week", "player_id"]
    assert duplicate_keys(twice, keys).first()["count"] == 2
    with pytest.raises(ValueError):
        assert_unique(twice, keys, "Events")
    with pytest.raises(Exception, match="duplicate key"):
        one_row_per_key(twice, keys, "Events").collect()
    assert one_row_per_key(event_rows(spark), keys, "Events").count() == 1


def test_audit(spark):
    row = scoring.scoring_audit(weekly(spark), event_rows(spark)).first()
    assert (row.fantasy_points_std_core, row.fantasy_points_std_adjusted, row.pbp_adjustment) == (14.0, 15.0, 1.0)


def test_repeated_event_key_fails(spark):
    from pyspark.sql import functions as F

    from sideline.schemas import EVENT_COLUMNS

    line = spark.createDataFrame([("p", 2024, 1)], "player_id string, season int, week int")
    events = line.select("season", "week", "player_id", *[F.lit(1.0).alias(c) for c in EVENT_COLUMNS])
    assert scoring.attach_events(line, events).count() == 1
    with pytest.raises(Exception, match="duplicate key"):
        scoring.attach_events(line, events.union(events)).collect()
