import pytest

from sideline.operators import events

SCHEMA = (
    "season int, week int, season_type string, touchdown double, yards_gained double, pass_touchdown double,"
    "passer_player_id string, receiver_player_id string, kicker_player_id string, extra_point_result string,"
    "field_goal_result string, kick_distance double, returner_player_id string, kickoff_returner_player_id string, return_yards double"
)


def plays(spark):
    none = (None,) * 9
    return spark.createDataFrame(
        [
            (2024, 1, "REG", 1.0, 40.0, 1.0, " p1 ", "r1", *none[:7]),
            (2024, 1, "reg", 1.0, 39.0, 1.0, "p1", "r1", *none[:7]),
            (2024, 1, "POST", 1.0, 80.0, 1.0, "p1", "r1", *none[:7]),
            (2024, 1, "REG", 1.0, 60.0, 1.0, "p1", "  ", *none[:7]),
            (2024, 1, "REG", 0.0, 0.0, 0.0, None, None, "k1", "Good", None, None, None, None, None),
            (2024, 1, "REG", 0.0, 0.0, 0.0, None, None, "k1", None, "made", 52.0, None, None, None),
            (2024, 1, "REG", 0.0, 0.0, 0.0, None, None, "k1", None, "missed", 60.0, None, None, None),
            (2024, 2, "REG", 0.0, 0.0, 0.0, None, None, None, None, None, None, None, "x1", 25.0),
            (None, 2, "REG", 1.0, 60.0, 1.0, "p1", "r1", *none[:7]),
        ],
        SCHEMA,
    )


def test_rollup(spark):
    got = {(r.week, r.player_id): r for r in events.event_rollup(plays(spark)).collect()}
    assert set(got) == {(1, "p1"), (1, "r1"), (1, "k1")}
    assert got[1, "p1"].passing_tds_40_plus == 2 and got[1, "r1"].receiving_tds_40_plus == 1
    assert (got[1, "k1"].extra_points_made, got[1, "k1"].field_goal_yards_made) == (1, 52)


def test_actor_is_a_column_choice_by_default(spark):
    filled = events.event_rollup(plays(spark), actor_mode="coalesce").where("player_id = 'x1'").first()
    assert filled.return_yards == 25
    assert events.event_rollup(plays(spark).drop("returner_player_id")).where("player_id = 'x1'").count() == 1


def test_availability_and_requirements(spark):
    have = events.available_events(plays(spark))
    assert have["passing_tds_40_plus"] and not have["rushing_tds_40_plus"] and not have["return_tds"]
    with pytest.raises(ValueError):
        events.event_rollup(plays(spark).drop("season"))
    totals = {r.event: r.total for r in events.event_totals(events.event_rollup(plays(spark))).collect()}
    assert totals["field_goal_yards_made"] == 52 and "return_tds" not in totals
