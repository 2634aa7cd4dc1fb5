import pytest

from sideline.operators import compare
from sideline.sources import snapshots


def schedule(spark, rows=None):
    rows = rows or [(2025, 3, "REG", "2025-09-21", "13:00", "BUF", "JAX", "g1"), (2025, 3, "reg", "2025-09-22", "20:15", "DAL", "NE", "g2"), (2025, 3, "POST", "2025-09-22", "20:15", "XX", "YY", "g3")]
    return spark.createDataFrame(rows, "season int, week int, game_type string, gameday string, gametime string, away_team string, home_team string, game_id string")


def test_kickoffs(spark):
    got = {r.team: str(r.kickoff_utc) for r in compare.schedule_kickoffs(schedule(spark), season=2025, week=3).collect()}
    assert got == {"BUF": "2025-09-21 17:00:00", "JAX": "2025-09-21 17:00:00", "DAL": "2025-09-23 00:15:00", "NE": "2025-09-23 00:15:00"}
    winter = schedule(spark, [(2025, 14, "REG", "2025-12-07", "13:00", "A", "B", "g")])
    assert str(compare.schedule_kickoffs(winter).first().kickoff_utc) == "2025-12-07 18:00:00"


@pytest.mark.parametrize("row", [(2025, 3, "REG", "soon", "13:00", "A", "B", "g"), (2025, 3, "REG", "2025-09-21", "1pm", "A", "B", "g")])
def test_bad_kickoffs(spark, row):
    with pytest.raises(Exception, match="Invalid kickoff"):
        compare.schedule_kickoffs(schedule(spark, [row])).collect()
    assert compare.schedule_kickoffs(schedule(spark, [row]), strict=False).first().kickoff_utc is None


def test_schedule_guards(spark):
    with pytest.raises(ValueError):
        compare.schedule_kickoffs(schedule(spark), season=1999)
    twice = [(2025, 3, "REG", "2025-09-21", "13:00", "A", b, b) for b in "BC"]
    with pytest.raises(Exception, match="duplicate key"):
        compare.schedule_kickoffs(schedule(spark, twice)).collect()


def captures(spark, rows, value):
    return spark.createDataFrame(rows, f"player_id string, player_name string, team string, season int, target_week int, captured_at_utc string, {value} double")


def sides(spark, late=False):
    ours = captures(spark, [("a", "A", "BUF", 2025, 3, "2025-09-21T16:59:00Z", 10.0), ("b", "B", "DAL", 2025, 3, "2025-09-21T16:59:00Z", 8.0)], "final_projection")
    stamp = "2025-09-21T17:00:00Z" if late else "2025-09-21T16:59:59Z"
    rival = captures(spark, [("a", "A", "buf", 2025, 3, stamp, 14.0), ("b", "B", "DAL", 2025, 3, None, 9.0)], "yahoo_projection")
    return ours, rival, compare.schedule_kickoffs(schedule(spark))


def test_gate(spark):
    ours, rival, kick = sides(spark, late=True)
    got = {r.player_id: r.kickoff_status for r in compare.pregame_gate(rival, kick).collect()}
    assert got == {"a": "post_kickoff", "b": "missing_kickoff"}
    with pytest.raises(ValueError, match="'A'"):
        compare.pregame_gate(rival, kick, strict=True)
    assert compare.pregame_gate(ours.drop("season"), kick).where("kickoff_status = 'pregame'").count() == 2


def test_comparison_and_metrics(spark):
    ours, rival, kick = sides(spark)
    rows = compare.comparison(ours, rival, kick, strict=True)
    assert [(r.player_id, r.our_error, r.player_name_ours) for r in rows.collect()] == [("a", None, "A")]
    assert compare.head_to_head(compare.attach_actuals(rows, spark.createDataFrame([], "player_id string, season int, target_week int, actual_points double"))).count() == 0
    actuals = spark.createDataFrame([("a", 2025, 3, 13.0), ("z", 2025, 3, 1.0)], "player_id string, season int, target_week int, actual_points double")
    done = compare.attach_actuals(rows, actuals)
    row = done.first()
    assert (row.actual_status, row.our_error, row.rival_absolute_error) == ("finalized", 3.0, 1.0)
    got = {r.model: r for r in compare.head_to_head(done).collect()}
    assert (got["Ours"].mae, got["Ours"].within_2_points, got["Ours"].within_3_points) == (3.0, 0.0, 1.0)
    assert (got["Rival"].bias, got["Rival"].median_absolute_error) == (-1.0, 1.0)
    pending = compare.attach_actuals(rows, actuals.where("player_id = 'z'"))
    assert pending.first().actual_status == "pending" and compare.head_to_head(pending).count() == 0
    with pytest.raises(Exception, match="duplicate key"):
        compare.attach_actuals(rows, actuals.unionByName(actuals)).collect()


def test_comparison_guards(spark):
    ours, rival, kick = sides(spark)
    with pytest.raises(ValueError, match="season/week"):
        compare.comparison(ours.selectExpr("* except (target_week)", "4 AS target_week"), rival, kick, strict=True)
    blank = ours.selectExpr("* except (player_id)", "' ' AS player_id")
    with pytest.raises(ValueError, match="identity"):
        compare.comparison(blank, rival, kick, strict=True)
    assert compare.comparison(blank, rival, kick).count() == 0
    with pytest.raises(Exception, match="duplicate key"):
        compare.comparison(ours.unionByName(ours), rival, kick).collect()


def test_comparison_batches_append(spark, tmp_path):
    ours, rival, kick = sides(spark)
    rows = compare.comparison(ours, rival, kick)
    ids = {snapshots.save_comparison(rows, str(tmp_path / "c")) for _ in range(2)}
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert len(ids) == 2 and stored.count() == 2


def test_refused_rows_come_back(spark):
    kickoffs = compare.schedule_kickoffs(schedule(spark), season=2025, week=3)
    rows = [("a", "A", "BUF", 2025, 3, "2025-09-21T16:59:00Z", 1.0), ("b", "B", "BUF", 2025, 3, "2025-09-21T17:00:00Z", 1.0), (" ", "C", "BUF", 2025, 3, "2025-09-21T16:00:00Z", 1.0), ("d", "D", "ZZZ", 2025, 3, "2025-09-21T16:00:00Z", 1.0)]
    got = {r.player_name: r.kickoff_status for r in compare.refused(captures(spark, rows, "yahoo_projection"), kickoffs).collect()}
    assert got == {"B": "post_kickoff", "C": "missing_identity", "D": "missing_kickoff"}
