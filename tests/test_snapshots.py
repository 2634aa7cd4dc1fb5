import pytest

from sideline.operators import views
from sideline.schemas import MANIFEST_SCHEMA, SNAPSHOT_COLUMNS
from sideline.sources import snapshots, tables

META = {"app_version": "9", "scoring_version": "s"}


def projections(spark, rows=(("a", "Ann", "QB", "BUF", 12.0, "Stable"), ("", "Nobody", "QB", "BUF", 3.0, "Stable"), ("c", "Cy", "WR", "DAL", None, None))):
    return spark.createDataFrame(list(rows), "player_id string, player_name string, position string, team string, projection double, classification string")


def roster(spark):
    return spark.createDataFrame(
        [("M", "QB", "Ann L.", "QB", "BUF", " a "), ("M", "DEF", "Bears", "DEF", "CHI", None), ("M", "BN", "Who", "RB", "", "  "), ("N", "WR", "Cy", "WR", "DAL", "c"), ("N", "TE", "New", "TE", "NE", "zz")],
        "manager string, slot string, player string, position string, team string, nflverse_player_id string",
    )


def test_league_scope(spark):
    got = {r.player_name: r for r in snapshots.league_scope(roster(spark), projections(spark)).collect()}
    assert len(got) == 5 and got["Ann L."].projection == 12.0
    assert got["Bears"].player_id == "DEF:CHI" and got["Bears"].forecast_status == "forecast_unavailable"
    assert got["Who"].forecast_status == "identity_unresolved" and got["Who"].projection is None
    assert {got[n].forecast_status for n in ("Cy", "New")} == {"forecast_unavailable"}
    twice = projections(spark).unionByName(projections(spark))
    with pytest.raises(Exception, match="duplicate key"):
        snapshots.league_scope(roster(spark), twice).collect()
    with pytest.raises(ValueError):
        snapshots.league_scope(roster(spark).drop("slot"), projections(spark))


def test_snapshots_append_only(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshots.snapshot_index(spark, root).collect() == []
    first = snapshots.save_snapshot(projections(spark), root, season=2024, target_week=3, metadata=META)
    before = {p: p.read_bytes() for p in tmp_path.rglob("*.parquet")}
    second = snapshots.save_snapshot(snapshots.league_scope(roster(spark), projections(spark)), root, season=2024, target_week=4, metadata=META)
    assert first != second and all(p.read_bytes() == data for p, data in before.items())
    index = {r.snapshot_id: r for r in snapshots.snapshot_index(spark, root).collect()}
    assert snapshots.snapshot_index(spark, root).columns == MANIFEST_SCHEMA.names
    assert (index[first].row_count, index[second].row_count, index[second].feature_version) == (3, 5, "unknown")
    stored = snapshots.read_snapshots(spark, root)
    assert set(stored.columns) == set(SNAPSHOT_COLUMNS)
    assert stored.where("yahoo_projection IS NOT NULL OR actual_points IS NOT NULL").count() == 0
    assert stored.where("player_id = 'c' AND final_projection IS NULL AND classification = ''").count() == 2
    with pytest.raises(ValueError):
        snapshots.save_snapshot(projections(spark).drop("projection"), root, season=1, target_week=1, metadata={})


def test_frame_schema_order(spark):
    frame = snapshots.snapshot_frame(projections(spark), snapshot_id="i", captured_at_utc="t", season=2024, target_week=1, metadata={})
    assert frame.columns == list(SNAPSHOT_COLUMNS) and frame.first().snapshot_scope == "nfl_projection_pool"


def test_report_archive(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.load_reports(spark, root).count() == 0
    report = spark.createDataFrame([("Offense (QB/RB/WR/TE)", "Baseline projection", 5, 1.5)], "position string, model string, examples int, mae double")
    snapshots.save_report(report, root, [2022, 2023], 2024)
    snapshots.save_report(report, root, [2023], 2024, experiment=snapshots.INVALID_EXPERIMENT)
    got = {r.training_seasons: r.review_status for r in snapshots.load_reports(spark, root).collect()}
    assert got == {"2022,2023": snapshots.RESEARCH_NOTE, "2023": snapshots.INVALID_NOTE}
    parts = snapshots.project_report(spark, root, root, root)
    assert parts["holdout"].count() == 2 and parts["status"].first().coverage == "PENDING"


def test_load_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.load_table(spark, path, "x int").count() == 0
    calls = []

    def loader(s):
        calls.append(1)
        return s.range(3)

    assert tables.load_table(spark, path, loader=loader).count() == 3
    assert tables.load_table(spark, path, loader=loader).count() == 3 and len(calls) == 1
    assert tables.load_table(spark, path, loader=loader, refresh=True).count() == 3 and len(calls) == 2

    def broken(s):
        raise OSError("no network")

    assert tables.load_table(spark, str(tmp_path / "u"), "x int", loader=broken).columns == ["x"]


def test_views(spark):
    df = spark.createDataFrame(
        [("a", "QB", 5.0, 9.0, -9.0), ("b", "QB", 6.0, None, 1.0), ("c", "K", 50.0, 0.0, 0.0), ("d", "WR", 1.0, 0.0, 0.0)],
        "player_id string, position string, projection double, opportunity_momentum double, trend_gap double",
    )
    taken = spark.createDataFrame([(" d ",), ("",), (None,)], "nflverse_player_id string")
    pool = views.waiver_pool(df, taken)
    assert {r.player_id: r.waiver_discovery_score for r in pool.collect()} == {"a": 8.0, "b": 7.0}
    assert [r.player_id for r in views.top_n(pool, "waiver_discovery_score", 1).collect()] == ["a"]
    rows = spark.createDataFrame([(0, "M", "d"), (1, "N", "a"), (2, "M", "")], "source_order int, manager string, nflverse_player_id string")
    for sort, order in (("source", [0, 1, 2]), ("desc", [1, 0, 2]), ("asc", [2, 0, 1])):
        assert [r.source_order for r in views.roster_view(rows, df, sort=sort).collect()] == order
    assert views.roster_view(rows, df, manager="M").count() == 2


def test_ranking_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS player_id", "id % 2 AS position", "rand() AS s")
    plan = views.top_n(df, "s", 3, by="position")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
