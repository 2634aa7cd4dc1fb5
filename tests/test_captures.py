import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sideline.operators import reconcile
from sideline.sources import captures

SLOTS = ["QB", "RB", "RB", "WR", "WR", "TE", "W/R/T", "K", "DEF"]
BENCH = ["BN", "BN", "IR"]
HEADER = "Stats\nPlayer\nProj\nFan Pts\nPos\nFan Pts\nProj\nPlayer\nStats\n"


def block(name, position):
    return f"{name}Video ForecastNew Player Note\nDal - {position}\nSun 12:00 pm vs Bal\n"


def sheet(*, week=3, league="77", empty_left=True):
    text = f"Demo League (ID# {league})\r\nWeek {week}: Sep 22 - Sep 28\nRed Side\nAl\n0-1-0 | 11th\nx\nBlue Side\nBo\n1-0-0 | 1st\nHide Bench Players\n"
    text += HEADER + "\n"
    for i, slot in enumerate(SLOTS):
        position = "WR" if slot == "W/R/T" else slot
        text += block(f"Left P{'abcdefghijkl'[i]}", position) + f"{i}.25\n–\n{slot}\n–\n{i + 10}.50\n" + block(f"Right P{'abcdefghijkl'[i]}Q", position) + "\n"
    text += "103.2\n–\nTOTAL\n–\n97.5\n" + HEADER
    for i, slot in enumerate(BENCH):
        left = "(Empty)\n" if empty_left and slot == "IR" else block(f"Left B{'abc'[i]}", "RB")
        text += left + f"–\n–\n{slot}\n–\n0.07\n" + block(f"Right B{'abc'[i]}", "TE")
    return text + "0.00\nTOTAL\n0.00\nfooter\n"


def parse(spark, text, **kw):
    df = spark.createDataFrame([("f.txt", text)], "source_file string, value string")
    return captures.parse_matchups(df, **{"week": 3, "league_id": "77", **kw})


def test_matchup_sheet(spark):
    rows, rejected = parse(spark, sheet())
    got = rows.collect()
    assert rejected.count() == 0 and len(got) == 23
    left = [r for r in got if r.manager == "Red Side" and r.table == "starters"]
    assert sum(r.yahoo_projection for r in left) == pytest.approx(sum(i + 0.25 for i in range(9)))
    right = {r.player_name: r for r in got if r.manager == "Blue Side"}
    assert right["Right Pa"].team == "DAL" and right["Right Ba"].yahoo_projection == 0.07
    assert next(r for r in got if r.player_name == "Left Ba").yahoo_projection is None


@pytest.mark.parametrize(
    "change,reason",
    [
        (lambda t: t.replace("Week 3:", "Week 4:"), "week"),
        (lambda t: t.replace("ID# 77", "ID# 78"), "league"),
        (lambda t: t.replace("Hide Bench Players", "Show Bench Players"), "bench tables"),
        (lambda t: t.replace("0.25\n–\nQB", "–\nQB", 1), "starter table"),
        (lambda t: t.replace("0.25\n", "0,25\n", 1), "starter table"),
        (lambda t: t.replace("Sun 12:00 pm vs Bal", "Final W 20-3", 1), "starter table"),
        (lambda t: t.replace("0.00\nTOTAL\n0.00", "0.00\n0.00"), "bench table"),
        (lambda t: t.replace("Blue Side", "Red Side"), "managers"),
        (lambda t: t.replace("\nK\n–", "\nTE\n–", 1), "slots"),
        (lambda t: t.replace("Left Pc", "Left Pb"), "duplicate"),
        (lambda t: t + block("Left over", "QB"), "not parsed"),
    ],
)
def test_broken_sheets_are_rejected_whole(spark, change, reason):
    rows, rejected = parse(spark, change(sheet()))
    assert rows.count() == 0 and reason in rejected.first().error
    with pytest.raises(Exception, match="f.txt"):
        parse(spark, change(sheet()), strict=True)[0].collect()


def mapping(spark, rows):
    return spark.createDataFrame(rows, "manager string, player string, position string, team string, slot string, nflverse_player_id string, nflverse_name string")


def test_reconcile(spark):
    captured, _ = parse(spark, sheet())
    roster = mapping(
        spark,
        [
            ("Red Side", "Left PaO", "QB", "Was", "QB", "id1", "Left Pa"), ("Red Side", "Le", "RB", "DAL", "RB", "id2", "Left Pb"),
            ("Red Side", "Left Ba", "RB", "DAL", "BN", "", ""), ("Blue Side", "Gone Guy", "WR", "DAL", "WR", "id4", "Gone Guy"),
            ("Blue Side", "Dallas", "DEF", "DAL", "DEF", "", ""), ("Other", "Right Pa", "QB", "DAL", "QB", "id6", "Right Pa"),
        ],
    )
    only = captured.where("NOT (position = 'DEF' AND manager = 'Red Side')")
    coverage, unexpected = reconcile.reconcile(only, roster)
    got = {r.player_name: r for r in coverage.collect()}
    assert got["Left PaO"].coverage_status == "matched" and got["Left PaO"].team_mismatch and got["Left PaO"].team == "WAS"
    assert got["Le"].yahoo_projection == 1.25 and got["Left Ba"].coverage_status == "projection_unavailable"
    assert not got["Left Ba"].identity_resolved and got["Gone Guy"].coverage_status == "not_captured"
    assert (got["Dallas"].player_id, got["Dallas"].coverage_status) == ("DEF:DAL", "matched")
    assert got["Right Pa"].coverage_status == "not_captured"
    summary = reconcile.coverage_summary(coverage, only, unexpected).first()
    assert (summary.matched_entries, summary.numeric_projections, summary.unexpected_entries) == (4, 3, 18)
    assert not summary.complete_roster_coverage


def test_reconcile_guards(spark):
    captured, _ = parse(spark, sheet())
    one = ("Red Side", "Left Pa", "QB", "DAL", "QB", "id1", "Left Pa")
    with pytest.raises(ValueError, match="identities"):
        reconcile.reconcile(captured, mapping(spark, [one, ("Blue Side", "Left Pa", "QB", "DAL", "BN", "id9", "")]))
    with pytest.raises(ValueError, match="weeks or leagues"):
        reconcile.reconcile(captured.unionByName(captured.withColumn("week", F.lit(4))), mapping(spark, [one]))
    with pytest.raises(ValueError, match="Captured rows"):
        reconcile.reconcile(captured.unionByName(captured), mapping(spark, [one]))
    with pytest.raises(ValueError, match="No projections"):
        reconcile.reconcile(captured.where("false"), mapping(spark, [one]))


PAGE = """League shell
Red Side \ue003
QB
Baker OwenVideo ForecastPlayer Note
TB - QB
Sun 1:00
W/R/T
No new player Notes
Nico RayQNew Player Note
Hou - WR
BN
Cal LeeIR-RPlayer Note
Buf - TE
Blue Side\ue005 \ue003
D/ST
Seattle
Sea - DEF
IR
QB
Last ManPlayer Note
"""


def test_roster_page(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", "no roster here")], "source_file string, value string")
    got = captures.parse_roster_pages(df).orderBy("source_order").collect()
    rows = [(r.manager, r.player, r.team, r.position, r.slot, r.yahoo_status) for r in got]
    assert rows == [
        ("Red Side", "Baker Owen", "TB", "QB", "QB", ""),
        ("Red Side", "Nico Ray", "Hou", "WR", "W/R/T", "Q"),
        ("Red Side", "Cal LeeIR-R", "Buf", "TE", "BN", "IR-R"),
        ("Blue Side", "Seattle", "Sea", "DEF", "D/ST", ""),
        # An empty slot takes the next line for a name, as the page offers nothing else.
        ("Blue Side", "QB", "", "IR", "IR", ""),
        ("Blue Side", "Last Man", "", "QB", "QB", ""),
    ]


def test_plausibility(spark):
    good = "\n".join(f"Player {i}\nDal - QB" for i in range(8)) + "\n" + "x" * 40
    df = spark.createDataFrame([(1, good), (2, "Dal - QB\n" * 7 + "x" * 90), (3, sheet()), (4, "Dal - QB\n" * 8)], "i int, value string")
    got = df.orderBy("i").select(captures.is_roster_capture(F.col("value")), captures.is_matchup_capture(F.col("value"))).collect()
    # Enough lines and long enough; too few lines; a sheet; enough lines but too short.
    assert [tuple(r) for r in got] == [(True, False), (False, False), (True, True), (False, False)]


@pytest.mark.parametrize("fmt,text", [("tsv", "Owner\tPlayer Name\tTM\tPos\nAl\tAnn  Lee\tBUF\tD/ST\n"), ("csv", "owner,name,team,position\nAl,Ann Lee,BUF,DST\n"), ("spaces", "Owner  Full Name  Tm  Pos\nAl  Ann Lee  BUF  DEF\n")])
def test_tabular_rosters(spark, tmp_path, fmt, text):
    (tmp_path / "r.txt").write_text(text)
    for chosen in (fmt, "auto"):
        row = captures.read_tabular_roster(spark, str(tmp_path / "r.txt"), chosen).first()
        assert (row.manager, row.player, row.team, row.position, row.player_normalized) == ("Al", "Ann Lee", "BUF", "DEF", "ann lee")


def test_roster_needs_a_player_column(spark):
    with pytest.raises(ValueError):
        captures.standardize_roster(spark.createDataFrame([("a",)], "team string"))
    assert captures.standardize_roster(spark.createDataFrame([("a", "BN")], "`my player` string, pos string")).first().position == "BENCH"


def test_html(spark):
    html = "<table><tr><td>ad</td></tr></table><table><tr><th>Pos</th><th>Player</th></tr><tr><td>QB</td><td><a>Ann&nbsp;Lee</a> Jr.</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    got = captures.html_rosters(df).collect()
    assert [(r.page_id, r.player, r.position, r.player_normalized) for r in got] == [(1, "Ann Lee Jr.", "QB", "ann lee")]


def test_import_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = sheet().encode()
    (folder / "m.txt").write_bytes(data)
    note = {"sha256": hashlib.sha256(data).hexdigest(), "season": 2025, "week": 3, "captured_at_utc": "2025-09-20T10:00:00Z"}
    roster = mapping(spark, [("Red Side", "Left Pa", "QB", "DAL", "QB", "id1", "Left Pa")])
    args = dict(season=2025, week=3, league_id="77")

    def run(batch, **kw):
        return captures.import_captures(spark, str(folder), roster, str(tmp_path / "out"), batch_id=batch, **{**args, **kw}).first()

    assert run("b1").timestamped_entries == 0
    (folder / "m.txt.json").write_text(json.dumps(note))
    row = run("b2")
    assert (row.timestamped_entries, row.matched_entries, row.captured_entries) == (23, 1, 23)
    assert spark.read.parquet(str(tmp_path / "out" / "captured")).count() == 46
    for bad in ({"sha256": "0"}, {"week": 4}, {"captured_at_utc": "2999-01-01T00:00:00Z"}, {"captured_at_utc": "2025-09-20T10:00:00"}):
        (folder / "m.txt.json").write_text(json.dumps(note | bad))
        with pytest.raises(ValueError):
            run("b3")
    loose = run("b4", strict=False)
    assert loose.captured_entries == 0


def test_import_reads_its_files_once(spark, tmp_path, monkeypatch):
    """What is reconciled comes from stored rows, not from the files again."""
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "m.txt").write_text(sheet())
    seen, plain = [], captures.reconcile

    def watched(captured, roster, **kw):
        seen.extend(captured.inputFiles())
        return plain(captured, roster, **kw)

    monkeypatch.setattr(captures, "reconcile", watched)
    one = mapping(spark, [("Red Side", "Left Pa", "QB", "DAL", "QB", "id1", "Left Pa")])
    row = captures.import_captures(spark, str(folder), one, str(tmp_path / "out"), batch_id="b", season=2025, week=3, league_id="77", strict=False).first()
    assert row.captured_entries == 23
    assert seen and all(name.endswith(".parquet") for name in seen)


def test_reconcile_loses_no_capture(spark):
    """Two captures of one player: the first by slot is kept, the other comes back with its reason."""
    captured, _ = parse(spark, sheet())
    one = ("Red Side", "Left Pa", "QB", "DAL", "QB", "id1", "Left Pa")
    twice = captured.unionByName(captured)
    coverage, rest = reconcile.reconcile(twice, mapping(spark, [one]), strict=False)
    assert coverage.count() == 1 and coverage.first().coverage_status == "matched"
    reasons = {r.reason: r["count"] for r in rest.groupBy("reason").count().collect()}
    assert reasons["duplicate"] == 1 and sum(reasons.values()) + 1 == twice.count()
