"""The given tables seen as the canonical tables of this library.

Every view is a query over whole tables; nothing is sampled or cut. The same
views are written in SQL in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.operators.events import event_rollup
from sideline.operators.scoring import standardize_stats
from sideline.operators.temporal import merge_usage, standardize_snaps

POSITIONS = ("QB", "RB", "WR", "TE", "K")
TEAMS = 25
DIGITS, LETTERS = "0123456789", "abdegiklno"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when_sum(cond: Column, value: Column | float = 1.0) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.sum(F.when(cond, v).otherwise(0.0))


def opponent_of(team: Column, season: Column, week: Column) -> Column:
    """The other side of the round robin; a team drawn against itself has a bye."""
    other = F.pmod(season * 12 + week - team, F.lit(TEAMS))
    return F.when(other == team, "").otherwise(F.concat(F.lit("T"), other.cast("string")))


def raw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly stat lines: supplier x month, source-style column names."""
    q = F.col("l_quantity")
    ret = F.col("l_returnflag")
    weekly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("s_suppkey"),
            F.year("l_shipdate").alias("season"),
            F.month("l_shipdate").alias("week"),
        )
        .agg(
            _when_sum(ret == "A", q).alias("pass_yds"),
            _when_sum(ret == "A").alias("attempts"),
            _when_sum((ret == "A") & (q > 40)).alias("passing_tds"),
            _when_sum((ret == "A") & (q <= 5)).alias("interceptions"),
            _when_sum(ret == "N", q).alias("rushing_yards"),
            _when_sum(ret == "N").alias("carries"),
            _when_sum((ret == "N") & (q > 40)).alias("rushing_tds"),
            _when_sum((ret == "N") & (q <= 5)).alias("fumbles_lost"),
            _when_sum(ret == "R", q).alias("receiving_yards"),
            _when_sum(ret == "R").alias("targets"),
            _when_sum((ret == "R") & (q > 40)).alias("receiving_tds"),
            _when_sum((ret == "R") & (F.col("l_linestatus") == "F")).alias("receptions"),
            _when_sum((F.col("l_linenumber") == 7) & (q > 45)).alias("two_point_conversions"),
            _when_sum((ret == "R") & (q <= 20)).alias("red_zone_targets"),
            _when_sum((ret == "N") & (q <= 20)).alias("red_zone_carries"),
        )
    )
    club = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    positions = F.array(*[F.lit(p) for p in POSITIONS])
    return weekly.join(club, "s_suppkey").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("gsis_id"),
        F.col("s_name").alias("player_name"),
        F.element_at(positions, (F.col("s_suppkey") % len(POSITIONS) + 1).cast("int")).alias("position"),
        F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("recent_team"),
        opponent_of(F.col("s_nationkey"), F.col("season"), F.col("week")).alias("opponent_team"),
        *[c for c in weekly.columns if c != "s_suppkey"],
    )


def raw_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snap counts, up to two rows per player-week, some shares missing."""
    key = F.col("l_suppkey")
    week = F.month("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(key.alias("k"), F.year("l_shipdate").alias("season"), week.alias("week"), "l_linestatus")
        .agg((F.count(F.lit(1)) * 3.0).alias("off_snap"), (F.count(F.lit(1)) * 5.0).alias("pct"))
        .select(
            F.concat(F.lit("S"), F.col("k").cast("string")).alias("player_id"),
            "season", "week", "off_snap",
            F.when((F.col("k") + F.col("week")) % 5 != 0, F.col("pct")).alias("offense_snap_pct"),
        )
    )


def plays(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """One play per line item; ``extra`` columns are over the line items."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    ret, status = F.col("l_returnflag"), F.col("l_linestatus")
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))

    def flag(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)

    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"),
        F.month("l_shipdate").alias("week"),
        F.when(F.month("l_shipdate") == 12, "POST").otherwise("REG").alias("season_type"),
        flag(ret == "R").alias("touchdown"),
        q.alias("yards_gained"),
        flag((ret == "R") & (status == "O")).alias("pass_touchdown"),
        flag((ret == "R") & (status == "F")).alias("rush_touchdown"),
        supplier.alias("passer_player_id"),
        F.when(n == 1, " ").otherwise(part).alias("receiver_player_id"),
        supplier.alias("rusher_player_id"),
        F.when(n % 3 == 0, supplier).alias("returner_player_id"),
        part.alias("kickoff_returner_player_id"),
        F.when(n % 3 == 0, q).alias("return_yards"),
        flag((n % 3 == 0) & (q > 49)).alias("return_touchdown"),
        supplier.alias("fumble_recovery_1_player_id"),
        flag((n == 6) & (q > 48)).alias("fumble_return_touchdown"),
        supplier.alias("kicker_player_id"),
        F.when(n == 4, "good").when(n == 5, "failed").alias("extra_point_result"),
        F.when((n == 5) & (q >= 20), "made").when(n == 5, "missed").alias("field_goal_result"),
        q.alias("kick_distance"),
        *extra,
    )


def scoring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rollup(plays(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored stat lines with events."""
    return standardize_stats(raw_stats(spark, sf_dir), scoring_events(spark, sf_dir), ascii_only=True)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored stat lines with events and snap counts."""
    return merge_usage(stats(spark, sf_dir), standardize_snaps(raw_snaps(spark, sf_dir), ascii_only=True))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over the weeks that occur: every team at most once a week, byes included."""
    weeks = (
        table(spark, sf_dir, "lineitem")
        .select(F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"))
        .distinct()
    )
    home = F.col("home")
    away = F.pmod(F.col("season") * 12 + F.col("week") - home, F.lit(TEAMS))
    return (
        weeks.select("season", "week", F.explode(F.sequence(F.lit(0), F.lit(TEAMS - 1))).alias("home"))
        .withColumn("away", away)
        .where(F.col("home") < F.col("away"))
        .select(
            "season", "week",
            F.concat_ws("_", "season", "week", "home", "away").alias("game_id"),
            F.when(F.col("week") == 12, "POST").otherwise("REG").alias("game_type"),
            F.concat(F.lit("T"), home.cast("string")).alias("home_team"),
            F.concat(F.lit("T"), F.col("away").cast("string")).alias("away_team"),
            F.concat_ws("-", F.col("season").cast("string"), F.lpad(F.col("week").cast("string"), 2, "0"), F.lit("15")).alias("gameday"),
            F.when((F.col("home") + F.col("away")) % 2 == 0, "13:00").otherwise("20:15").alias("gametime"),
        )
    )


# ------------------------------------------------------------------ people


def _words(key: Column) -> tuple[Column, Column]:
    """Two invented name parts per customer key."""
    code = F.translate(F.lpad(((key * 1103515245 + 12345) % 2147483647).cast("string"), 10, "0"), DIGITS, LETTERS)
    return F.initcap(F.substring(code, 1, 5)), F.initcap(F.substring(code, 6, 5))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players: full name, team, position."""
    first, last = _words(F.col("c_custkey"))
    positions = F.array(*[F.lit(p) for p in POSITIONS[:4]])
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"),
        first.alias("first"), last.alias("last"),
        F.concat_ws(" ", first, last).alias("full_name"),
        F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("team"),
        F.element_at(positions, (F.col("c_custkey") % 4 + 1).cast("int")).alias("position"),
        F.col("c_acctbal").alias("balance"),
    )


def raw_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master rows from customers (some with initials only) and parts (many rows per name)."""
    p = people(spark, sf_dir)
    shown = (
        F.when(F.col("key") % 7 == 3, F.concat(F.substring("first", 1, 1), F.lit("."), "last"))
        .when(F.col("key") % 7 == 5, F.concat(F.lit("Zed Q. "), "last", F.lit(" III")))
        .otherwise(F.col("full_name"))
    )
    customers = p.select(
        F.concat(F.lit("C"), F.col("key").cast("string")).alias("gsis_id"), shown.alias("display_name"),
        "position", "team",
    )
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gsis_id"),
        F.col("p_name").alias("display_name"), F.col("p_type").alias("position"), F.col("p_brand").alias("team"),
    )
    return customers.unionByName(parts)


def raw_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and every part once, as a noisy roster row."""
    p = people(spark, sf_dir)
    k = F.col("key") % 10
    name = (
        F.when(k == 1, F.concat("full_name", F.lit("O")))
        .when(k == 2, F.concat("full_name", F.lit("IR-R")))
        .when(k == 3, F.concat("full_name", F.lit(" Jr.")))
        .when(k == 4, F.concat("full_name", F.lit("Video ForecastNew Player Note")))
        .when(k == 5, F.concat_ws(" ", F.concat(F.substring("first", 1, 2), F.substring("first", 4, 2)), "last"))
        .when(k == 6, F.concat(F.lower("full_name"), F.lit(" [x] (y)")))
        .when(k == 8, F.concat(F.substring("first", 1, 1), F.lit(". "), "last"))
        .otherwise(F.col("full_name"))
    )
    customers = p.select(
        F.concat(F.lit("R"), F.col("key").cast("string")).alias("row_id"),
        manager_name(F.col("key")).alias("owner"),
        name.alias("player_name"),
        F.when(k == 7, "T99").when(k == 0, "").otherwise(F.col("team")).alias("nfl_team"),
        F.when(k == 9, "D/ST").otherwise(F.col("position")).alias("pos"),
        F.when(F.col("key") % 3 == 0, "BN").otherwise(F.col("position")).alias("roster_slot"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("row_id"),
        manager_name(F.col("p_partkey")).alias("owner"), F.col("p_name").alias("player_name"),
        F.col("p_brand").alias("nfl_team"), F.col("p_type").alias("pos"), F.lit("BN").alias("roster_slot"),
    )
    return customers.unionByName(parts)


def manager_name(key: Column) -> Column:
    """Managers hold twelve entries each."""
    return F.concat(F.lit("Manager "), F.floor(key / 12).cast("string"))


def mapped_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolved roster: every customer, three out of eleven without an id, one in thirteen a team unit."""
    p = people(spark, sf_dir)
    unit = F.col("key") % 13 == 0
    return p.select(
        "key",
        manager_name(F.col("key")).alias("manager"),
        F.when(F.col("key") % 3 == 0, "BN").otherwise(F.col("position")).alias("slot"),
        F.when(F.col("key") % 5 == 1, F.concat("full_name", F.lit("Q"))).otherwise(F.col("full_name")).alias("player"),
        F.when(unit, "DEF").otherwise(F.col("position")).alias("position"),
        F.when(unit, F.concat(F.lit("U"), F.col("key").cast("string"))).otherwise(F.col("team")).alias("team"),
        F.when(unit | (F.col("key") % 11 < 3), " ").otherwise(F.concat(F.lit("C"), F.col("key").cast("string"))).alias("nflverse_player_id"),
        F.when(unit, "").otherwise(F.col("full_name")).alias("nflverse_name"),
    )


# ------------------------------------------------------- status and depth


def raw_injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injury feed from the event stream."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("gsis_id"),
        F.dayofmonth("ts").alias("week"),
        F.when(kind == "error", "Out")
        .when(kind == "signup", "Reserve/Injured")
        .when(kind == "purchase", " ir ")
        .otherwise("Questionable")
        .alias("report_status"),
        F.when(F.col("value") > 40, "Out for season - knee").when(F.col("value") > 15, "Ankle").alias("report_primary_injury"),
        F.col("ts").alias("date_modified"),
    )


def raw_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth chart from suppliers, two charts per player, ranks partly inside text."""
    positions = F.array(*[F.lit(p) for p in POSITIONS])
    key = F.col("s_suppkey")
    position = F.element_at(positions, (key % len(POSITIONS) + 1).cast("int"))
    old, new = F.floor(key / 5) % 3 + 1, F.floor(key / 5) % 4 + 1
    charts = F.explode(
        F.array(
            F.struct(F.lit("2024-09-01").alias("dt"), old.cast("string").alias("pos_rank")),
            F.struct(
                F.lit("2024-09-08").alias("dt"),
                F.when(key % 2 == 0, F.concat(position, new.cast("string"))).otherwise(new.cast("string")).alias("pos_rank"),
            ),
        )
    )
    return (
        table(spark, sf_dir, "supplier")
        .select(
            F.concat(F.lit("S"), key.cast("string")).alias("gsis_id"),
            # Three clubs, so that depth ranks actually compete.
            F.concat(F.lit("T"), (F.col("s_nationkey") % 3).cast("string")).alias("club_code"),
            position.alias("pos_abb"), charts.alias("c"),
        )
        .select("gsis_id", "club_code", "pos_abb", "c.dt", "c.pos_rank")
    )


# ------------------------------------------------------ forecasts, actuals


def own_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own forecasts: customer x month of the orders."""
    return _forecasts(spark, sf_dir).select(
        "player_id", "player_name", "team", "season", "target_week",
        (F.col("mean_price") / 10000).alias("final_projection"),
        F.col("first_order").alias("captured_at_utc"),
    )


def rival_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rival forecasts: some captures without a time, some without a number."""
    return _forecasts(spark, sf_dir).select(
        "player_id", "player_name", "team", "season", "target_week",
        F.when(F.col("key") % 6 != 0, F.col("low_price") / 10000).alias("yahoo_projection"),
        F.when((F.col("key") + F.col("target_week")) % 11 != 0, F.col("last_order")).alias("captured_at_utc"),
    )


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("target_week")
        )
        .agg(
            (F.sum("o_totalprice") / F.count("o_totalprice")).alias("mean_price"),
            F.min("o_totalprice").alias("low_price"),
            F.min("o_orderdate").cast("timestamp").alias("first_order"),
            F.max("o_orderdate").cast("timestamp").alias("last_order"),
        )
    )
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
    return monthly.join(who, "key").select(
        "*",
        F.concat(F.lit("C"), F.col("key").cast("string")).alias("player_id"),
        F.col("c_name").alias("player_name"),
        F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("team"),
    )


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual points: what the customer's orders shipped, by order month."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey")
        .groupBy(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("player_id"),
            F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("target_week"),
        )
        .agg((F.sum("quantity") / 10).alias("actual_points"))
    )


# ---------------------------------------------------------------- captures


def roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster pages as text, one per manager (twelve entries, so one page is small)."""
    p = people(spark, sf_dir)
    label = F.when(F.col("key") % 4 == 0, "Video ForecastNew Player Note").when(F.col("key") % 4 == 1, "OPlayer Note").when(
        F.col("key") % 4 == 2, "New Player Note"
    ).otherwise("")
    slot = F.when(F.col("key") % 3 == 0, "BN").otherwise(F.col("position"))
    entry = F.concat_ws("\n", slot, F.concat("full_name", label), F.concat(F.col("team"), F.lit(" - "), F.col("position")), F.lit("Sun 1:00 pm"))
    entry = F.regexp_replace(entry, r"T(\d+) - ", "ABC - ")
    return (
        p.groupBy(F.floor(F.col("key") / 12).alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("key", entry.alias("text")))).alias("e"))
        .select(
            F.concat(F.lit("page_"), F.col("page").cast("string")).alias("source_file"),
            F.concat(
                F.lit("League shell\nManager "), F.col("page").cast("string"), F.lit(" \ue003\n\n"),
                F.array_join(F.col("e.text"), "\n\n"), F.lit("\nfooter\n"),
            ).alias("value"),
        )
    )


SHEET_SLOTS = ("QB", "RB", "RB", "WR", "WR", "TE", "W/R/T", "K", "DEF", *["BN"] * 6, "IR")
SHEET_POSITIONS = ("QB", "RB", "RB", "WR", "WR", "TE", "WR", "K", "DEF", "QB", "RB", "WR", "TE", "RB", "WR", "RB")
SHEET_WEEK, SHEET_LEAGUE = 3, "52040"


def sheet_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the matchup sheets say: 32 customers per sheet, two managers, pairs by place.

    A last sheet with an odd or too small number of entries cannot be a
    matchup and is completed with empty places by the sheet writer.
    """
    at = F.col("key") % 32
    pair = F.floor(at / 2).cast("int")
    value = F.floor(F.abs("balance")) % 40 + 0.5
    return people(spark, sf_dir).select(
        "key", F.floor(F.col("key") / 32).alias("sheet"), pair.alias("pair"), (at % 2).alias("side"),
        F.concat(F.lit("Team "), F.floor(F.col("key") / 32).cast("string"), F.when(at % 2 == 0, " A").otherwise(" B")).alias("manager"),
        F.col("full_name").alias("player_name"),
        F.element_at(F.array(*[F.lit(s) for s in SHEET_SLOTS]), pair + 1).alias("slot"),
        F.element_at(F.array(*[F.lit(s) for s in SHEET_POSITIONS]), pair + 1).alias("position"),
        F.when(F.col("key") % 9 != 0, value).alias("yahoo_projection"),
        F.when(pair < 9, "starters").otherwise("bench").alias("table"),
        (F.col("key") % 5 == 2).alias("questionable"),
    )


def matchup_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchup sheets as text; one in seven shows another week, one in eleven has started."""
    e = sheet_entries(spark, sf_dir)
    started = (F.col("sheet") % 11 == 10) & (F.col("pair") == 0) & (F.col("side") == 0)
    name = F.concat("player_name", F.when(F.col("questionable"), "Q").otherwise(""), F.lit("Video ForecastPlayer Note"))
    block = F.concat_ws(
        "\n", name, F.concat(F.lit("Dal - "), "position"), F.when(started, "Final W 24-10").otherwise("Sun 12:00 pm @ Buf")
    )
    cell = F.when(F.col("yahoo_projection").isNull(), "–").otherwise(F.format_string("%.2f", "yahoo_projection"))
    entry = F.struct("pair", "side", "slot", block.alias("block"), cell.alias("cell"))
    sheets = e.groupBy("sheet").agg(F.array_sort(F.collect_list(entry)).alias("e"))

    def table_text(first: int, last: int) -> Column:
        def row(i: Column) -> Column:
            def one(side: int) -> Column:
                return F.try_element_at(F.filter("e", lambda x: (x["pair"] == i) & (x["side"] == side)), F.lit(1))

            def text(side: int) -> Column:
                return F.coalesce(one(side)["block"], F.lit("(Empty)"))

            def points(side: int) -> Column:
                return F.coalesce(one(side)["cell"], F.lit("0.00"))

            return F.concat_ws(
                "\n", text(0), points(0), F.lit("–"),
                F.element_at(F.array(*[F.lit(s) for s in SHEET_SLOTS]), i + 1), F.lit("–"), points(1), text(1), F.lit(""),
            )

        return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(last)), row), "\n")

    header = "Stats\nPlayer\nProj\nFan Pts\nPos\nFan Pts\nProj\nPlayer\nStats\n\n"
    shown = F.when(F.col("sheet") % 7 == 6, SHEET_WEEK + 1).otherwise(SHEET_WEEK).cast("string")
    number = F.col("sheet").cast("string")
    return sheets.select(
        F.concat(F.lit("sheet_"), number).alias("source_file"),
        F.concat(
            F.lit(f"Invented Circle (ID# {SHEET_LEAGUE})\r\nWeek "), shown, F.lit(": Oct 3 - Oct 9\r\n\nTeam "), number,
            F.lit(" A\nFirst\n2-3-0 | 5th\nCompare Managers\nTeam "), number, F.lit(" B\nSecond\n4-1-0 | 1st\nHide Bench Players\n"),
            F.lit(header), table_text(0, 8), F.lit("\n88.40\n–\nTOTAL\n–\n91.10\n"), F.lit(header), table_text(9, 15),
            F.lit("\n0.00\nTOTAL\n0.00\n\nfooter\n"),
        ).alias("value"),
    )


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given raw pages, each with a roster table of its own rows appended.

    Parts are spread over the pages by key, so every page gets a few rows.
    """
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    rows = (
        table(spark, sf_dir, "part")
        .select(
            (F.col("p_partkey") % n).alias("page_id"), "p_partkey",
            F.concat(
                F.lit("<tr><td>"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("</td><td class='t'>"), "p_brand",
                F.lit("</td><td><b>"), "p_type", F.lit("</b>&nbsp;</td></tr>"),
            ).alias("row"),
        )
        .groupBy("page_id")
        .agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("rows"))
    )
    tables = F.concat(
        F.lit("<table><tr><th>Ad</th></tr><tr><td>x</td></tr></table><TABLE id=r><tr><th>Player Name</th><th>NFL Team</th><th>Pos</th></tr>"),
        F.coalesce("rows", F.lit("")), F.lit("</TABLE>"),
    )
    return pages.join(rows, "page_id", "left").select("page_id", F.concat("html", tables).alias("html"))
