"""Forecast comparison under the rule that both captures precede the kickoff.

By default rows that break a rule are marked; ``strict=True`` raises instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sideline.functions.numeric import as_double, at_most
from sideline.functions.text import blank_to_null
from sideline.operators.quantiles import exact_medians
from sideline.operators.schema import one_row_per_key, require
from sideline.schemas import BENCHMARK_SCHEMA_VERSION
from sideline.session import stored

KEYS = ["player_id", "team", "season", "target_week"]
LOCAL_ZONE = "America/New_York"


def schedule_kickoffs(
    schedule: DataFrame, *, season: int | None = None, week: int | None = None, strict: bool = True
) -> DataFrame:
    """One UTC kickoff per (season, week, team) of the regular season.

    ``season`` and ``week`` narrow the schedule; left out, every week is
    covered. With ``strict`` an unreadable date or time, a team that plays
    twice, or an empty result raise; otherwise such kickoffs are null.
    """
    require(
        schedule,
        ["season", "week", "game_type", "gameday", "gametime", "away_team", "home_team", "game_id"],
        "Schedule",
    )
    games = schedule.where(F.upper(F.col("game_type").cast("string")).isin("REG", "REGULAR"))
    if season is not None:
        games = games.where(F.col("season") == season)
    if week is not None:
        games = games.where(F.col("week") == week)
    clock = F.trim(F.col("gametime").cast("string"))
    day = F.date_format(F.try_to_timestamp(F.col("gameday").cast("string")), "yyyy-MM-dd")
    readable = clock.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    local = F.when(readable, F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd H:m")))
    kickoff = F.to_utc_timestamp(local, LOCAL_ZONE)
    if strict:
        bad = F.raise_error(F.concat(F.lit("Invalid kickoff: "), F.col("gameday").cast("string"), F.lit(" "), clock))
        kickoff = F.coalesce(kickoff, bad.cast("timestamp"))
    sides = F.explode(F.array(F.col("away_team"), F.col("home_team")))
    result = games.select("season", "week", "game_id", kickoff.alias("kickoff_utc"), sides.alias("team")).select(
        "season", "week", F.upper("team").alias("team"), "game_id", "kickoff_utc"
    )
    if strict:
        if not result.limit(1).count():
            raise ValueError("No regular-season games found.")
        result = one_row_per_key(result, ["season", "week", "team"], "Schedule kickoffs")
    return result


def pregame_gate(
    records: DataFrame,
    kickoffs: DataFrame,
    *,
    strict: bool = False,
    week_column: str = "target_week",
) -> DataFrame:
    """Mark each capture missing_kickoff, pregame or post_kickoff.

    A capture at the very second of the kickoff is post-kickoff. Joined on the
    season and week too where the records carry them.
    """
    require(records, ["player_name", "team", "captured_at_utc"], "Capture records")
    keys = ["team"]
    times = kickoffs.select("season", F.col("week").alias(week_column), "team", "kickoff_utc")
    if {"season", week_column} <= set(records.columns):
        keys = ["season", week_column, "team"]
    else:
        times = times.select("team", "kickoff_utc")
    df = records.withColumn("team", F.upper(F.col("team").cast("string"))).join(times, keys, "left")
    taken = F.col("captured_at_utc")
    if dict(records.dtypes)["captured_at_utc"] == "string":
        taken = F.try_to_timestamp(taken)
    df = df.withColumns({"capture_time": taken.cast("timestamp"), "kickoff_time": F.col("kickoff_utc")})
    status = (
        F.when(F.col("capture_time").isNull() | F.col("kickoff_time").isNull(), "missing_kickoff")
        .when(F.col("capture_time") >= F.col("kickoff_time"), "post_kickoff")
        .otherwise("pregame")
    )
    df = df.withColumn("kickoff_status", status)
    if strict:
        late = [r[0] for r in df.where("kickoff_status = 'post_kickoff'").select("player_name").limit(20).collect()]
        if late:
            raise ValueError(f"Post-kickoff captures cannot enter the benchmark: {late}")
    return df


def _checked_identity(df: DataFrame, strict: bool) -> DataFrame:
    """Rows with a full identity; with ``strict`` a missing or blank one raises."""
    bad = F.lit(False)
    for c in KEYS:
        bad = bad | blank_to_null(F.col(c)).isNull()
    if strict and df.where(bad).limit(1).count():
        raise ValueError("Forecast identity must not be missing or empty.")
    return df.where(~bad)


def comparison(
    ours: DataFrame, rival: DataFrame, kickoffs: DataFrame, *, strict: bool = False
) -> DataFrame:
    """Same-player forecasts side by side, both captured before kickoff.

    Rows that may not enter are left out; :func:`refused` returns them with the
    reason. Columns both sides share get the suffixes ``_ours`` and ``_rival``.
    """
    require(ours, [*KEYS, "player_name", "final_projection", "captured_at_utc"], "Own forecasts")
    require(rival, [*KEYS, "player_name", "yahoo_projection", "captured_at_utc"], "Rival forecasts")
    if strict:
        scope = kickoffs.select("season", F.col("week").alias("target_week")).distinct()
        for side in (ours, rival):
            if side.join(scope, ["season", "target_week"], "left_anti").limit(1).count():
                raise ValueError("Forecast season/week does not match the kickoff schedule.")
    own = pregame_gate(_checked_identity(ours, strict), kickoffs, strict=strict)
    own = own.where("kickoff_status = 'pregame'").select(*ours.columns)
    other = pregame_gate(_checked_identity(rival, strict), kickoffs, strict=strict).where("kickoff_status = 'pregame'")
    own = one_row_per_key(own, KEYS, "Own forecasts")
    other = one_row_per_key(other, KEYS, "Rival forecasts")
    shared = [c for c in own.columns if c in other.columns and c not in KEYS]
    own = own.withColumnsRenamed({c: f"{c}_ours" for c in shared})
    other = other.withColumnsRenamed({c: f"{c}_rival" for c in shared})
    return with_errors(own.join(other, KEYS)).withColumn(
        "benchmark_schema_version", F.lit(BENCHMARK_SCHEMA_VERSION)
    )


def refused(records: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """The rows of one side that `comparison` leaves out: kickoff_status post_kickoff, missing_kickoff or missing_identity."""
    blank = F.lit(False)
    for c in KEYS:
        blank = blank | blank_to_null(F.col(c)).isNull()
    gated = pregame_gate(records, kickoffs)
    status = F.when(blank, "missing_identity").otherwise(F.col("kickoff_status"))
    return gated.withColumn("kickoff_status", status).where("kickoff_status <> 'pregame'").select(*records.columns, "kickoff_status")


def with_errors(df: DataFrame) -> DataFrame:
    """Signed (actual minus forecast) and absolute errors; null without an actual."""
    actual = F.col("actual_points") if "actual_points" in df.columns else F.lit(None).cast("double")
    df = df.withColumns(
        {"our_error": actual - F.col("final_projection"), "rival_error": actual - F.col("yahoo_projection")}
    )
    return df.withColumns({"our_absolute_error": F.abs("our_error"), "rival_absolute_error": F.abs("rival_error")})


def attach_actuals(records: DataFrame, actuals: DataFrame, *, strict: bool = True) -> DataFrame:
    """Final points by player-week, with status finalized or pending; errors are refreshed."""
    keys = ["player_id", "season", "target_week"]
    require(actuals, [*keys, "actual_points"], "Actuals")
    known = actuals.select(*keys, "actual_points")
    if strict:
        known = one_row_per_key(known, keys, "Actuals")
        records = one_row_per_key(records, keys, "Comparison records")
    df = records.drop("actual_points").join(known, keys, "left")
    df = df.withColumn("actual_status", F.when(F.col("actual_points").isNotNull(), "finalized").otherwise("pending"))
    return with_errors(df) if {"final_projection", "yahoo_projection"} <= set(df.columns) else df


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def head_to_head(
    records: DataFrame,
    forecasts: Sequence[tuple[str, str]] = (("Ours", "final_projection"), ("Rival", "yahoo_projection")),
) -> DataFrame:
    """Error metrics of each forecast over finalised, pregame rows where all numbers are known.

    The errors (model and one number) are stored once; the metrics and the passes of the medians read them.
    """
    columns = ["actual_points", *[c for _, c in forecasts]]
    require(records, [*columns, "kickoff_status"], "Comparison records")
    known = F.col("kickoff_status") == "pregame"
    df = records.withColumns({c: as_double(F.col(c)) for c in columns})
    for c in columns:
        known = known & _finite(F.col(c))
    names = F.create_map(*[F.lit(x) for label, c in forecasts for x in (c, label)])
    long = (
        df.where(known)
        .select(*columns)
        .unpivot(["actual_points"], [c for _, c in forecasts], "_column", "forecast")
        .select(
            F.element_at(names, F.col("_column")).alias("model"),
            (F.col("actual_points") - F.col("forecast")).alias("error"),
        )
        .withColumn("absolute", F.abs("error"))
    )
    long = stored(long, "head-to-head")
    medians = exact_medians(long, "absolute", "model")
    metrics = long.groupBy("model").agg(
        F.count(F.lit(1)).alias("examples"),
        F.avg("absolute").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("error").alias("bias"),
        *[
            F.avg(F.when(at_most(F.col("absolute"), n), 1.0).otherwise(0.0)).alias(f"within_{n}_points")
            for n in (2, 3, 5)
        ],
    )
    median = F.lit(None).cast("double")
    for model, value in medians.items():
        median = F.when(F.col("model") == model, F.lit(value)).otherwise(median)
    return metrics.withColumn("median_absolute_error", median)
