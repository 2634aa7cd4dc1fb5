"""Streaming forms of three batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sideline.operators.compare import pregame_gate
from sideline.operators.events import event_rollup
from sideline.operators.status import injury_note, season_ending
from sideline.session import shared_dir


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A query's checkpoint folder in the shared place."""
    return f"{shared_dir(spark)}/streams/{name}"


# The key by which Spark knows a column whose groups close once the watermark has passed it.
_CLOSES = "spark.watermarkDelayMs"


def stream_event_rollup(plays: DataFrame, *, week_end: Column, time_column: str = "ts", delay: str = "1 day") -> DataFrame:
    """Plays to one row per player-week, once the watermark of the plays' times has passed ``week_end``.

    ``week_end`` is the time at which a play's week is over, the same for all plays of one season and week. A play that comes
    after its week was closed is dropped. The batch roll-up itself, with the end of the week as one more grouping column.
    """
    return event_rollup(
        plays.withWatermark(time_column, delay), time_keys=[week_end.alias("week_end", metadata={_CLOSES: 0})]
    )


STATUS = "player_id string, week int, status string, injury string, updated_us long, injury_flag string, injury_note string, season_ending boolean"


def stream_latest_status(injuries: DataFrame, target_week: int) -> DataFrame:
    """Newest unavailability per player up to a week, as a stream of changes: a row whenever a player has a newer one.

    An aggregate that combines before its shuffle: what reaches the state is one row per player and task, what it holds one small
    row per player (the newest by `latest_status`'s sort key, and when it first came). Only rows that came with the batch itself
    are news; a time of arrival is the batch's own, the same if the batch is run again. Rows that leave a player available are
    dropped first, so a cleared player keeps an older flag, as in the batch form.
    """
    flagged = injuries.where((F.col("week") <= target_week) & (F.col("injury_flag") != ""))
    batch_time = F.unix_micros(F.current_timestamp())
    rows = flagged.select(
        "player_id", "week", "status", "injury", F.unix_micros("updated").alias("updated_us"), "injury_flag",
        injury_note().alias("injury_note"), season_ending().alias("season_ending"), batch_time.alias("arrived"),
    )
    # Of equal rows the one that came first stays, so that a repeated row is no news.
    order = F.struct("week", F.col("updated_us").isNull().alias("undated"), "updated_us", "status", "injury", (-F.col("arrived")).alias("first"))
    newest = rows.groupBy("player_id").agg(F.max_by(F.struct(*rows.columns[1:]), order).alias("r"))
    return newest.where(F.col("r.arrived") == batch_time).select("player_id", "r.*").drop("arrived")


def write_changes(changes: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append each batch's changes as its own part; a batch that is run again writes the same part again."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", checkpoint_location(changes.sparkSession, name))
        .trigger(availableNow=True)
        .start()
    )


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The newest change of every player from the parts written so far."""
    parts = spark.read.schema(f"{STATUS}, batch long").parquet(path)
    row = F.struct(*[c for c in parts.columns if c not in ("player_id", "batch")])
    return parts.groupBy("player_id").agg(F.max_by(row, "batch").alias("r")).select("player_id", "r.*")


def stream_pregame_gate(captures: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """Captures of a stream marked against the static kickoff table."""
    return pregame_gate(captures, kickoffs, strict=False)
