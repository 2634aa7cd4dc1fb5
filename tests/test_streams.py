"""Streams over several batches."""

import itertools
import uuid

from pyspark.sql import functions as F

from sideline.operators import status
from sideline.streaming import streams
from sideline.streaming.streams import stream_event_rollup


def test_week_of_several_days(spark, tmp_path):
    """Plays of two days of one week, in two batches, make one row; a play after the week was closed makes no second one."""
    schema = "season int, week int, ts timestamp, kicker_player_id string, extra_point_result string"
    end = F.timestamp_add("DAY", F.col("week") * 7, F.lit("2024-09-02").cast("timestamp"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = stream_event_rollup(stream, week_end=end).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    for i, (week, day) in enumerate([(1, "2024-09-05"), (1, "2024-09-08"), (2, "2024-09-12"), (1, "2024-09-07"), (20, "2025-01-01")]):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"season": 2024, "week": {week}, "ts": "{day}T12:00:00Z", "kicker_player_id": "k", "extra_point_result": "good"}}')
        out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("season", "week", "player_id", "extra_points_made").collect()
    assert sorted(map(tuple, got)) == [(2024, 1, "k", 2.0), (2024, 2, "k", 1.0)]


def test_status_changes(spark, tmp_path):
    """Over batches in any order the current status is that of the batch form; a batch without news for a player writes no row for them."""
    rows = [
        ("a", "1", "Out", "knee", "2024-09-01 10:00:00"), ("a", "2", "Questionable", "knee", "2024-09-08 10:00:00"), ("a", "2", "IR", "out for season", None),
        ("b", "3", "Out", "", "2024-09-15 10:00:00"), ("b", "3", "Out", "", "2024-09-15 09:00:00"), ("b", "9", "Out", "late", "2024-10-15 10:00:00"), ("c", "x", "Out", "", None),
    ]
    schema = "player_id string, week string, status string, injury string, updated string"
    feed = status.standardize_injuries(spark.createDataFrame(rows, schema))
    want = sorted(map(tuple, status.latest_status(feed, 5).collect()))
    for n, order in enumerate(itertools.islice(itertools.permutations(rows), 0, 5040, 2500)):
        source, out = tmp_path / f"in{n}", str(tmp_path / f"out{n}")
        arriving = status.standardize_injuries(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*")))
        written = []
        for i in range(0, len(order), 3):
            spark.createDataFrame(order[i : i + 3], schema).coalesce(1).write.parquet(str(source / f"{i}"))
            streams.write_changes(streams.stream_latest_status(arriving, 5), out, f"status-test-{tmp_path.name}-{n}").awaitTermination()
            written.append(spark.read.parquet(out).count())
        got = streams.current_status(spark, out).select("player_id", "injury_flag", "injury_note", "season_ending")
        assert sorted(map(tuple, got.collect())) == want
        assert written[-1] <= 5 and written == sorted(written)


def test_status_large_weeks_and_repeats(spark, tmp_path):
    """Repeated rows change nothing."""
    schema = "player_id string, week string, status string, injury string, updated string"
    source = tmp_path / "in"
    arriving = status.standardize_injuries(spark.readStream.schema(schema).parquet(str(source / "*")))
    for i in range(2):
        spark.createDataFrame([("a", "1", "Out", "knee", "2024-09-01 10:00:00")] * 50, schema).write.parquet(str(source / f"{i}"))
        streams.write_changes(streams.stream_latest_status(arriving, 5), str(tmp_path / "out"), f"repeat-{tmp_path.name}").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_status_state_is_an_aggregate(spark, tmp_path):
    """The newest row is kept by Spark's own aggregate, combined before the shuffle: no Python per player and batch.

    A row that comes again in a later batch, alone or beside an older one, is no news; a newer one is, once.
    """
    schema = "player_id string, week string, status string, injury string, updated string"
    source, out, name, plans = tmp_path / "in", str(tmp_path / "out"), f"aggregate-{uuid.uuid4().hex}", []
    arriving = status.standardize_injuries(spark.readStream.schema(schema).parquet(str(source / "*")), ascii_only=True)
    old, new = ("a", "1", "Out", "knee", "2024-09-01 10:00:00"), ("a", "2", "Out", "knee", "2024-09-08 10:00:00")
    for i, batch in enumerate([[old] * 3, [old], [old, new, new], [new, old], [("b", "1", "Out", "", None), ("b", "1", "Out", "", None)]]):
        spark.createDataFrame(batch, schema).write.parquet(str(source / f"{i}"))
        done = streams.write_changes(streams.stream_latest_status(arriving, 5), out, name)
        done.awaitTermination()
        plans.append(done._jsq.explainInternal(False))
    got = spark.read.parquet(out).select("player_id", "week", "updated_us").collect()
    assert sorted((r["player_id"], r["week"], r["updated_us"] is None) for r in got) == [("a", 1, False), ("a", 2, False), ("b", 1, True)]
    assert all("Python" not in p and "Pandas" not in p for p in plans) and any("StateStoreSave" in p for p in plans)
