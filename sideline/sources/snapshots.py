"""Append-only forecast snapshots, their manifest, comparison batches and validation archives."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.functions.numeric import number_or_null
from sideline.functions.text import blank_to_null
from sideline.operators.schema import one_row_per_key, require
from sideline.schemas import MANIFEST_SCHEMA, SNAPSHOT_COLUMNS, SNAPSHOT_SCHEMA_VERSION

# fixed values
EXPERIMENT = "defensive_matchup_opponent_v2"
INVALID_EXPERIMENT = "defensive_matchup_candidate"
INVALID_NOTE = "INVALID matchup evidence: own-team join"
RESEARCH_NOTE = "Research only; not approved for production"
OFFENSE_ROW = "Offense (QB/RB/WR/TE)"

_METADATA = ("app_version", "feature_version", "scoring_version", "primary_projection_model")


def _now() -> datetime:
    return datetime.now(timezone.utc)


def new_id(moment: datetime | None = None) -> str:
    """Sortable unique id: two runs in the same second do not collide."""
    return f"{(moment or _now()).strftime('%Y%m%dT%H%M%SZ')}_{uuid.uuid4().hex[:12]}"


def league_scope(roster: DataFrame, projections: DataFrame) -> DataFrame:
    """Every roster row with its forecast where there is one.

    Roster columns win over forecast columns. A team defence has the id
    ``DEF:<team>``. A blank id matches nothing and is reported as unresolved; a
    player forecast twice is an error.
    """
    require(roster, ["manager", "slot", "player", "position", "team", "nflverse_player_id"], "Snapshot roster")
    require(projections, ["player_id", "player_name", "position", "team", "projection"], "Projections")
    team = F.trim(F.coalesce(F.col("team").cast("string"), F.lit("")))
    unit = (F.col("position") == "DEF") & (team != "")
    league = roster.withColumn(
        "player_id",
        F.when(unit, F.concat(F.lit("DEF:"), team)).otherwise(
            F.coalesce(F.trim(F.col("nflverse_player_id").cast("string")), F.lit(""))
        ),
    ).withColumnsRenamed({"player": "player_name", "manager": "fantasy_manager", "slot": "roster_slot"})
    values = projections.drop(*[c for c in projections.columns if c in league.columns and c != "player_id"])
    values = values.withColumn("_pid", blank_to_null(F.col("player_id"))).drop("player_id").where("_pid IS NOT NULL")
    values = one_row_per_key(values, ["_pid"], "Projections")
    df = league.join(values, F.nullif(F.col("player_id"), F.lit("")) == F.col("_pid"), "left").drop("_pid")
    status = (
        F.when(F.col("player_id") == "", "identity_unresolved")
        .when(number_or_null(df, "projection").isNull(), "forecast_unavailable")
        .otherwise("available")
    )
    return df.withColumns({"snapshot_scope": F.lit("league_roster"), "forecast_status": status})


def snapshot_frame(
    projections: DataFrame, *, snapshot_id: str, captured_at_utc: str, season: int, target_week: int,
    metadata: Mapping[str, object],
) -> DataFrame:
    """The fixed snapshot schema. What only later evaluation knows stays null."""
    require(projections, ["player_id", "player_name", "position", "team", "projection"], "Projections")
    literal = {
        "snapshot_id": snapshot_id, "captured_at_utc": captured_at_utc, "schema_version": SNAPSHOT_SCHEMA_VERSION,
        "season": int(season), "target_week": int(target_week),
        **{k: str(metadata.get(k, "unknown")) for k in _METADATA},
    }
    later = ("yahoo_projection", "actual_points", "actual_finalized_at_utc")
    columns = []
    for name, kind in SNAPSHOT_COLUMNS.items():
        if name in literal:
            c = F.lit(literal[name])
        elif name in later:
            c = F.lit(None)
        elif name == "final_projection":
            c = number_or_null(projections, "projection")
        elif name == "snapshot_scope":
            c = F.col(name) if name in projections.columns else F.lit("nfl_projection_pool")
        elif kind == "double":
            c = number_or_null(projections, name)
        else:
            c = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in projections.columns else F.lit("")
        columns.append(c.cast(kind).alias(name))
    return projections.select(*columns)


def save_snapshot(
    projections: DataFrame, root: str, *, season: int, target_week: int, metadata: Mapping[str, object]
) -> str:
    """Append one snapshot and its manifest row; nothing written earlier is opened for writing.

    The manifest row comes after the data and counts what was stored.
    """
    spark = projections.sparkSession
    moment = _now()
    snapshot_id, stamp = new_id(moment), moment.strftime("%Y-%m-%dT%H:%M:%SZ")
    frame = snapshot_frame(
        projections, snapshot_id=snapshot_id, captured_at_utc=stamp, season=season, target_week=target_week,
        metadata=metadata,
    )
    frame.write.mode("append").partitionBy("snapshot_id").parquet(f"{root}/predictions")
    stored = spark.read.parquet(f"{root}/predictions/snapshot_id={snapshot_id}").count()
    row = (
        snapshot_id, stamp, SNAPSHOT_SCHEMA_VERSION, int(season), int(target_week), stored,
        f"predictions/snapshot_id={snapshot_id}", *[str(metadata.get(k, "unknown")) for k in _METADATA],
    )
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(
        f"{root}/snapshot_index"
    )
    return snapshot_id


def _read_or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def snapshot_index(spark: SparkSession, root: str) -> DataFrame:
    """The manifest, without touching any snapshot data."""
    return _read_or_empty(
        spark, MANIFEST_SCHEMA, lambda: spark.read.schema(MANIFEST_SCHEMA).csv(f"{root}/snapshot_index", header=True)
    )


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots, older column sets included."""
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/predictions")
    return df.select(*[c for c in SNAPSHOT_COLUMNS if c in df.columns], *[c for c in df.columns if c not in SNAPSHOT_COLUMNS])


def save_comparison(records: DataFrame, root: str) -> str:
    """Append a comparison as its own immutable batch."""
    batch_id = new_id()
    records.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("batch_id").parquet(root)
    return batch_id


# ------------------------------------------------------- validation archive

REPORT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("position", "model")]
    + [T.StructField("examples", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("mae", "rmse", "bias", "within_3_points", "within_5_points")]
    + [T.StructField("holdout_season", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("training_seasons", "experiment", "source", "precision", "captured_at_utc", "run_id")]
)


def save_report(
    report: DataFrame, root: str, training_seasons: Sequence[int], holdout_season: int, *,
    source: str = "computed", precision: str = "full", experiment: str = EXPERIMENT,
) -> str:
    """Archive one holdout report with its provenance; earlier ones stay as they are."""
    run_id = uuid.uuid4().hex
    have = set(report.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in REPORT_SCHEMA.fields[:8]
    ]
    columns += [
        F.lit(int(holdout_season)).alias("holdout_season"),
        F.lit(",".join(str(s) for s in training_seasons)).alias("training_seasons"),
        F.lit(experiment).alias("experiment"), F.lit(source).alias("source"), F.lit(precision).alias("precision"),
        F.lit(_now().isoformat()).alias("captured_at_utc"), F.lit(run_id).alias("run_id"),
    ]
    report.select(*columns).coalesce(1).write.mode("append").option("header", True).csv(f"{root}/validation_runs")
    return run_id


def load_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every archived report with its review status."""
    df = _read_or_empty(
        spark, REPORT_SCHEMA, lambda: spark.read.schema(REPORT_SCHEMA).csv(f"{root}/validation_runs", header=True)
    )
    return df.withColumn(
        "review_status", F.when(F.col("experiment") == INVALID_EXPERIMENT, INVALID_NOTE).otherwise(RESEARCH_NOTE)
    )


def project_report(spark: SparkSession, snapshots_root: str, reports_root: str, imports_root: str) -> dict[str, DataFrame]:
    """The tables of the project report: holdout, latest snapshots, imports, readiness."""
    index = snapshot_index(spark, snapshots_root)
    latest = index.orderBy(F.desc("captured_at_utc"), F.desc("snapshot_id")).limit(8)
    imports = _read_or_empty(
        spark,
        T.StructType(
            [T.StructField("batch_id", T.StringType()), T.StructField("complete_roster_coverage", T.BooleanType())]
        ),
        lambda: spark.read.parquet(f"{imports_root}/summary"),
    )
    ready = imports.agg(
        F.count(F.lit(1)).alias("imports"), F.coalesce(F.bool_and("complete_roster_coverage"), F.lit(False)).alias("all_complete")
    ).select("imports", F.when((F.col("imports") > 0) & F.col("all_complete"), "READY").otherwise("PENDING").alias("coverage"))
    return {
        "holdout": load_reports(spark, reports_root).where(F.col("position") == OFFENSE_ROW),
        "snapshots": latest,
        "imports": imports,
        "status": ready,
    }
