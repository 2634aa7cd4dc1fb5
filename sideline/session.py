"""Session helpers: one builder for local runs, one place that finds the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sideline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording a Python call site for every column expression costs more
        # than planning the query; turn it on to debug.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_STAND_IN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only local mode, where
    driver and executors are one process, may do without: a fresh temporary
    folder stands in, one per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    app = spark.sparkContext.applicationId
    if app not in _STAND_IN:
        _STAND_IN[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _STAND_IN[app]


def ensure_checkpointing(spark: SparkSession) -> str:
    """Point the context at the shared folder so ``DataFrame.checkpoint`` and spark.ml can use it."""
    folder = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later jobs neither recompute them nor depend on their executors."""
    path = f"{shared_dir(df.sparkSession)}/sideline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
