"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.session import shared_dir

# A word is a run of characters other than the six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: list[list[DataFrame]] = []


def stored(df: DataFrame, tag: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on its executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def work_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose stored tables are deleted at its end. What it gives stores a result that outlives them."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    kept: list[DataFrame] = []

    def keep(result: DataFrame) -> DataFrame:
        out = stored(result, "result")
        made.remove(out)
        kept.append(out)
        return out

    try:
        yield keep
    finally:
        _SCOPES.pop()
        for table in made:
            if table in _PATHS:
                drop_stored(table.sparkSession, table)
        if _SCOPES:  # an outer scope ends the result too
            _SCOPES[-1].extend(kept)


def drop_stored(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete work tables (or folders of the shared folder) that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for each in tables:
        path = jvm.org.apache.hadoop.fs.Path(each if isinstance(each, str) else _PATHS.pop(each))
        path.getFileSystem(conf).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut where the texts of a column would make large arrays; a longer text alone."""
    for batch in batches:
        reach = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
        at = 0
        while at < len(reach):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + chars, "right")))
            yield batch.slice(at, end - at)
            at = end


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")
