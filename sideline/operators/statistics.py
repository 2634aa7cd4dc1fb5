"""Sufficient statistics of linear fits: one pass over all rows, one small matrix per season; folds add matrices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "by long, cells array<double>"


@dataclass(frozen=True)
class SeasonSums:
    """Per season, the sums of all products of two of ``1, *names``: row count, sums, squares and cross products in one matrix."""

    names: list[str]
    of: dict[int | None, np.ndarray]

    def add(self, seasons: Iterable[int | None]) -> np.ndarray:
        """The matrix of several seasons together."""
        size = len(self.names) + 1
        return sum((self.of[s] for s in seasons if s in self.of), np.zeros((size, size)))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix per season of a task's rows (by, then doubles without nulls)."""
    sums: dict[int | None, np.ndarray] = {}
    for batch in batches:
        by = batch.column(0).to_numpy(zero_copy_only=False)
        values = np.column_stack([np.ones(batch.num_rows), *(np.asarray(c) for c in batch.columns[1:])])
        lost = np.asarray(batch.column(0).is_null())
        for season in {None} if lost.all() else {*np.unique(by[~lost]).astype(int).tolist(), *([None] if lost.any() else [])}:
            rows = values[lost if season is None else ~lost & (by == season)]
            sums[season] = sums.get(season, 0) + rows.T @ rows
    cells = [m.ravel() for m in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(cells, pa.list_(pa.float64()))], names=["by", "cells"])


def season_sums(rows: DataFrame, columns: Sequence[str], by: str | None = None) -> SeasonSums:
    """Sums of products of double columns (no nulls) per value of ``by``, or of all rows under the name null.

    Each task folds its rows to a matrix per season; the matrices are added cell by cell in Spark. What is collected has
    seasons x columns² cells, whatever the number of rows or tasks.
    """
    key = F.col(by).cast("long") if by else F.lit(None).cast("long")
    parts = rows.select(key.alias("by"), *columns).mapInArrow(_partial, PARTIAL)
    added = parts.select("by", F.posexplode("cells").alias("at", "value")).groupBy("by", "at").agg(F.sum("value").alias("value")).toPandas()
    size = len(columns) + 1
    out: dict[int | None, np.ndarray] = {}
    for by_value, group in added.groupby("by", dropna=False):
        matrix = np.zeros(size * size)
        matrix[group["at"].to_numpy()] = group["value"].to_numpy()
        out[None if by_value != by_value else int(by_value)] = matrix.reshape(size, size)
    return SeasonSums(list(columns), out)


@dataclass(frozen=True)
class Ridge:
    """A solved ridge: population means and deviations of the scaled columns, weights of all columns, intercept, row count."""

    n: int
    means: np.ndarray
    stds: np.ndarray
    weights: np.ndarray
    intercept: float


def solve_ridge(sums: np.ndarray, scaled: int, flags: Sequence[int], penalty: float) -> Ridge:
    """Ridge with an unpenalised intercept from a matrix over ``1, scaled columns, flags, target``.

    The first ``scaled`` columns are standardised; ``flags`` are the numbers of further columns taken as they are. A column without
    any variation has a deviation of 0 here and no weight.
    """
    n = sums[0, 0]
    columns = [*range(1, scaled + 1), *flags]
    means = sums[0, 1 : scaled + 1] / n
    squares = sums[range(1, scaled + 1), range(1, scaled + 1)] / n
    variance = squares - means**2
    stds = np.sqrt(np.where(variance > 1e-12 * squares, np.maximum(variance, 0), 0))
    # Standardising is linear, so it is applied to the matrix of products instead of the rows.
    shift = np.zeros((len(columns) + 1, len(sums)))
    shift[0, 0] = 1
    for i, c in enumerate(columns, 1):
        if i <= scaled:
            if stds[i - 1] > 0:
                shift[i, c], shift[i, 0] = 1 / stds[i - 1], -means[i - 1] / stds[i - 1]
        else:
            shift[i, c] = 1
    left = shift @ sums @ shift.T + penalty * np.diag([0.0, *np.ones(len(columns))])
    found = np.linalg.solve(left, shift @ sums[:, -1])
    return Ridge(int(round(n)), means, stds, found[1:], float(found[0]))
