"""Quality classifier by co-training (operator 10).

Two views of a document: its words (hashed word frequencies, variety, character classes), and its page metadata (language,
source, length, lines, word and line lengths, typography). A classifier of each view is fitted on labelled rows. Over a few
rounds each one labels the unlabelled rows it is surest of for the other one, and both are fitted anew. Rows set aside
calibrate each view, and weigh both views against each other for the score of every document.

Fitting uses at most ``MAX_LABELLED`` labelled ids, those with the lowest hashes, and in each round the surest of all unlabelled
ids, in number ``PER_ROUND`` of them or of ``MAX_POOL`` if they are more. The numbers of all documents are stored once, a row per
id; a round is a pass over them, and only the rows it picks reach the driver, where the fit runs. Scoring is one pass over all
whole texts, without a shuffle.

Null texts count as empty, null languages and sources as a value of their own, a null n_chars as 0. A null id is never in
the sample but is scored. Repeated labels of an id count once, as the lowest. Without labels of both classes every document
is kept, with null scores. Repeated rows get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm.common import stored, text_slices, work_tables

MAX_LABELLED, MAX_POOL = 12_000, 8_000
ROUNDS, SURE, PER_ROUND = 4, 0.995, 0.05  # rounds, least confidence, largest share of the pool given over per round and view
HELD_OUT = 5  # every fifth labelled row calibrates
RIDGE = 1.0
KEEP_FROM = 0.5
WORD_CELLS, SOURCE_CELLS, LANG_CELLS = 256, 64, 16
_CLASS_CHARS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".,;:'\"()-!?")
TEXT_DIMS = WORD_CELLS + 8 + len(_CLASS_CHARS) + 2
META_DIMS = LANG_CELLS + SOURCE_CELLS + 12


_SYMBOL = re.compile(rb"[#*$%&|<>{}\[\]!@^~=+_\\]")


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASS_CHARS), np.int64)
    table[128:] = len(_CLASS_CHARS) + 1
    for cls, chars in enumerate(_CLASS_CHARS):
        table[list(chars.encode())] = cls
    return table


_TABLE = _class_table()


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of one document."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    cells = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, n) % WORD_CELLS, minlength=WORD_CELLS) if n else np.zeros(WORD_CELLS)
    classes = np.bincount(_TABLE, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=len(_CLASS_CHARS) + 2)
    some = n + 20  # damps the shares of short texts
    marked = sum(map(bool, map(_SYMBOL.search, words)))
    again = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    pairs = len(set(zip(words, words[1:], strict=False)))
    variety = [np.log1p(n), len(set(words)) / max(n, 1), cells.max() / some, marked / some, again / some, (n - 1 - pairs) / some if n else 0.0, n < 8, n < 30]
    content = np.concatenate([np.sqrt(cells / some), np.sqrt(classes / (len(raw) + 100)), variety])
    lines = raw.count(b"\n") + 1
    place = np.zeros(LANG_CELLS + SOURCE_CELLS)
    place[zlib.crc32((lang or "").encode()) % LANG_CELLS] = 1
    place[LANG_CELLS + zlib.crc32((source or "").encode()) % SOURCE_CELLS] = 1
    letters = classes[0] + classes[1]
    layout = [
        np.log1p(max(n_chars or 0, 0)), np.log1p(lines), np.log1p(n / lines), np.log1p(len(raw) / lines), sum(map(len, words)) / max(n, 1),
        max(map(len, words), default=0) ** 0.5, classes[1] / max(letters, 1), n / max(len(raw), 1),
        len(zlib.compress(raw, 1)) / (len(raw) + 100), classes[len(_CLASS_CHARS)] / (len(raw) + 100), classes[2] / (len(raw) + 100), classes[4] / (len(raw) + 100),
    ]
    return content, np.concatenate([place, layout])


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0)
        self.spread[self.spread < 1e-9] = 1
        z = self._with_one(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), RIDGE)
        penalty[-1] = 1e-6
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.spread, -8, 8), np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._with_one(x) @ self.w


def _two_classes(y: np.ndarray) -> bool:
    return len(np.unique(y)) == 2


PICKED = T.StructType([T.StructField("view", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("depth", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("meta", T.BinaryType())])


def _views(content: list[bytes], meta: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(c), np.float32).reshape(len(c), dims).astype(np.float64) for c, dims in ((content, TEXT_DIMS), (meta, META_DIMS))]


def _picker(shared):
    def run(batches):
        models, given, most = shared.value
        best: dict[tuple[int, int], list] = {(ours, label): [] for ours in (0, 1) for label in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, content, meta = (batch.column(i).to_pylist() for i in range(3))
            for ours, view in enumerate(_views(content, meta)):
                odds = models[ours].odds(view)
                for i in np.flatnonzero(np.abs(odds) > np.log(SURE / (1 - SURE))).tolist():
                    if ids[i] not in given[1 - ours]:
                        best[ours, int(odds[i] > 0)].append((-abs(odds[i]), ids[i], content[i], meta[i]))
            best = {k: heapq.nsmallest(most[k[1]], rows) for k, rows in best.items()}
        rows = [(*k, *row) for k, kept in best.items() for row in kept]
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=PICKED.names)

    return run


def surest(pool: DataFrame, models: list[Logistic], given: list[dict[int, float]], most: dict[int, int]):
    """The ``most`` documents of each label that a view's model is surest of, by view, if the other view has not been given them."""
    shared = pool.sparkSession.sparkContext.broadcast((models, given, most))
    rows = pool.select("id", "content", "meta").mapInArrow(_picker(shared), PICKED)
    place = F.row_number().over(Window.partitionBy("view", "label").orderBy("depth", "id"))
    limit = F.when(F.col("label") == 1, most[1]).otherwise(most[0])
    return rows.withColumn("place", place).where(F.col("place") <= limit).toPandas()


def co_train(views: list[np.ndarray], y: np.ndarray, pool: DataFrame):
    """Classifier and calibration of each view, and of both together, from labelled rows and a pool without labels."""
    held = np.arange(len(y)) % HELD_OUT == 0
    if not (_two_classes(y[held]) and _two_classes(y[~held])):
        held = np.zeros(len(y), bool)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has received
    taken: list[dict[int, np.ndarray]] = [{}, {}]  # and the numbers of these documents in it
    models = [Logistic(v[~held], y[~held]) for v in views]
    unlabelled = pool.count()
    for _ in range(ROUNDS if unlabelled else 0):
        most = {label: max(1, int(PER_ROUND * (y[~held] == label).mean() * min(unlabelled, MAX_POOL))) for label in (0, 1)}
        new = surest(pool, models, given, most)
        both = _views(new["content"].tolist(), new["meta"].tolist())
        for i, (ours, label, key) in enumerate(zip(new["view"].tolist(), new["label"].tolist(), new["id"].tolist(), strict=True)):
            given[1 - ours][key], taken[1 - ours][key] = float(label), both[1 - ours][i]
        for k in (0, 1):
            rows = sorted(given[k])
            models[k] = Logistic(np.vstack([views[k][~held], *(taken[k][i] for i in rows)]), np.concatenate([y[~held], [given[k][i] for i in rows]]))
        if not len(new):
            break
    check = held if held.any() else ~held
    odds = np.stack([m.odds(v[check]) for m, v in zip(models, views, strict=True)], axis=1)
    return models, [Logistic(odds[:, [k]], y[check]) for k in (0, 1)], Logistic(odds, y[check])


SAMPLE = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("meta", T.BinaryType())])


def _rows_of(batch, first: int):
    return zip(*(batch.column(first + i) if i == 0 else batch.column(first + i).to_pylist() for i in range(4)), strict=True)


def _sampled(batches):
    for batch in text_slices(batches):
        both = [features(t.as_py(), lang, source, n) for t, lang, source, n in _rows_of(batch, 1)]
        binary = lambda k: pa.array([b[k].astype(np.float32).tobytes() for b in both], pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([batch.column(0), binary(0), binary(1)], names=SAMPLE.names)


SCORED = T.StructType([T.StructField("key", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")])


def _scorer(shared):
    def run(batches):
        fitted = shared.value
        for batch in text_slices(batches):
            both = [features(t.as_py(), lang, source, n) for t, lang, source, n in _rows_of(batch, 1)]
            n = len(both)
            if fitted is None or not n:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.nulls(n, pa.float64()) for _ in range(3))], names=SCORED.names)
                continue
            models, scales, joint = fitted
            odds = np.stack([m.odds(np.stack([b[k] for b in both])) for k, m in enumerate(models)], axis=1)
            chance = lambda o: pa.array(1 / (1 + np.exp(-np.clip(o, -30, 30))))
            views = [chance(scale.odds(odds[:, [k]])) for k, scale in enumerate(scales)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *views, chance(joint.odds(odds))], names=SCORED.names)

    return run


def _columns() -> list:
    return [F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality"):
    """Both classifiers with their calibrations, or None without labels of both classes."""
    with work_tables():
        return _fit(docs, labels, key, label)


def _fit(docs: DataFrame, labels: DataFrame, key: str, label: str):
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *_columns()).mapInArrow(_sampled, SAMPLE)
    # Repeated rows of an id are reduced to the lowest before anything is counted or collected, in the tasks that read them first.
    distinct = rows.groupBy("id").agg(F.min(F.struct("content", "meta")).alias("row")).select("id", "row.*")
    numbers = stored(distinct.join(marked, "id", "left"), "co-training")
    known = numbers.where("label IS NOT NULL")
    chosen = known.select("id").orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    got = known.join(F.broadcast(chosen), "id", "left_semi").toPandas()
    got = got.sort_values("id").iloc[np.argsort([zlib.crc32(int(i).to_bytes(8, "little", signed=True)) for i in sorted(got["id"])], kind="stable")]
    y = got["label"].to_numpy()
    if not _two_classes(y):
        return None
    return co_train(_views(got["content"].tolist(), got["meta"].tolist()), y.astype(float), numbers.where("label IS NULL"))


def score(docs: DataFrame, fitted, key: str = "doc_id") -> DataFrame:
    """Per document: key, text_score, meta_score, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    scored = docs.select(F.col(key).cast("long").alias("key"), *_columns()).mapInArrow(_scorer(shared), SCORED)
    kept = F.coalesce(F.col("score") >= KEEP_FROM, F.lit(True))
    return scored.select(F.col("key").alias(key), "text_score", "meta_score", "score", kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    return score(docs, fit(docs, labels, key, label), key)


def kept_only(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents the classifier keeps, with their columns."""
    fitted = fit(docs, labels, key, label)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    at = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def keep(batches):
        for batch in text_slices(batches, at[0]):
            pick = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), *(batch.column(i) for i in at)], names=["key", "text", "lang", "source", "n_chars"])
            for scored in _scorer(shared)(iter([pick])):
                odds = scored.column(3).to_pylist()
                yield batch.filter(pa.array([s is None or s >= KEEP_FROM for s in odds], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
