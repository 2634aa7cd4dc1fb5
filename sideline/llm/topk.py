"""Exact top-k inner products by Fagin's threshold algorithm (operator 6).

Every dimension of a block of vectors is a list sorted by value. A query reads the lists of its dimensions side by side, from
the end that raises its score, scores what it meets, and stops once the sum of the values at its depth cannot beat its k-th
result. Blocks are made of near vectors (nearest of a few centres, fitted on a bounded sample), and each query first runs
over one block of its own centre: its k-th score there is a lower bound with which it meets all other blocks, most of which it
leaves at the first threshold. Results are exact whatever the centres are.

Vectors are turned into integers first. Null vectors, vectors with null or non-finite components and rows with a null id take
no part; equal rows count once; a query is compared with vectors of its own length and never with a row of its own id. An
empty table gives an empty result. A block has a bounded number of rows, also where one vector holds a third of the table:
near vectors beyond that number go to further blocks. Queries meet blocks as pairs of packed rows by an equi-join on the
block number. Both sides of it are dealt out by that number: the packs' size is not seen in a plan's estimates, and a broadcast
would take the queries of every block, which grow with the square of the table, through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm.common import stored

BLOCK = 4096  # vectors of a block, on average
QUERIES = 2048  # queries packed into one row, on average
CENTRES, SAMPLE = 32, 4000  # centres, and vectors they are fitted on (lowest hashes of the id)
FIRST_DEPTH = 32

TASKS = 8  # tasks a core that search, where there are as many blocks

PACKED = T.StructType([T.StructField("pack", T.LongType()), T.StructField("dims", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("values", T.BinaryType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_key", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def integers(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """Rows (id, v, key): floor(scale * x) of the usable vectors, and a hash that tells rows of one id apart."""
    x = F.transform(column, lambda c: c.cast("double"))
    usable = F.col(key).isNotNull() & F.col(column).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return rows.withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "key"])


def fit_centres(sample: np.ndarray, count: int = CENTRES) -> np.ndarray:
    """A few rounds of k-means over a bounded sample, started from spread-out rows."""
    rows = np.unique(sample.astype(np.float64), axis=0)
    if len(rows) <= count:
        return rows
    picked = [0]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(picked) < count:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[picked[-1]]) ** 2).sum(axis=1))
    centres = rows[picked]
    for _ in range(8):
        near = nearest(rows, centres)
        for c in range(count):
            if (near == c).any():
                centres[c] = rows[near == c].mean(axis=0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _assign(centres):
    """Adds the nearest centre: the centres are by vector length."""

    def run(batches):
        for batch in batches:
            vectors, cells = batch.column(1), np.zeros(batch.num_rows, np.int32)
            sizes = np.asarray(pc.list_value_length(vectors))
            for size in np.unique(sizes):
                own = centres.value.get(int(size))
                at = np.flatnonzero(sizes == size)
                if own is not None and len(own):
                    cells[at] = nearest(_matrix(vectors.take(pa.array(at))).astype(np.float64), own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """All rows of one pack, as one row of flat arrays, in order of id."""
    table = table.sort_by([("id", "ascending"), ("key", "ascending")])
    flat = _matrix(table.column("v").combine_chunks()).astype(np.int64)
    ids, keys = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "key"))
    row = [[table.column("pack")[0].as_py()], [flat.shape[1]], [ids.tobytes()], [keys.tobytes()], [narrow(flat).tobytes()]]
    return pa.Table.from_arrays([pa.array(c, f) for c, f in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=PACKED.names)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold all of them."""
    kinds = (np.int8, np.int16, np.int32, np.int64)
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def widened(packed: bytes, rows: int, dims: int) -> np.ndarray:
    """A matrix that ``narrow`` packed."""
    width = len(packed) // (rows * dims) if rows * dims else 8
    return np.frombuffer(packed, f"i{width}").astype(np.int64).reshape(rows, dims)


class Lists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)
        # Products in floats run faster, and are exact below 2^53.
        self.exact = values.astype(np.float64) if values.size and np.abs(values).max() < 2**20 else None

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact is not None and np.abs(query).max(initial=0) < 2**20:
            return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.values[rows] @ query

    def search(self, query: np.ndarray, own: int, k: int, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows that reach the bound; ties to smaller ids."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        up = query[dims] > 0
        seen = np.zeros(n, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            at = n - 1 - depth if len(dims) else 0
            head = self.sorted[np.where(up, at, depth), dims]
            threshold = int(head @ query[dims])  # the most that an unseen row can score
            least = bound
            if len(best) >= k:
                least = int(best[k - 1]) if least is None else max(least, int(best[k - 1]))
            if least is not None and threshold < least:
                break
            end = min(n, depth + step) if len(dims) else n
            met = np.zeros(n, bool)
            if len(dims):
                met[self.order[n - end : n - depth][:, dims[up]].ravel()] = True
                met[self.order[depth:end][:, dims[~up]].ravel()] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            scores = self.scores(new, query)
            if bound is not None:
                new, scores = new[scores >= bound], scores[scores >= bound]
            ids, scores = np.concatenate([best_ids, self.ids[new]]), np.concatenate([best, scores])
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[order], scores[order]
            depth, step = end, 2 * step
        return best_ids, best


def _searcher(k: int):
    def run(batches):
        last, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                if row["pack"] != last:
                    last, lists = row["pack"], Lists(ids, widened(row["values"], len(ids), row["dims"]))
                q_ids, q_keys = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_keys"], np.int64)
                if row["q_dims"] != row["dims"]:
                    continue
                queries = widened(row["q_values"], len(q_ids), row["q_dims"])
                bounds = row["bounds"] or [None] * len(q_ids)
                out = [(q, key, *lists.search(v, q, k, b)) for q, key, v, b in zip(q_ids.tolist(), q_keys.tolist(), queries, bounds, strict=True)]
                sizes = [len(x[2]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, sizes)), pa.array(np.repeat(q_keys, sizes)),
                        pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out])),
                    ],
                    names=FOUND.names,
                )

    return run


def _numbered(rows: DataFrame, by: list[str], size: int) -> tuple[DataFrame, int]:
    """Rows with ``pack``: numbers of packs of about ``size`` rows of the same ``by``; and how many packs there are."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by).collect()  # one row a centre and length
    plan, packs = [], 0
    for r in counts:
        parts = -(-r["n"] // size)
        plan.append((*(r[c] for c in by), packs, parts))
        packs += parts
    if not plan:
        return rows.withColumn("pack", F.lit(0).cast("long")).withColumn("first_pack", F.lit(0).cast("long")), 0
    found = None
    for *values, first, parts in plan:
        same = F.lit(True)
        for c, v in zip(by, values, strict=True):
            same = same & (F.col(c) == v)
        both = F.struct(F.lit(first).cast("long").alias("first"), F.lit(parts).cast("long").alias("parts"))
        found = F.when(same, both) if found is None else found.when(same, both)
    rows = rows.withColumn("_at", found)
    pack = F.col("_at.first") + F.pmod(F.xxhash64("id", "key", F.lit(7)), F.col("_at.parts"))
    return rows.withColumn("pack", pack).withColumn("first_pack", F.col("_at.first")).drop("_at"), packs


def _pairs(packs: DataFrame, block: Column, blocks: DataFrame, tasks: int) -> DataFrame:
    """Packs of queries next to the blocks they meet, in order of the blocks."""
    packs = packs.withColumn("block", block).withColumnRenamed("pack", "q_pack").repartition(tasks, "block")
    return packs.join(blocks.repartition(tasks, "pack").hint("merge"), F.col("block") == F.col("pack"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score of its k best."""
    spark = vectors.sparkSession
    rows = integers(vectors, key, column, scale).withColumn("dims", F.size("v"))
    lengths = [r["dims"] for r in rows.groupBy("dims").count().orderBy(F.desc("count")).limit(1000).collect()]
    centres = {}
    for size in lengths[:8]:  # vectors of rarer lengths have no centres, which costs time alone
        own = rows.where(F.col("dims") == size).withColumn("hash", F.xxhash64("id", "key"))
        last = own.select("hash").orderBy("hash").limit(SAMPLE).agg(F.max("hash")).first()[0]  # hashes alone: each task offers as many as the sample has
        sample = own.where(F.col("hash") <= last).select("v").toPandas()["v"]
        centres[size] = fit_centres(np.stack(sample.to_numpy())) if size else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)
    placed = rows.select("id", "v", "key", "dims").mapInArrow(_assign(shared), T.StructType([*rows.select("id", "v", "key", "dims").schema, T.StructField("cell", T.IntegerType())]))
    placed = stored(placed, "vectors")
    packed, packs = _numbered(placed, ["dims", "cell"], BLOCK)
    blocks = stored(packed.select("pack", "id", "key", "v").groupBy("pack").applyInArrow(_pack, PACKED), "blocks")
    queries = packed.where(F.col("id") % every == 0)
    named = lambda df: df.select("pack", *(F.col(c).alias(f"q_{c}") for c in PACKED.names[1:]))
    tasks = max(1, min(packs, TASKS * spark.sparkContext.defaultParallelism))
    order = ["pack", "dims", "ids", "values", "q_dims", "q_ids", "q_keys", "q_values", "bounds"]

    # Each query over the first block of its own centre, for a lower bound of its k-th score.
    home = named(queries.select(F.col("first_pack").alias("pack"), "id", "key", "v").withColumn("pack", F.col("pack") * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("pack").applyInArrow(_pack, PACKED))
    near = _pairs(home, F.expr("pack div 1000000"), blocks, tasks).withColumn("bounds", F.lit(None).cast("array<long>"))
    near = near.select(*order).mapInArrow(_searcher(k), FOUND)
    bounds = near.groupBy("query_id", "query_key").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k)

    # All queries with their bounds over all blocks.
    q, groups = _numbered(queries.select("id", "key", "v", "dims"), ["dims"], QUERIES)
    q = stored(q.join(bounds.select(F.col("query_id").alias("id"), F.col("query_key").alias("key"), "bound"), ["id", "key"], "left"), "queries")
    sides = named(q.select("pack", "id", "key", "v").groupBy("pack").applyInArrow(_pack, PACKED))
    limits = q.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "key", "bound"))), lambda x: x["bound"]).alias("bounds"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(packs - 1, 0)).cast("long")))
    every_block = _pairs(sides.join(limits.hint("merge"), "pack"), numbers, blocks, tasks)
    found = every_block.select(*order).mapInArrow(_searcher(k), FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
