"""K-d tree sharding by weighted medians (operator 3).

A document weighs the bytes of its text plus 1. The tree splits a node at the weighted median of its widest dimension, again
and again, until each leaf holds the target bytes: two small aggregates per level over a narrow stored table, no row moves.
A null text has no bytes; null metadata has the lowest coordinate; documents with equal metadata (copies among them) are
split by a hash of key and text, so a group with a third of all rows is dealt evenly. Repeated rows count each. An empty
table gives an empty result. Columns other than the key, the text and the dimensions are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sideline.llm.common import stored

GRID = 4096  # cells of a dimension
TIES = 65536  # hash cells inside one grid cell
SLOT_RANGES = 4096  # hash ranges of a shard, for numbering its rows


def _cell(dim: str, kind: str) -> Column:
    """Cell of a metadata value: numbers on a logarithmic scale, names by a hash that keeps equal names together."""
    if kind in ("string", "boolean", "date", "timestamp"):
        cell = 1 + F.pmod(F.xxhash64(F.col(dim)), F.lit(GRID - 1))
    else:
        value = F.greatest(F.col(dim).cast("double"), F.lit(0.0))
        cell = 1 + F.least(F.floor(F.log2(1 + value) * 64), F.lit(GRID - 2))
    return F.coalesce(cell, F.lit(0)).cast("int")


def _narrow(docs: DataFrame, key: str, text: str, dims: tuple[str, ...]) -> DataFrame:
    kinds = dict(docs.dtypes)
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0))
    tie = F.xxhash64(F.col(key), crc)
    return docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), crc.cast("long").alias("crc"),
        tie.alias("tie"), F.array(*(_cell(d, kinds[d]) for d in dims)).alias("cells"),
    )


class _Tree:
    """Split nodes, level by level. A node is named by the first shard of its range of shards."""

    def __init__(self, shards: int):
        self.shards = shards
        self.levels: list[dict[int, tuple[int, int, int, int]]] = []  # node -> (dimension, cell, tie cut, shards on the left)

    def open_nodes(self) -> dict[int, int]:
        nodes = {0: self.shards}
        for level in self.levels:
            for node, (*_, left) in level.items():
                nodes[node + left], nodes[node] = nodes[node] - left, left
        return {n: k for n, k in nodes.items() if k > 1}

    def place(self, rows: DataFrame) -> DataFrame:
        """The rows with their node: a fold over the levels, one array look-up each. No join, and no nested branches."""
        if not self.levels:
            return rows.withColumn("node", F.lit(0))
        names = ("dim", "cell", "cut", "left")
        split = lambda x: F.struct(*(F.lit(v).alias(k) for k, v in zip(names, x, strict=True)))
        levels = F.array(*(F.array(*(split(level.get(n, (0, GRID, 0, 0))) for n in range(self.shards))) for level in self.levels))

        def down(node: Column, level: Column) -> Column:
            at = F.get(level, node)
            cell = F.get("cells", at["dim"])
            right = (cell > at["cell"]) | ((cell == at["cell"]) & (_tie_cell() >= at["cut"]))
            return node + F.when(right, at["left"]).otherwise(0)

        return rows.withColumn("node", F.aggregate(levels, F.lit(0), down))


def _tie_cell() -> Column:
    return F.shiftrightunsigned("tie", 64 - 16).cast("int")


def _split(rows: DataFrame, tree: _Tree, spans: dict[int, float] | None) -> dict[int, float]:
    """Add one level to the tree; returns the spans of the dimensions at the root."""
    nodes = tree.open_nodes()
    here = tree.place(rows).where(F.col("node").isin(*nodes))
    wants = F.element_at(F.create_map(*(F.lit(x) for n, k in nodes.items() for x in (n, (k // 2) / k))), F.col("node"))
    by_cell = here.select("node", "size", F.posexplode("cells").alias("dim", "cell")).groupBy("node", "dim", "cell").agg(F.sum("size").alias("w"))
    up_to = Window.partitionBy("node", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("w").over(Window.partitionBy("node", "dim"))
    cells = by_cell.select("node", "dim", "cell", "w", F.sum("w").over(up_to).alias("upto"), total.alias("total"))
    middle = F.min(F.when(F.col("upto") >= wants * F.col("total"), F.struct("cell", (F.col("upto") - F.col("w")).alias("before"))))
    found = cells.groupBy("node", "dim").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.first("total").alias("total"), middle.alias("m")).collect()
    if spans is None:
        spans = {r["dim"]: max(r["hi"] - r["lo"], 1) for r in found}
    widest: dict[int, tuple] = {}
    for r in sorted(found, key=lambda r: (r["node"], r["dim"])):
        width = (r["hi"] - r["lo"]) / spans[r["dim"]]
        if r["node"] not in widest or width > widest[r["node"]][0]:
            widest[r["node"]] = (width, r["dim"], r["m"]["cell"], r["m"]["before"], r["total"])
    # Inside the median cell, the cut is the hash cell whose running weight comes nearest the wanted half.
    level = {n: (d, c, 0, nodes[n] // 2) for n, (_, d, c, _, _) in widest.items()}
    look = lambda i: F.element_at(F.create_map(*(F.lit(x) for n, v in level.items() for x in (n, v[i]))), F.col("node"))
    rest = F.element_at(F.create_map(*(F.lit(x) for n, (*_, before, total) in widest.items() for x in (n, total * ((nodes[n] // 2) / nodes[n]) - before))), F.col("node"))
    ties = here.where(F.get("cells", look(0)) == look(1)).groupBy("node", _tie_cell().alias("t")).agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = ties.select("node", "t", (upto - rest).alias("over"), "w")
    after = F.min_by(F.col("t") + 1, F.abs("over"))
    start = F.min(F.struct("t", F.abs(F.col("over") - F.col("w")).alias("miss")))  # the cut before the first hash cell
    for r in near.groupBy("node").agg(after.alias("cut"), F.min(F.abs("over")).alias("miss"), start.alias("start")).collect():
        d, c, _, left = level[r["node"]]
        level[r["node"]] = (d, c, 0 if r["start"]["miss"] < r["miss"] else r["cut"], left)
    tree.levels.append(level)
    return spans


def kd_shards(
    docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text",
    dims: tuple[str, ...] = ("n_chars", "source", "lang"),
) -> DataFrame:
    """Per document: key, size, text_crc32, shard, slot (gapless inside its shard, in hash order).

    Give ``target_bytes`` (leaves are split until they hold about that much) or the number of ``shards`` (the target is then
    their share of all bytes). The driver keeps one short row per node and dimension.
    """
    rows = stored(_narrow(docs, key, text, dims), "shard-rows")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    tree, spans = _Tree(shards), None
    if not rows.isEmpty():
        while tree.open_nodes():
            had = len(tree.levels)
            spans = _split(rows, tree, spans)
            if not tree.levels[had]:  # no row is left in any open node
                break
    placed = tree.place(rows).select("key", "size", "crc", "tie", F.col("node").cast("int").alias("shard"), F.shiftrightunsigned("tie", 64 - 12).alias("range"))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("tie", "key", "size"))
    numbered = placed.withColumn("nth", inside - 1).join(starts, ["shard", "range"])
    return numbered.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
