"""Boosted regression trees by binned histograms, for all folds at once.

The inputs are cut into at most ``BINS`` bins per feature at quantiles of the fold's own training rows and kept as blocks
of bytes; features of few bins share a byte, since every level hands all blocks to Python and bytes are what that costs.
A level of a tree is one job for all folds: each block sends its rows down the tree built so far and adds up gradients and
counts per (node, feature, bin) for the smaller child of every split; the other child is the parent's sums less those. Only the sums, merged between tasks, reach the driver, which picks the splits. Their size depends on
the settings, not on the rows. There are as many tasks as the cluster has use for, each with at most ``PART_ROWS`` rows, which
pass through it block by block. The blocks of the next tree carry what their forecasts leave of the target; every ``CUT_EVERY`` trees
they are written to the checkpoint folder, so a lost executor never replays more than that.

RDDs hold the blocks here: the state of a block is a few arrays, and planning a DataFrame query for each of the 1,750 levels
would cost several times the level itself.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.session import ensure_checkpointing

BINS = 64
LAMBDA = 1.0  # fixed value: pull of a leaf towards zero
CELLS = 256  # bins of all features that share a byte
BLOCK_ROWS = 100_000
TASK_ROWS = 20_000  # fewer rows are not worth a task of their own
PART_ROWS = 4_000_000
CUT_EVERY = 25
FLAT_UP_TO = 64  # partitions whose sums are merged in one step
BLOCK = "fold int, bins binary, y binary, ids binary"


@dataclass(frozen=True)
class Trees:
    """Trees of one fold in heap order (children of node i at 2i + 1 and 2i + 2); feature -1 marks a leaf; values include the rate."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    rows: int = 0  # it was fitted on

    def score(self, x: np.ndarray) -> np.ndarray:
        """Forecasts for rows of raw feature values."""
        bins = _bins(self.edges, [x[:, j] for j in range(len(self.edges))])
        out = np.full(len(x), self.base)
        for t in range(len(self.feature)):
            out += self.value[t][_descend(bins, self.feature[t], self.cut[t])]
        return out


def _bins(edges: Sequence[np.ndarray], columns: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers, a row of the result for each feature."""
    kind = np.min_scalar_type(max(len(e) for e in edges))
    return np.stack([np.searchsorted(e, v, "left").astype(kind) for e, v in zip(edges, columns, strict=True)])


def _descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node in which each row ends: one comparison of a feature's bins for every split, parents first."""
    kind = np.min_scalar_type(len(feature)).type
    node = np.zeros(len(bins[0]), kind)
    for at in np.flatnonzero(feature >= 0).tolist():
        move = (bins[feature[at]] > cut[at]).view(np.uint8).astype(kind, copy=False)
        move += kind(at + 1)
        move *= node == at
        node += move
    return node


@dataclass(frozen=True)
class _Layout:
    """The features that share each byte, lowest digit first, and every feature's number of bins."""

    groups: list[list[int]]
    bins: list[int]

    @classmethod
    def of(cls, bins: Sequence[int]) -> _Layout:
        groups: list[list[int]] = []
        size: list[int] = []
        for j in sorted(range(len(bins)), key=lambda j: (-bins[j], j)):
            at = next((g for g in range(len(groups)) if size[g] * bins[j] <= CELLS), None)
            if at is None:
                groups.append([])
                size.append(1)
                at = len(groups) - 1
            groups[at].append(j)
            size[at] *= bins[j]
        return cls(groups, list(bins))

    def packed(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), bins.shape[1]), np.uint8)
        for code, group in zip(out, self.groups, strict=True):
            for j in reversed(group):
                code *= np.uint8(self.bins[j] % 256)  # 256 bins: the byte is zero so far
                code += bins[j].astype(np.uint8)
        return out

    def cells(self, g: int) -> int:
        return math.prod(self.bins[j] for j in self.groups[g])


class _Columns:
    """The bins of single features, taken out of their bytes when asked for."""

    def __init__(self, codes: np.ndarray, layout: _Layout):
        self.codes, self.layout = codes, layout
        self.place = {j: (g, math.prod(layout.bins[i] for i in group[:d]), d == len(group) - 1) for g, group in enumerate(layout.groups) for d, j in enumerate(group)}
        self.found: dict[int, np.ndarray] = {}

    def __getitem__(self, j: int) -> np.ndarray:
        if j not in self.found:
            g, below, last = self.place[j]
            base = np.uint8(self.layout.bins[j] % 256)  # 256 bins have their byte for themselves
            digit = self.codes[g] // np.uint8(below) if 1 < below < 256 else self.codes[g]
            if base == 1:
                digit = np.zeros_like(digit)
            elif base and not last:
                digit = digit - digit // base * base
            self.found[j] = digit
        return self.found[j]


@dataclass
class _Block:
    """Rows of one fold: bins (a row a byte), target, a hash of each row's values, and a forecast still to be taken off the target."""

    fold: int
    bins: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    f: np.ndarray | float = 0.0
    layout: _Layout | None = None  # null: a byte a feature

    def sample(self, tree: int, share: float, seed: int) -> np.ndarray:
        """Rows that a tree sees, by their hashes: the same however the rows are dealt to blocks."""
        limit = int(share * 2**32)
        if limit >= 2**32:
            return np.ones(len(self.ids), bool)
        h = self.ids.astype(np.uint32) + np.uint32((seed * 1_000_003 + tree + 1) * 0x9E3779B9 % 2**32)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        return h < np.uint32(limit)

    def ends(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The node of each row."""
        return _descend(self.bins if self.layout is None else _Columns(self.bins, self.layout), feature, cut)

    def grow(self, feature: np.ndarray, cut: np.ndarray, nodes: Sequence[int], columns: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
        """Gradients and counts (2, nodes, columns, bins) of the rows sampled for this tree that are in the given nodes."""
        layout = self.layout or _Layout([[j] for j in range(len(self.bins))], [BINS] * len(self.bins))
        slot, asked = np.zeros(len(feature), np.min_scalar_type(len(nodes))), np.zeros(len(feature), bool)
        slot[nodes], asked[nodes] = np.arange(len(nodes)), True
        node = self.ends(feature, cut)
        rows = np.flatnonzero(asked[node] & self.sample(tree, share, seed))
        at, gradient = slot[node[rows]], (self.f - self.y)[rows]
        out = np.zeros((2, len(nodes), len(columns), BINS))
        wanted = {int(c): i for i, c in enumerate(columns)}

        def put(g, sums):
            shape = [layout.bins[j] for j in reversed(layout.groups[g])]
            sums = sums.reshape(2, len(nodes), *shape)
            for d, j in enumerate(reversed(layout.groups[g])):
                if j in wanted:
                    out[:, :, wanted[j], : layout.bins[j]] = sums.sum(axis=tuple(2 + e for e in range(len(shape)) if e != d))

        left = [g for g, group in enumerate(layout.groups) if any(j in wanted for j in group)]
        while left:
            size, other = layout.cells(left[0]), layout.cells(left[1]) if len(left) > 1 else 0
            # Two bytes in one pass, where their common cells are few beside the rows.
            both = bool(other) and 4 * len(nodes) * size * other <= len(rows)
            cells = len(nodes) * size * (other if both else 1)
            kind = np.min_scalar_type(cells).type
            code = self.bins[left[0]]
            if both:
                code = code.astype(kind) * kind(other) + self.bins[left[1]]
            found = code.take(rows).astype(kind)
            if len(nodes) > 1:
                found += at.astype(kind) * kind(cells // len(nodes))
            found = found.astype(np.intp)
            sums = np.stack([np.bincount(found, gradient, cells), np.bincount(found, minlength=cells)])
            if both:
                sums = sums.reshape(2, len(nodes), size, other)
                put(left[1], sums.sum(axis=2))
                sums = sums.sum(axis=3)
            put(left[0], sums)
            left = left[2 if both else 1 :]
        return out


def _facts(rows: DataFrame, names: Sequence[str], least: int) -> dict[int, tuple[list[np.ndarray], float, int]]:
    """Of each fold with enough rows: bin edges (distinct quantiles of its rows), mean target and rows, by one aggregate that combines before its shuffle."""
    at = [i / BINS for i in range(1, BINS)]
    found = rows.groupBy("fold").agg(F.avg("y").alias("_base"), F.count("*").alias("_n"), *[F.percentile_approx(n, at, 2000).alias(n) for n in names]).collect()
    return {r["fold"]: ([np.unique(np.array(r[n], float)) for n in names], r["_base"], r["_n"]) for r in found if r["_n"] >= least}


def _hashes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A hash of each row's values. In Spark it would need every input's expression twice, more than the JVM compiles."""
    h = np.zeros(len(columns[0]), np.uint64)
    for v in columns:
        h ^= (v + 0.0).view(np.uint64)  # one zero
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def _blocks(edges: Mapping[int, list[np.ndarray]], layouts: Mapping[int, _Layout]):
    def run(batches):
        for batch in batches:
            fold, y = (np.asarray(batch.column(i)) for i in range(2))
            x = [np.asarray(c) for c in batch.columns[2:]]
            ids = _hashes([y, *x])
            out = []
            for f in np.unique(fold).tolist():
                rows = fold == f
                codes = layouts[f].packed(_bins(edges[f], [v[rows] for v in x]))
                out.append((f, codes.tobytes(), y[rows].tobytes(), ids[rows].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["fold", "bins", "y", "ids"])

    return run


def _loaded(layouts: Mapping[int, _Layout], base: Mapping[int, float]):
    def block(fold, parts):
        bins, y, ids = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        return _Block(fold, bins, y - base[fold], ids, layout=layouts[fold])

    def run(rows):
        held = {}
        for r in rows:
            y, ids = np.frombuffer(bytes(r["y"]), np.float64), np.frombuffer(bytes(r["ids"]), np.uint32)
            parts = held.setdefault(r["fold"], [])
            parts.append((np.frombuffer(bytes(r["bins"]), np.uint8).reshape(-1, len(y)), y, ids))
            if sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                yield block(r["fold"], held.pop(r["fold"]))
        for fold, parts in held.items():
            yield block(fold, parts)

    return run


def _add(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}


def _level(seen: np.ndarray, asked: Sequence[int], before: np.ndarray | None, first: int) -> np.ndarray:
    """Sums (2, nodes, columns, bins) of a whole level from those of the nodes asked for and those of the level before."""
    if before is None:
        return seen
    sums = np.zeros((2, first + 1, *seen.shape[2:]))
    for i, node in enumerate(asked):
        parent, other = (node - 1) // 2, node + 1 if node % 2 else node - 1
        sums[:, node - first] = seen[:, i]
        sums[:, other - first] = before[:, parent - first // 2] - seen[:, i]
    sums[0][sums[1] == 0] = 0  # no rows, so no gradient: what is left there is rounding
    return sums


def _splits(sums: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, first: int, columns: np.ndarray, rate: float) -> list[int]:
    """Choose the best split of every node of a level and set its children's values; a node without gain stays a leaf.

    Returns the smaller child of each split.
    """
    g, h = np.cumsum(sums, axis=-1)
    total_g, total_h = g[..., -1:], h[..., -1:]
    right_g, right_h = total_g - g, total_h - h
    gain = g**2 / (h + LAMBDA) + right_g**2 / (right_h + LAMBDA) - total_g**2 / (total_h + LAMBDA)
    gain = np.where((h >= 1) & (right_h >= 1), gain, -np.inf)
    smaller = []
    for n, of_node in enumerate(gain):
        best = int(np.argmax(of_node))
        j, b = divmod(best, BINS)
        if not of_node[j, b] > 1e-6:
            continue
        node = first + n
        feature[node], cut[node] = columns[j], b
        for child, cg, ch in ((2 * node + 1, g[n, j, b], h[n, j, b]), (2 * node + 2, right_g[n, j, b], right_h[n, j, b])):
            value[child] = -rate * cg / (ch + LAMBDA)
        smaller.append(2 * node + 1 if h[n, j, b] <= right_h[n, j, b] else 2 * node + 2)
    return smaller


def task_count(rows: int, slots: int) -> int:
    """Partitions for so many rows: one for each slot of the cluster, fewer where few are enough, more where ``PART_ROWS`` is not."""
    return max(1, min(-(-rows // TASK_ROWS), slots * -(-rows // (slots * PART_ROWS))))


def fit_boosted(rows: DataFrame, names: Sequence[str], settings: Mapping[str, object], least: int = 1) -> dict[int, Trees]:
    """Trees by fold from training rows (fold, y, features: doubles without nulls); a row is there once for each fold it trains.

    The rows are read twice, for the bins' edges and for the blocks. A fold with fewer than ``least`` rows has no trees.
    """
    spark = rows.sparkSession
    ensure_checkpointing(spark)
    count, depth, rate = int(settings["maxIter"]), int(settings["maxDepth"]), float(settings["stepSize"])
    share, seed = float(settings["subsamplingRate"]), int(settings["seed"])
    k = len(names)
    chosen = max(1, int(round(float(settings["featureSubsetStrategy"]) * k)))
    facts = _facts(rows, names, least)
    if not facts:
        return {}
    edges, base, numbers = ({f: facts[f][i] for f in facts} for i in range(3))
    layouts = {f: _Layout.of([len(e) + 1 for e in edges[f]]) for f in facts}
    parts = task_count(sum(numbers.values()), spark.sparkContext.defaultParallelism)
    rows = rows.where(F.col("fold").isin(list(facts))).select("fold", "y", *names)
    # Rows become bytes before they are dealt out.
    blocks = rows.mapInArrow(_blocks(edges, layouts), BLOCK).repartition(parts).rdd.mapPartitions(_loaded(layouts, base))
    blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    blocks.checkpoint()
    size = 2 ** (depth + 1) - 1
    out: dict[int, list] = {f: [] for f in edges}
    before = blocks
    for tree in range(count):
        columns = np.sort(np.random.default_rng([seed, tree]).choice(k, chosen, replace=False))
        grown = {f: (np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for f in edges}
        asked, whole = {f: [0] for f in edges}, {}
        for level in range(depth):
            asked = {f: nodes for f, nodes in asked.items() if nodes}
            if not asked:
                break
            first = 2**level - 1
            seen = {f: (grown[f][0].copy(), grown[f][1].copy(), nodes) for f, nodes in asked.items()}

            def sums(part, seen=seen, columns=columns, tree=tree):
                added = {}
                for b in part:
                    if b.fold in seen:
                        added = _add(added, {b.fold: b.grow(*seen[b.fold], columns, tree, share, seed)})
                yield added

            merged = blocks.mapPartitions(sums).treeReduce(_add, 1 if parts <= FLAT_UP_TO else 2)
            if level == 0 and tree:
                before.unpersist()
            whole = {f: _level(total, asked[f], whole.get(f), first) for f, total in merged.items()}
            asked = {f: _splits(total, *grown[f], first, columns, rate) for f, total in whole.items()}
        for f, t in grown.items():
            out[f].append(t)

        def step(b, grown=grown):
            feature, cut, value = grown[b.fold]
            return _Block(b.fold, b.bins, b.y - value[b.ends(feature, cut)], b.ids, layout=b.layout)

        # The next tree's first level computes and persists these, and writes them where lineage is cut.
        before, blocks = blocks, blocks.map(step).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        if tree % CUT_EVERY == CUT_EVERY - 1:
            blocks.checkpoint()
    blocks.unpersist()
    before.unpersist()
    stack = lambda f, i: np.stack([t[i] for t in out[f]])
    return {f: Trees(edges[f], base[f], stack(f, 0), stack(f, 1), stack(f, 2), numbers[f]) for f in edges}


def nodes_table(spark: SparkSession, trees: Trees, names: Sequence[str]) -> DataFrame:
    """Nodes that are splits or have a value, one row each, with the threshold in the feature's own unit; plus the base as tree -1."""
    rows = [(-1, 0, None, None, float(trees.base))]
    for t in range(len(trees.feature)):
        for n in range(trees.feature.shape[1]):
            f = int(trees.feature[t, n])
            if f >= 0 or trees.value[t, n]:
                rows.append((t, n, names[f] if f >= 0 else None, float(trees.edges[f][trees.cut[t, n]]) if f >= 0 else None, float(trees.value[t, n])))
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, value double")


def trees_of(table: DataFrame, names: Sequence[str]) -> Trees:
    """The model of a stored table of nodes; its edges are the thresholds in use."""
    rows = table.collect()
    cuts: dict[str, set[float]] = {n: set() for n in names}
    for r in rows:
        if r["feature"] is not None:
            cuts[r["feature"]].add(r["threshold"])
    edges = [np.array(sorted(cuts[n])) for n in names]
    count = max(r["tree"] for r in rows) + 1
    size = 2 ** (max(r["node"] for r in rows) + 1).bit_length() - 1
    feature, cut, value = np.full((count, size), -1), np.zeros((count, size), np.int64), np.zeros((count, size))
    base = 0.0
    at = {n: i for i, n in enumerate(names)}
    for r in rows:
        if r["tree"] < 0:
            base = r["value"]
            continue
        value[r["tree"], r["node"]] = r["value"]
        if r["feature"] is not None:
            j = at[r["feature"]]
            feature[r["tree"], r["node"]], cut[r["tree"], r["node"]] = j, int(np.searchsorted(edges[j], r["threshold"]))
    return Trees(edges, base, feature, cut, value)
