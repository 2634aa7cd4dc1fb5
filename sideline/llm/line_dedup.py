"""Line dedup by levelled sorted runs (operator 11).

The index of lines is a set of *runs*: tables of ``(h, docs, lines, largest)``, one row a line hash, bucketed and sorted by ``h``.
A batch of documents is folded to one row a hash and added as a run of level 0. *Heads*, the hashes that no older run holds,
are found by merge-anti-joins of the new run with the others, bucket by bucket without a shuffle; they say which document
of the batch keeps the line, since earlier batches hold larger keys. Once ``fanout`` runs stand on a level they are merged
into one of the next (compaction), so a batch meets a number of runs that grows with the logarithm of the batches.

``LineIndex`` can be fed for as long as documents arrive. ``dedup_lines`` feeds it a whole table in descending batches of the
key and then drops lines: a line whose key has ``min_chars`` code points and occurs in ``min_docs`` documents stays in its
head only. Lines meet the verdicts on the hash; hashes that make up more than a ``HOT``-th of all lines (fewer than ``HOT`` of
them, whatever the table) are broadcast, so no line, however common, is sent to one task.

Null texts are empty and have one empty line. A row is a document; rows that repeat a key and its text get the same result,
and each counts as a document. A null key is the smallest. Columns other than the key and the text are ignored. Hashes are the
first 16 bytes of a SHA-256 digest. Work tables are deleted as soon as they have been used, but for those that the result reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.llm.common import drop_stored, stored, whole
from sideline.session import shared_dir

SEPARATORS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINES_PER_BUCKET = 4_000_000
HOT = 1000
LOWEST = -(2**63)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case: the plain function where it can touch nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Sorted array of (h, i) of the long lines of a text: hash and line number."""
    keys = F.transform(F.split(lower_ascii(text), "\n", -1), lambda line, i: F.struct(F.btrim(line, F.lit(SEPARATORS)).alias("k"), i.alias("i")))
    long = F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)
    return F.sort_array(F.transform(long, lambda x: F.struct(F.unhex(F.substring(F.sha2(x["k"], 256), 1, 32)).alias("h"), x["i"].alias("i"))))


def _marked(sorted_hashes: str) -> Column:
    """The array (a column, so that it is computed once) with ``first``: whether it is the hash's first line in the text."""
    before = lambda i: F.get(F.col(sorted_hashes), i - 1)["h"]
    return F.transform(F.col(sorted_hashes), lambda x, i: F.struct(x["h"].alias("h"), x["i"].alias("i"), (~x["h"].eqNullSafe(before(i))).alias("first")))


class LineIndex:
    """Runs of line hashes by level. Batches come in descending order of their documents' keys."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 3):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.heads: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        """A run: one sorted file a bucket, registered so that joins know how it lies."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_stored(self.spark, f"{shared_dir(self.spark)}/{name}")

    def add(self, lines: DataFrame) -> None:
        """Fold a batch's lines (h, first, key) to a run, anti-join it with the runs before, compact what is full."""
        folded = lines.groupBy("h").agg(F.count_if("first").alias("docs"), F.count("*").alias("lines"), F.max("key").alias("largest"))
        run = self._write(folded.repartition(self.buckets, "h"))
        fresh = self.spark.table(run)
        for other in (name for level in self.levels for name in level):
            fresh = fresh.join(self.spark.table(other).select("h").hint("merge"), "h", "left_anti")
        self.heads.append(self._write(fresh.select("h", "largest")))
        level, rising = 0, run
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(rising)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            rising = self._write(self._merged(full).repartition(self.buckets, "h"))
            for name in full:
                self._drop(name)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        every = self.spark.table(names[0])
        for name in names[1:]:
            every = every.unionByName(self.spark.table(name))
        return every.groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("lines").alias("lines"), F.max("largest").alias("largest"))

    def repeated(self, min_docs: int) -> DataFrame:
        """Hashes of at least ``min_docs`` documents: h, lines, keeper (the key that keeps the line, from its head)."""
        names = [name for level in self.levels for name in level]
        common = self._merged(names).where(F.col("docs") >= min_docs).select("h", "lines")
        heads = self.spark.table(self.heads[0])
        for name in self.heads[1:]:
            heads = heads.unionByName(self.spark.table(name))
        return common.join(heads.withColumnRenamed("largest", "keeper"), "h")

    def clear(self) -> None:
        for name in [name for level in self.levels for name in level] + self.heads:
            self._drop(name)
        self.levels, self.heads = [], []


def _descending(key: str, cuts: list[int]) -> Column:
    """Number of cuts at or above a key: batch 0 has the largest keys."""
    n = F.lit(0)
    for cut in cuts:
        n = n + (F.col(key) <= F.lit(cut)).cast("int")
    return n


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Line numbers to drop: key, tie (a hash of the text), drop (numbers). Only documents that lose a line are there. Takes (key, text)."""
    spark = docs.sparkSession
    cuts = docs.where(f"key > {LOWEST}").agg(F.percentile_approx("key", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    hashed = docs.select("key", F.xxhash64("text").alias("tie"), _descending("key", sorted(set(cuts))).alias("batch"), line_hashes(F.col("text"), min_chars).alias("s"))
    staged = stored(hashed.select("key", "tie", "batch", _marked("s").alias("s")), "line-hashes", by="batch")
    lines = staged.select("key", "tie", "batch", F.inline("s"))
    sizes = {r["batch"]: r["n"] for r in staged.groupBy("batch").agg(F.sum(F.size("s")).alias("n")).collect() if r["n"]}
    total = sum(sizes.values())
    index = LineIndex(spark, max(8, -(-total // LINES_PER_BUCKET)), fanout)
    for batch in sorted(sizes):
        index.add(lines.where(F.col("batch") == batch))
    schema = "key long, tie long, drop array<int>"
    if not total:
        return spark.createDataFrame([], schema)
    common = stored(index.repeated(min_docs), "line-verdicts")
    index.clear()
    hot = common.where(F.col("lines") * HOT >= total).select("h", "keeper", F.lit(True).alias("hot"))
    known = lines.join(F.broadcast(hot), "h", "left")  # fewer than HOT rows of it
    rest = known.where("hot IS NULL").select("h", "key", "tie", "i").join(common.where(F.col("lines") * HOT < total).select("h", "keeper"), "h")
    found = known.where("hot").select("h", "key", "tie", "i", "keeper").unionByName(rest).where("key < keeper")
    out = stored(found.groupBy("key", "tie").agg(F.collect_set("i").alias("drop")), "line-drops")
    drop_stored(spark, staged, common)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 3) -> DataFrame:
    """Per document: key, ``n_lines`` before dropping, ``n_dropped``, ``kept`` (the text without the lines it loses)."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("key"), whole(text).alias("text"))
    drops = dropped_lines(rows, min_chars, min_docs, batches, fanout)
    both = rows.withColumn("tie", F.xxhash64("text")).join(drops, ["key", "tie"], "left")
    lines = F.split("text", "\n", -1)
    cut = both.select("key", "text", "drop", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drop").isNotNull(), lines).alias("lines"))
    # array_except looks numbers up by hash, so a text of very many lines stays linear.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return cut.select(F.when(F.col("key") != LOWEST, F.col("key")).alias(key), "n_lines", "n_dropped", kept.alias("kept"))
