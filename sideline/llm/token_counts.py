"""Token counts of flat unindexed token files by a separator scan (operator 9).

A flat file is a run of fixed-width ids in which every document ends with the end-of-document id; no index says where. Each
file is cut into blocks, the separators of a block are found by one vectorised comparison, and a block reports the tokens
before its first separator, between separators, and after its last. A prefix scan over the blocks of a file carries the open
run across block borders and numbers the documents. A run that a file ends with, without a separator, is a document too.

Files are read by Spark's binary source, so any store will do; a file is one row, at most 2 GB. The writer ends a file at
``FILE_BYTES``, or after a document that is longer by itself, which bounds what a task holds. Blocks of one file are scanned together and stitched by window functions over block rows, of
which a file has few. Null and empty texts are documents of no tokens; repeated rows count each; no files give no rows.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm import bpe
from sideline.session import shared_dir

EOD = 0
WIDTH = np.dtype("<u2")
BLOCK_TOKENS = 1 << 19
FILE_BYTES = 1 << 23
FILES = T.StructType([T.StructField("value", T.BinaryType()), T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType())])

BLOCKS = T.StructType(
    [T.StructField("path", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("block", "head", "tail", "separators")]
    + [T.StructField("inner", T.ArrayType(T.LongType()))]
)


def word_ids(text: str | None) -> bytes:
    """Ids of a text's words, for counts of words: a hash into 1 to 65535, which leaves EOD free."""
    words = (text or "").encode().split()
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % 65535 + 1).astype(WIDTH).tobytes()


def encoder(spark: SparkSession, vocabulary: str | None):
    """A function from texts to the bytes of their ids, and the id that ends a document.

    Ids are byte pairs of the rank file ``vocabulary``, with the first id past its ranks as end of document; without a file,
    hashes of words.
    """
    if vocabulary is None:
        return lambda texts: list(map(word_ids, texts)), EOD
    eod = len(bpe.load(vocabulary).tokens)
    if eod > np.iinfo(WIDTH).max:
        raise ValueError(f"{vocabulary} leaves no two-byte id free for the end of a document")
    shared = spark.sparkContext.broadcast(bpe.load(vocabulary))
    return lambda texts: [ids.astype(WIDTH).tobytes() for ids in shared.value.encode(texts)], eod


def _packed(encode, eod: int, size: int):
    """Rows of (key, text) to rows of FILES: the ids of a run of documents, and the keys of the same run."""
    end = np.array([eod], WIDTH).tobytes()

    def run(batches):
        part, file, held = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list[pa.Array] = []

        def packed():
            sink = io.BytesIO()
            column = pa.chunked_array(keys)
            with pa.ipc.new_stream(sink, pa.schema([("key", column.type)])) as out:
                out.write_table(pa.table({"key": column}))
            # The writer ends either value by the end-of-document id; that of the last document is left to it.
            return pa.RecordBatch.from_arrays([pa.array([end.join(ids), sink.getvalue()], pa.binary()), pa.array(["ids", "keys"]), pa.array([part] * 2, pa.int32()), pa.array([file] * 2, pa.int32())], names=FILES.names)

        for batch in batches:
            first = 0
            for i, one in enumerate(encode(batch.column(1).to_pylist())):
                ids.append(one)
                held += len(one) + len(end)
                if held >= size:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    yield packed()
                    ids, keys, held, first, file = [], [], 0, i + 1, file + 1
            if first < batch.num_rows:
                keys.append(batch.column(0).slice(first))
        if ids:
            yield packed()

    return run


def write_flat(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> int:
    """Flat token files under ``kind=ids``: every document's ids, each followed by the returned end-of-document id.

    One write puts a file and the keys of its documents, in the same order under ``kind=keys``, both named by part and file: a
    task that runs again writes both again, and no later plan has to number the documents alike. Spark's text writer puts raw
    bytes and a line separator, which here is the end-of-document id, a character a byte.
    """
    encode, eod = encoder(docs.sparkSession, vocabulary)
    files = docs.select(key, F.coalesce(text, F.lit(""))).mapInArrow(_packed(encode, eod, FILE_BYTES), FILES)
    end = np.array([eod], WIDTH).tobytes().decode("latin-1")
    files = files.withColumn("value", F.col("value").cast("string"))
    files.write.partitionBy("kind", "part", "file").options(encoding="ISO-8859-1", lineSep=end).text(path)
    return eod


def _unpacked(batches):
    for batch in batches:
        for part, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            keys = pa.ipc.open_stream(content.as_buffer().slice(0, len(content.as_buffer()) - WIDTH.itemsize)).read_all().column(0)
            n = len(keys)
            at = (pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(range(n), pa.int64()))
            yield pa.RecordBatch.from_arrays([*at, keys.combine_chunks()], names=["part", "file", "ordinal", "key"])


def _scanner(eod: int, size: int):
    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer(), WIDTH)
                rows = []
                for block, at in enumerate(range(0, len(tokens), size)):
                    part = tokens[at : at + size]
                    ends = np.flatnonzero(part == eod)
                    if len(ends):
                        rows.append((path, block, int(ends[0]), int(len(part) - 1 - ends[-1]), len(ends), np.diff(ends) - 1))
                    else:
                        rows.append((path, block, None, len(part), 0, np.zeros(0, np.int64)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())), strict=True)], names=BLOCKS.names)

    return scan


def scan_files(spark: SparkSession, path: str, eod: int = EOD) -> DataFrame:
    """Per document of the flat files under ``path``: path, ordinal (from 0, in file order) and n_tokens."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    blocks = files.mapInArrow(_scanner(eod, BLOCK_TOKENS), BLOCKS)
    in_file = Window.partitionBy("path").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ordinal", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    # Runs are named by the number of blocks with a separator before them; the open tokens of a run add up.
    blocks = blocks.withColumn("run", F.coalesce(F.sum((F.col("separators") > 0).cast("int")).over(before), F.lit(0)))
    blocks = blocks.withColumn("opens", F.when(F.col("separators") > 0, F.col("run") + 1).otherwise(F.col("run")))
    opened = F.sum("tail").over(Window.partitionBy("path", "opens").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("open", opened)
    blocks = blocks.withColumn("carry", F.coalesce(F.lag("open").over(in_file), F.lit(0)))
    first = F.when(F.col("separators") > 0, F.array(F.col("carry") + F.col("head"))).otherwise(F.array().cast("array<long>"))
    blocks = blocks.withColumn("is_last", F.lead("block").over(in_file).isNull())
    rest = F.when(F.col("is_last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    counted = blocks.select("path", "ordinal", F.posexplode(F.concat(first, "inner", rest)).alias("nth", "n_tokens"))
    return counted.select("path", (F.col("ordinal") + F.col("nth")).alias("ordinal"), "n_tokens")


def _located(df: DataFrame) -> DataFrame:
    """Part and file, by the names of the folders that hold a file."""
    return df.withColumns({c: F.regexp_extract("path", rf"/{c}=(\d+)/", 1).cast("int") for c in ("part", "file")})


def read_counts(spark: SparkSession, path: str, key: T.StructField, eod: int = EOD) -> DataFrame:
    """Per document of what ``write_flat`` wrote: key and n_tokens. Fails if a file has more or fewer documents than keys."""
    counts = _located(scan_files(spark, f"{path}/kind=ids", eod))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind=keys").select("path", "content")
    fields = [T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("key", key.dataType)]
    keys = _located(files).select("part", "file", "content").mapInArrow(_unpacked, T.StructType(fields)).withColumn("has_key", F.lit(True))
    both = keys.join(counts, ["part", "file", "ordinal"], "full")
    broken = F.raise_error(F.format_string("part %d, file %d: as many documents as keys expected, not so at %d", "part", "file", "ordinal")).cast("long")
    # The checked column is part of the result: no later selection of rows by key can leave the check out.
    return both.select(F.col("key").alias(key.name), F.when(F.col("has_key") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(broken).alias("n_tokens"))


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per document: key and n_tokens, by way of flat files in the shared folder; words are counted without a vocabulary.

    A flat file has no ids. A document is known by its file and its place there, which the keys stored with the file give.
    ``docs`` is evaluated once and may be any plan.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    eod = write_flat(docs, path, key, text, vocabulary)
    field = docs.select(key).schema[0]
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").head(1):
        return spark.createDataFrame([], T.StructType([field, T.StructField("n_tokens", T.LongType())]))
    return read_counts(spark, path, field, eod)
