"""Quality rules: base counts and divergence from language references (operator 7).

A document's histograms of character classes and of common words are held against its language's, by Jensen-Shannon
distance (base 2, so 0 to 1). The references are sums over all documents of the language. Common words are those with at
least ``SHARE`` of the language's words: each task reports its own words above a lower share, a bound on the unreported rest
drops all but a few hundred candidates per language, and exact counts over all documents decide. No word table of the
corpus is shuffled; a language with a third of all rows is summed in its tasks first.

Null texts count as empty. The language is the lower-case first part of ``lang`` if it is two or three letters, else "" (null
too), so there are at most 18,253. Documents below the minimum lengths, and languages with too few words for a reference,
are judged by the base rule alone. Repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm.common import stored

SHARE = 0.004  # of a language's words, for a common word
LOCAL_SHARE = SHARE / 4  # of a chunk's words, to be reported
CHUNK_WORDS = 2_000_000
MIN_WORDS, MIN_CHARS = 50, 150  # below these a histogram says too little
MIN_REFERENCE_WORDS = 10_000
# Largest squared distance of a kept document: a level, and a part for the sampling noise of short texts.
WORD_LIMIT, WORD_NOISE = 0.055, 4.0
CHAR_LIMIT, CHAR_NOISE = 0.07, 12.0
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
# Character classes by byte: lower case, upper case, digits, white space, sentence marks, other ASCII, bytes of other letters.
CLASSES = 7


def _classes() -> np.ndarray:
    table = np.full(256, 5, np.int64)
    table[128:] = 6
    for cls, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, ".,;:'\"()-!?")):
        table[list(chars.encode())] = cls
    return table


def language(lang: str) -> Column:
    first = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), "^([A-Za-z]{2,3})(?:[^A-Za-z]|$)", 1))
    return F.coalesce(first, F.lit(""))


COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])


def _local_counts(batches):
    """Words above the local share in each chunk of a task, with the chunk's words (as word null) for the bound."""

    def report(counts, totals):
        rows = []
        for lang, counter in counts.items():
            total = totals[lang]
            rows.append((lang, None, 0, total))
            rows += [(lang, w, n, total) for w, n in counter.items() if n >= LOCAL_SHARE * total]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=COUNTED.names)

    counts, totals = defaultdict(Counter), Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()
            counts[lang].update(words)
            totals[lang] += len(words)
            if totals.total() >= CHUNK_WORDS:
                yield report(counts, totals)
                counts, totals = defaultdict(Counter), Counter()
    yield report(counts, totals)


def common_words(texts: DataFrame) -> dict[str, list[bytes]]:
    """Candidates per language: every word with ``SHARE`` of its language's words is among them, and few others."""
    local = stored(texts.mapInArrow(_local_counts, COUNTED), "word-counts")
    totals = local.where("word IS NULL").groupBy("lang").agg(F.sum("total").alias("all"))
    words = local.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("covered"))
    words = words.join(totals, "lang").where(F.col("all") >= MIN_REFERENCE_WORDS)
    words = words.where(F.col("n") + LOCAL_SHARE * (F.col("all") - F.col("covered")) >= SHARE * F.col("all"))
    out: dict[str, list[bytes]] = {}
    for r in words.select("lang", "word").toLocalIterator():  # at most 1 / (SHARE - LOCAL_SHARE) a language
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return {lang: sorted(found) for lang, found in out.items()}


MEASURED = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("lang", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("classes", T.ArrayType(T.LongType())), T.StructField("common", T.ArrayType(T.LongType()))]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= twice
    return int(inside.sum())


def measure(text: str) -> tuple[list[bytes], tuple[int, ...]]:
    """The words of a text and its base counts."""
    words = text.encode().split()
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            duplicates += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return words, (len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words))


def _measurer(candidates):
    def run(batches):
        table = _classes()
        known = {lang: {w: i for i, w in enumerate(words)} for lang, words in candidates.value.items()}
        for batch in batches:
            counts, classes, common = [], [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                words, base = measure(text)
                counts.append(base)
                classes.append(np.bincount(table, weights=np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256), minlength=CLASSES).astype(np.int64).tolist())
                own = known.get(lang, {})
                found = Counter(w for w in words if w in own)
                common.append([found.get(w, 0) for w in own])
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [[]] * 5))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(classes, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64()))], names=MEASURED.names)

    return run


def js_distance(ours: Column, theirs: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    pairs = F.zip_with(ours, theirs, lambda a, b: F.struct((a / total(ours)).alias("p"), (b / total(theirs)).alias("q")))
    divergence = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + part(x["p"], x["q"]) + part(x["q"], x["p"])) / 2
    return F.when((total(ours) > 0) & (total(theirs) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _sums(rows: DataFrame, column: str) -> DataFrame:
    """Element-wise sum of an array column by language, combined before the shuffle."""
    each = rows.select("lang", F.posexplode(column).alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    return each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(f"{column}_all"))


def quality_rules(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per document: key, base counts, base_failed, js_words, js_chars (null where not judged), kept."""
    own = language(lang).alias("lang")
    candidates = docs.sparkSession.sparkContext.broadcast(common_words(docs.select(own, F.col(text).alias("text"))))
    rows = docs.select(F.col(key).cast("long").alias("key"), own, F.col(text).alias("text")).mapInArrow(_measurer(candidates), MEASURED)
    rows = stored(rows, "quality-counts")
    reference = rows.groupBy("lang").agg(F.sum("n_words").alias("words_all")).join(_sums(rows, "classes"), "lang").join(_sums(rows, "common"), "lang", "left")
    rows = rows.join(F.broadcast(reference), "lang", "left")  # one row a language, a few hundred numbers each
    # Words below the share that some task reported go to the rest, so results do not depend on the tasks.
    is_common = lambda i: F.get("common_all", i) >= SHARE * F.col("words_all")
    pick = lambda name: F.filter(name, lambda _, i: is_common(i))
    with_rest = lambda name, words: F.concat(pick(name), F.array(F.col(words) - F.aggregate(pick(name), F.lit(0).cast("long"), lambda a, x: a + x)))
    referred = F.col("words_all") >= MIN_REFERENCE_WORDS
    js_words = js_distance(with_rest("common", "n_words"), with_rest("common_all", "words_all"))
    rows = rows.withColumn("js_words", F.when(referred & (F.col("n_words") >= MIN_WORDS), js_words))
    js_chars = js_distance(F.col("classes"), F.col("classes_all"))
    rows = rows.withColumn("js_chars", F.when(referred & (F.col("word_chars") >= MIN_CHARS), js_chars))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    within = lambda d, level, noise, n: F.coalesce(F.col(d) * F.col(d) <= level + noise / F.col(n), F.lit(True))
    near = within("js_words", WORD_LIMIT, WORD_NOISE, "n_words") & within("js_chars", CHAR_LIMIT, CHAR_NOISE, "word_chars")
    rows = rows.withColumn("kept", ~F.col("base_failed") & near)
    return rows.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_words", "js_chars", "kept")
