"""Cross-tokenizer alignment by galloping intersection (operator 13).

Two tokenizers cut the same bytes; where tokens of both end, a group closes. All pairs of an A and a B token of one group are
links. The end offsets of both are ascending lists: those of the shorter one are looked up in the longer by exponential
search from a guessed place and binary search in the bracket found (all at once, ``gallop``). Common places are the groups'
last tokens; differences of their ranks say how many tokens of either side a group has.

A text is encoded in segments, cut before a space that follows a visible character: no token of either vocabulary spans such
a place (checked for B's pieces when loaded; A's pattern begins a match there), so both tokenizers end a token there and the
groups of a segment are those of the text. Segments recur, and a worker remembers a bounded number of them. If the joined
bytes of a segment differ from its own, its text is encoded and compared again as a whole; if they differ still, the text has
no tokens.

A pair's count is the number of documents that hold it linked. Counts come from one aggregate over the distinct pairs of each
document. Pairs that make up at least a ``HOT``-th of all these rows, so at most ``HOT`` of them at any size, go to the
workers as a sorted array; all others, none of which is more than a ``HOT``-th of the rows, meet their counts in a join.

Null and empty texts have no tokens and give zeros and an empty ``groups``. A row is a document; repeated rows count each.
Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sideline.llm.common import drop_stored, stored

HOT = 200_000
SEGMENTS = 100_000  # remembered in either generation of a worker's memory
LONG_SEGMENT = 200  # characters beyond which a segment is not remembered
CUT = re.compile(r"(?<=[!-~\w]) ")
ALIGNED = "key long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<int>"
COUNTED = "row long, n_best long, count_sum long, rest array<struct<pair: long, links: int>>"
MARK = "▁"


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (in ``short``, in ``long``) of the values both have. Ascending lists; ``guess`` is where to start in ``long``."""
    n = len(long)
    if not n or not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.clip(guess, 0, n - 1)
    up = long[at] < short
    lo, hi = np.where(up, at, -1), np.where(up, n, at)  # long[lo] < value <= long[hi]
    step, going = 1, np.arange(len(short))
    while len(going):
        probe = at[going] + np.where(up[going], step, -step)
        inside = (probe >= 0) & (probe < n)
        going, probe = going[inside], probe[inside]
        below = long[probe] < short[going]
        lo[going[below]], hi[going[~below]] = probe[below], probe[~below]
        going = going[below == up[going]]
        step *= 2
    wide = np.flatnonzero(hi - lo > 1)
    while len(wide):
        mid = (lo[wide] + hi[wide]) >> 1
        below = long[mid] < short[wide]
        lo[wide[below]], hi[wide[~below]] = mid[below], mid[~below]
        wide = wide[hi[wide] - lo[wide] > 1]
    hit = hi < n
    hit[hit] = long[hi[hit]] == short[hit]
    return np.flatnonzero(hit), hi[hit]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Side:
    """One tokenizer's ids over many texts: flat ids, ids per text, ends in bytes, and which texts it does not give back."""

    def __init__(self, ids: list[list[int]], table: list[bytes], sizes: np.ndarray, raws: list[bytes]):
        self.n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = list(chain.from_iterable(ids))
        self.ids = np.array(flat, np.int64)
        self.ends = np.cumsum(sizes[self.ids])
        self.first = np.cumsum(self.n) - self.n
        self.text = np.repeat(np.arange(len(ids)), self.n)
        # Texts whose bytes agree in length and in one comparison of all agree one by one.
        sums = np.bincount(self.text, sizes[self.ids], len(ids))
        if (sums == np.fromiter(map(len, raws), np.int64, len(raws))).all() and b"".join([table[i] for i in flat]) == b"".join(raws):
            self.good = [True] * len(ids)
        else:
            self.good = [b"".join([table[i] for i in each]) == raw for each, raw in zip(ids, raws, strict=True)]


class Pair:
    """Two tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = byte_level()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.size_b = len(pieces)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = (list(map(str, range(len(table)))) for table in (self.bytes_a, self.bytes_b))
        self.memo: list[dict[str, tuple]] = [{}, {}]

    def align(self, texts: list[str]) -> list[tuple | None]:
        """Per text: n_a, n_b, n_groups, n_links, the groups as text, and a pair (as bytes of 64-bit numbers) for every link; None if
        bytes differ."""
        raws = [b" " + t.encode() for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        a, b = _Side(ids_a, self.bytes_a, self.sizes_a, raws), _Side(ids_b, self.bytes_b, self.sizes_b, raws)
        good = [x and y for x, y in zip(a.good, b.good, strict=True)]
        if not all(good):
            kept = [t for t, g in zip(texts, good, strict=True) if g]
            found = iter(self.align(kept) if kept else [])
            return [next(found) if g else None for g in good]
        shorter = a.n <= b.n
        ranks = []
        for own, other, drives in ((a, b, shorter), (b, a, ~shorter)):
            at = np.flatnonzero(drives[own.text])
            text = own.text[at]
            guess = other.first[text] + (at - own.first[text]) * other.n[text] // own.n[text]
            i, j = gallop(own.ends[at], other.ends, guess)
            ranks.append((at[i], j) if own is a else (j, at[i]))
        last_a, last_b = (np.sort(np.concatenate([ranks[0][k], ranks[1][k]])) for k in (0, 1))
        wide_a, wide_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        links = wide_a * wide_b
        reach = np.cumsum(links)
        group = np.repeat(np.arange(len(links)), links)
        place = np.arange(len(group)) - (reach - links)[group]
        left = a.ids[(last_a - wide_a + 1)[group] + place // wide_b[group]]
        right = b.ids[(last_b - wide_b + 1)[group] + place % wide_b[group]]
        pairs = left * self.size_b + right
        texts_of = a.text[last_a]
        n_groups = np.bincount(texts_of, minlength=len(texts))
        of_a, of_b = self.names_a, self.names_b
        left, right = [of_a[i] for i in a.ids.tolist()], [of_b[i] for i in b.ids.tolist()]
        to_a, to_b = (last_a + 1).tolist(), (last_b + 1).tolist()
        names = [
            f"{left[i]}|{right[k]}" if i + 1 == j and k + 1 == m else f"{','.join(left[i:j])}|{','.join(right[k:m])}"
            for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)
        ]
        until = np.cumsum(n_groups)
        ends = np.concatenate([[0], reach])[until].tolist()
        data, out, at, lo = pairs.tobytes(), [], 0, 0
        for n_a, n_b, to, hi in zip(a.n.tolist(), b.n.tolist(), until.tolist(), ends, strict=True):
            out.append((n_a, n_b, to - at, hi - lo, ";".join(names[at:to]), data[8 * lo : 8 * hi]))
            at, lo = to, hi
        return out

    def segments(self, cut: list[list[str]]) -> dict[str, tuple | None]:
        """Alignment of every segment of some texts, from memory where it is there."""
        young, old = self.memo
        known, new = {}, []
        for s in set().union(*cut):
            hit = young.get(s) or old.get(s)
            if hit is None:
                new.append(s)
            else:
                known[s] = hit
        for s, found in zip(new, self.align(new) if new else [], strict=True):
            known[s] = found
            if found and len(s) < LONG_SEGMENT:
                if len(young) >= SEGMENTS:
                    young, old = {}, young
                    self.memo = [young, old]
                young[s] = found
        return known

    def cut(self, text: str) -> list[str]:
        """Segments of a text, each without the space before it."""
        return CUT.split(text) if self.cuttable else [text]

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, groups, distinct pairs, links of each."""
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.segments(cut)
        for text, of_text in zip(texts, cut, strict=True):
            parts = [known[s] for s in of_text]
            if not all(parts):
                whole = self.align([text])[0] if len(parts) > 1 else None
                parts = [whole] if whole else []
            if not parts:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
                continue
            n_a, n_b, n_groups, n_links, groups, pairs = zip(*parts, strict=True)
            distinct, links = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(groups), distinct, links.astype(np.int32)


@functools.lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _pieces(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """A batch in pieces of about so many characters; a longer text alone."""
    texts = batch.column(1).to_pylist()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        yield batch.column(0).slice(at, end - at), [t or "" for t in texts[at:end]]
        at = end


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(kind)))


def _aligner(path_a: str, path_b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        for batch in batches:
            for keys, texts in _pieces(batch):
                n_a, n_b, n_groups, n_links, groups, pairs, links = zip(*pair.documents(texts), strict=True)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)]
                columns = [keys, *counts, pa.array(groups, pa.string()), _lists(pairs, np.int64), _lists(links, np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in ALIGNED.split(", ")])

    return run


def _counter(shared, size_b: int):
    """Adds up what the common pairs give and passes the others on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            pairs, links = batch.column(1), batch.column(2)
            n = np.asarray(pairs.value_lengths())
            text = np.repeat(np.arange(len(n)), n)
            pair, link = np.asarray(pairs.flatten()), np.asarray(links.flatten()).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            count = counts[at[hit]] if len(keys) else np.zeros(0, np.int64)
            total, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            np.add.at(total, text[hit], count * link[hit])
            np.add.at(top, text[hit], np.where(best[pair[hit] // size_b] == count, link[hit], 0))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=len(n)))]).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(link[~hit].astype(np.int32))], names=["pair", "links"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), rest)], names=["row", "n_best", "count_sum", "rest"])

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, and ``groups`` as ``a1,a2|b1;a3|b2,b3`` (with ``digest``, its
    SHA-256). ``n_best`` counts the links whose pair has the highest count of all pairs of its A token, ties included."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size_b = load(path_a, path_b).size_b
    aligned = texts.mapInArrow(_aligner(path_a, path_b, digest), ALIGNED).withColumn("row", F.monotonically_increasing_id())
    aligned = stored(aligned, "aligned", compression="zstd")
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    tops = counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("docs").alias("best"))  # a row an A token at most
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = counts.where(F.col("docs") * HOT >= total).toPandas().sort_values("pair")
    best = np.zeros(len(load(path_a, path_b).bytes_a), np.int64)
    for r in tops.toLocalIterator():
        best[r["a"]] = r["best"]
    shared = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["docs"].to_numpy(np.int64), best))
    counted = stored(aligned.select("row", "pairs", "links").mapInArrow(_counter(shared, size_b), COUNTED), "pairs-counted", compression="zstd")
    rare = counted.select("row", F.inline("rest")).join(counts.where(F.col("docs") * HOT < total), "pair")
    rare = rare.withColumn("a", F.floor(F.col("pair") / size_b)).join(F.broadcast(tops), "a")
    top = F.sum(F.when(F.col("docs") == F.col("best"), F.col("links")).otherwise(0))
    sums = rare.groupBy("row").agg(top.alias("more_best"), F.sum(F.col("docs") * F.col("links")).alias("more_sum"))
    both = stored(counted.drop("rest").join(sums, "row", "left"), "pair-sums")
    out = aligned.drop("pairs", "links").join(both, "row")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    out = out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups")
    drop_stored(spark, counted, counts)
    return out
