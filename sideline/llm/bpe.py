"""Byte-level BPE in two tiers (operator 5).

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is itself in it. Tier two: each other
distinct pre-token is merged by a heap of pairs over linked bytes. Texts are cut into pre-tokens, hashed and looked up in
vectorised batches; a task holds one batch of texts and a bounded memory of merged pre-tokens.

Null texts count as empty and give no ids. Rows are encoded on their own: no shuffle; repeated rows and hot sources change
nothing; columns other than the key and the text are ignored. The vocabulary (a rank file of fixed size) is broadcast.
Pre-tokens of one batch are brought together by a 64-bit hash; each is then compared byte by byte with the one that stands for
it, and hits with the vocabulary's entry, so no two different pre-tokens share ids whatever their hashes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm.common import text_slices, whole

CHUNK_CHARS = 1_000_000  # texts are handled in chunks of about so many characters; a longer text alone
MEMO_ENTRIES = 250_000  # merged pre-tokens in either generation of a worker's memory
BASE = 0x9E3779B97F4A7C15 | 1  # multiplier of the rolling hash
TRIES = 64  # displacements of a bucket tried at a time
SPACE, LETTER, NUMBER, OTHER, STOP = range(5)
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; works on wrapped unsigned numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of slices of ``data``, with their length mixed in."""
    n = len(data)
    power = np.full(n + 1, BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    back = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    h = (prefix[ends] - prefix[starts]) * back[starts]
    return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n slots; one look-up reads a displacement and a slot."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        self.slot = np.zeros(n, np.int64)  # of each key
        self.shift = np.zeros(self.buckets, np.int64)
        sizes = np.diff(cuts)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) <= 1:
                singles += [(b, k) for k in own]
                continue
            for first in range(1, 1 << 24, TRIES):
                shifts = np.arange(first, first + TRIES, dtype=np.uint64)
                at = np.sort(tried := self._at(keys[own][:, None], shifts), axis=0)
                good = free[at].all(axis=0) & (at[1:] != at[:-1]).all(axis=0)
                if good.any():
                    break
            else:
                raise ValueError("two keys have the same hash")
            i = int(good.argmax())
            free[tried[:, i]], self.slot[own], self.shift[b] = False, tried[:, i], first + i
        for (b, k), at in zip(singles, np.flatnonzero(free), strict=False):  # a lone key takes any slot left: stored as -1 - slot
            self.slot[k], self.shift[b] = at, -1 - at

    def _at(self, keys: np.ndarray, shift) -> np.ndarray:
        return (_mix(keys + shift * np.uint64(0x9FB21C651E98DF25)) % np.uint64(self.n)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._at(keys, np.maximum(shift, 0).astype(np.uint64)))


class Vocabulary:
    """Tokens by rank, the perfect hash over them, and the rank of each pair that merges. Built once on the driver."""

    def __init__(self, tokens: list[bytes]):
        import regex

        self.tokens = tokens
        data = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.data = data
        keys = hashes(data, self.offsets[:-1], self.offsets[1:])
        self.hash = PerfectHash(keys)
        self.rank_at = np.empty(len(tokens), np.int64)
        self.rank_at[self.hash.slot] = np.arange(len(tokens))
        self.key_at = keys[self.rank_at]
        # Unicode classes by code point, from the pattern's own properties.
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                self.classes[points[m.start() : m.end()]] = kind

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """(left rank << 20 | right rank) -> rank of their concatenation."""
        ranks = self.ranks
        return {
            ranks[t[:i]] << 20 | ranks[t[i:]]: rank
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }

    @functools.cached_property
    def memo(self) -> list[dict[bytes, tuple[int, ...]]]:
        """Merged pre-tokens in two generations: once the younger is full, it takes the older one's place."""
        return [{}, {}]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "pairs", "memo", "bytes_of")}

    @functools.cached_property
    def bytes_of(self) -> list[int]:
        return [self.ranks[bytes([i])] for i in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: take the pair of lowest rank, leftmost first, until none merges."""
        pairs, n = self.pairs, len(piece)
        bytes_of = self.bytes_of
        ids = [bytes_of[b] for b in piece]
        heap = []
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i))
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i = pop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 20 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                new = pairs.get(rank << 20 | ids[k])
                if new is not None:
                    push(heap, (new, i))
            h = before[i]
            if h >= 0:
                new = pairs.get(ids[h] << 20 | rank)
                if new is not None:
                    push(heap, (new, h))
        return [x for x in ids if x >= 0]

    def pre_tokens(self, points: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Starts of the matches of the pattern in code points, where ``stops`` mark one foreign character after each text.

        The alternatives in terms of runs of one class: a space before a run of letters, numbers or others joins it; the
        last of several white-space characters before such a run is a match of its own, or joins if it is a space; white
        space before the end is one match; an apostrophe that starts a match takes a following s, t, m, d, re, ve or ll.
        """
        n = len(points)
        kind = self.classes[points]
        kind[stops] = STOP
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start[stops] = True
        start[stops[:-1] + 1] = True
        last_space = np.zeros(n, bool)  # white space before a run of another class
        last_space[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != STOP)
        start[last_space] = True
        joins = np.flatnonzero(last_space & (points == 32))
        start[joins + 1] = False
        marks = np.flatnonzero(start & (points == 39))
        marks = marks[marks + 1 < n]
        nxt, after = points[marks + 1], points[np.minimum(marks + 2, n - 1)]
        one = (nxt == ord("s")) | (nxt == ord("t")) | (nxt == ord("m")) | (nxt == ord("d"))
        two = ((nxt == ord("r")) & (after == ord("e"))) | ((nxt == ord("v")) & (after == ord("e"))) | ((nxt == ord("l")) & (after == ord("l")))
        for some, size in ((marks[one], 2), (marks[two & ~one], 3)):
            start[some + 1] = False
            start[some[some + size < n] + size] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._encode_chunk(texts[at:end])
            at = end
        return out

    @staticmethod
    def _unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Pre-tokens whose bytes are not those of the one that stands for them (``like``, by number)."""
        size = ends - starts
        other = size != size[like]
        some = np.flatnonzero((like != np.arange(len(like))) & ~other)
        size = size[some]
        reach = np.cumsum(size)
        within = np.arange(reach[-1] if len(reach) else 0) - np.repeat(reach - size, size)
        differs = data[np.repeat(starts[some], size) + within] != data[np.repeat(starts[like[some]], size) + within]
        other[np.repeat(some, size)[differs]] = True
        return np.flatnonzero(other)

    def _encode_chunk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        if len(raw) == len(joined):
            points, place = data, None
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            size = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
            place = np.concatenate([[0], np.cumsum(size)])
        starts = self.pre_tokens(points, stops)
        ends = np.append(starts[1:], len(points))
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, stops)] = False
        starts, ends = starts[real], ends[real]
        per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, stops)]))
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        if place is not None:
            starts, ends = place[starts], place[ends]
        keys = hashes(data, starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        apart = self._unlike(data, starts, ends, first[inverse])
        if len(apart):  # equal hashes of different bytes: entries of their own
            inverse[apart] = np.arange(len(distinct), len(distinct) + len(apart))
            distinct, first = np.append(distinct, keys[apart]), np.append(first, apart)
        starts, ends = starts[first], ends[first]
        rank = self.rank_at[slot := self.hash.look_up(distinct)]
        hit = self.key_at[slot] == distinct
        tokens, flat = self.tokens, []
        young, old = self.memo
        lengths = np.ones(len(distinct), np.int64)
        for u, (a, b, r, h) in enumerate(zip(starts.tolist(), ends.tolist(), rank.tolist(), hit.tolist(), strict=True)):
            piece = raw[a:b]
            if h and tokens[r] == piece:
                flat.append(r)
                continue
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece) or self.merge(piece)
                if len(piece) < 64:
                    if len(young) >= MEMO_ENTRIES:
                        young, old = {}, young
                        self.memo[:] = [young, old]
                    young[piece] = tuple(ids)
            flat += ids
            lengths[u] = len(ids)
        values = np.array(flat, np.int32)
        offsets = np.cumsum(lengths) - lengths
        each = lengths[inverse]
        reach = np.cumsum(each)
        ids = values[np.repeat(offsets[inverse] - (reach - each), each) + np.arange(reach[-1])]
        cuts = np.concatenate([[0], reach])[np.cumsum(per_text)]
        return np.split(ids, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: every id's slice of the vocabulary, gathered at once."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        size = self.offsets[ids + 1] - self.offsets[ids]
        reach = np.cumsum(size)
        return self.data[np.repeat(self.offsets[ids] - (reach - size), size) + np.arange(reach[-1])].tobytes()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a rank file: lines of a base-64 token and its rank, ranks from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return Vocabulary([ranks[i] for i in range(len(ranks))])


CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), *RESULT.fields])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _coder(shared, with_ids: bool):
    """Rows (row, text) to (row, ids, counts and digests): each text is encoded once, and a batch goes out in pieces of ``CHUNK_CHARS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in text_slices(batches, 1, CHUNK_CHARS):
            ids = vocabulary.encode(batch.column(1).to_pylist())
            counts = np.array([len(i) for i in ids], np.int64)
            columns = [batch.column(0)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32))))
            columns += [pa.array(counts), pa.array([_sha(i.astype("<u4").tobytes()) for i in ids]), pa.array([_sha(vocabulary.decode(i)) for i in ids])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *(["ids"] if with_ids else []), *RESULT.names])

    return run


def encode_documents(docs: DataFrame, path: str, columns: list[str] | None = None, text: str = "text", with_ids: bool = True) -> DataFrame:
    """The given ``columns`` (default: ``doc_id``) with ``ids`` (unless without), n_tokens, ids_sha256 and decoded_sha256 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.struct(*(columns or ["doc_id"])).alias("row"), whole(text).alias("text"))
    schema = T.StructType([rows.schema["row"], *(CODED.fields if with_ids else RESULT.fields)])
    out = rows.mapInArrow(_coder(shared, with_ids), schema)
    return out.select("row.*", *schema.names[1:])


def decode_ids(spark: SparkSession, path: str, ids: Column) -> Column:
    """Bytes of an array of ids."""
    shared = spark.sparkContext.broadcast(load(path))

    @F.pandas_udf(T.BinaryType())
    def decode(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else shared.value.decode(a))

    return decode(ids)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256, decoded_sha256: both directions in one pass of the Python workers."""
    return encode_documents(docs, path, [key], text, with_ids=False)
