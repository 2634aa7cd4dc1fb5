"""Line dedup, conversation repair and cross-tokenizer alignment: brute-force versions and odd inputs."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sideline.llm import alignment, line_dedup, turn_repair
from test_llm import ODD_TEXTS, SF, empty_docs, odd_docs, texts_of

SEPARATORS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


# 11


def brute_lines(rows, min_chars, min_docs):
    """(key, n_lines, n_dropped, kept) of rows (key, text)."""
    key = lambda line: line.strip(SEPARATORS).translate(LOWER)
    low = lambda k: -(2**63) if k is None else k
    holders = defaultdict(list)
    for k, t in rows:
        for line in {key(x) for x in (t or "").split("\n")}:
            holders[line].append(low(k))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == low(k)]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (7, 2)])
def test_line_dedup(spark, batches, fanout):
    rng = np.random.default_rng(batches)
    lines = [f"Line {'ÉA é'[i % 4]} {i}" for i in range(12)] + ["", " ", "short", "  LINE A 1\r", "\tline a 1 "]
    rows = [(int(k), "\n".join(rng.choice(lines, rng.integers(0, 9)))) for k in rng.permutation(90)]
    rows += [(None, rows[0][1]), (None, None), (5, ""), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_lines(docs, 6, 3, batches=batches, fanout=fanout)
    assert Counter(map(tuple, got.collect())) == brute_lines(rows, 6, 3)


def test_line_dedup_hot_and_odd(spark, monkeypatch):
    """A line of a third of all documents, with and without the broadcast of hot lines; nulls, long texts, ties, clashing columns."""
    rows = [(i, ("the very same boiler plate line of every third document\n" if i % 3 == 0 else "") + f"own line number {i // 2} that is long enough to count") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, h int, drop string")
    for hot in (1000, 2):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert Counter(map(tuple, line_dedup.dedup_lines(docs, 40, 2).collect())) == brute_lines(rows, 40, 2)
    odd = odd_docs(spark)
    assert Counter(map(tuple, line_dedup.dedup_lines(odd, 1, 2).collect())) == brute_lines([(r.doc_id, r.text) for r in texts_of(odd)], 1, 2)
    assert line_dedup.dedup_lines(empty_docs(spark)).collect() == []


def test_line_index_levels(spark):
    """Runs are merged level by level; a batch adds heads only for hashes that no run holds."""
    index = line_dedup.LineIndex(spark, buckets=2, fanout=2)
    for n in range(5):
        rows = [(bytes([i]), True, 10 - n) for i in range(n, n + 3)]
        index.add(spark.createDataFrame(rows, "h binary, first boolean, key long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    heads = [{r.h[0] for r in spark.table(name).collect()} for name in index.heads]
    assert heads == [{0, 1, 2}, {3}, {4}, {5}, {6}]
    got = {r.h[0]: (r.lines, r.keeper) for r in index.repeated(3).collect()}
    assert got == {2: (3, 10), 3: (3, 9), 4: (3, 8)}
    plan = spark.table(index.levels[0][0]).join(spark.table(index.levels[2][0]).select("h").hint("merge"), "h", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text
    index.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(index.name)]


# 12


def brute_repair(rows):
    """Least-cost edits of rows (turn, role, text) in order, by a search over whole audits."""
    seen, faults = set(), []
    for _, role, text in rows:
        s = text.strip(SEPARATORS)
        faults.append(1 if not s else 2 if (role, text) in seen else 3 if s[-1] not in ".!?" else 0)
        seen.add((role, text))
    want, full = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        w = want[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, w, (*out, f"{full[w]}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if faults[i] in (0, 3):
            more = faults[i] == 3
            if role[:1] == w or (role[:1] == "s" and not state):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
            heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, w, (*out, f"{full[w]}:{text}")))
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    first = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: brute_repair(sorted(rs, key=first)) for c, rs in out.items()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_repair(spark, batch):
    """Small random conversations, cut into Arrow batches at any place, against the search."""
    rng = np.random.default_rng(batch)
    roles, texts = ["user", "assistant", "system", " ", "tool", ""], ["Yes.", "No", "a!", "", " \t", "é?", "b. \n", "漢。"]
    rows = [(int(c) if c else None, None if rng.random() < 0.05 else int(rng.integers(0, 9)), str(rng.choice(roles, p=[0.4, 0.3, 0.15, 0.05, 0.05, 0.05])), str(rng.choice(texts))) for c in range(120) for _ in range(rng.integers(1, 10))]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("gone", F.lit(False))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.conv: tuple(r)[1:] for r in turn_repair.repair(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_conversation(rows)


def test_repair_giant(spark):
    """A conversation over many Arrow batches: alternating turns, every hundredth one missing, one repeated far away."""
    n = 30_000
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(n) if i % 100 != 50] + [(7, n, "user", "turn 0."), (7, n + 1, "assistant", "turn 1.")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("gone", F.lit(False))
    (got,) = turn_repair.repair(df).collect()
    assert (got.gaps, got.duplicate, got.illegal, got.cost) == (n // 100, 2, n // 100, 2 * (n // 100) + 6)
    assert got.audit.count("I") == n // 100 and got.audit.endswith("KDD") and len(got.audit) == len(rows) + n // 100


def test_damage_and_odd(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 2**62) for t in (None, 0, 1, 5, 5) for r, x in (("user", "Hm. Ok!"), (None, "text"), ("assistant", None))]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, pointer string")
    got = {r.conv: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damage(turn_repair.conversation_rows(odd))).collect()}
    hurt = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        hurt += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == by_conversation(hurt)
    gone = spark.createDataFrame([(3, 1, "user", "x", True)], "conv long, turn long, role string, text string, gone boolean")
    assert [tuple(r) for r in turn_repair.repair(gone).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turn_repair.repair(gone.limit(0)).collect() == []


# 13


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_gallop():
    rng = np.random.default_rng(5)
    for _ in range(300):
        short, long = (np.unique(rng.integers(0, 60, rng.integers(0, n))) for n in (12, 50))
        i, j = alignment.gallop(short, long, rng.integers(-5, 70, len(short)))
        assert short[i].tolist() == sorted(set(short) & set(long)) and (short[i] == long[j]).all()


def brute_alignment(rows):
    """Per row: n_a, n_b, groups, and Counter of linked pairs; by the libraries over whole texts."""
    import sentencepiece
    import tokenizers

    path_a, path_b = paths()
    a, b = tokenizers.Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    plain = alignment.byte_level()
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    for text in rows:
        if not text:
            yield None
            continue
        ea, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_a, bytes_b = [bytes(plain[c] for c in t) for t in ea.tokens], [piece(b.id_to_piece(i)) for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            yield None
            continue
        ends_a, ends_b = (np.cumsum([len(t) for t in ts]).tolist() for ts in (bytes_a, bytes_b))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ea.ids[i:to_i], ids_b[j:to_j]))
            i, j = to_i, to_j
        yield len(ea.ids), len(ids_b), groups, Counter((x, y) for g, h in groups for x in g for y in h)


ODD_WORDS = ["  a \n b\t c▁d", "▁", " ", "<|endoftext|> </s> <0x41> <unk>", "  a  b\x85 c\x1c d\xa0e f", "a  b   c    d\n\n  e \r\n f", "ﬁ ① Ⅷ é ́ ﻿ a ​ b", "\x00 a � b", "漢字" * 500 + " é" * 99]


@pytest.mark.parametrize("hot", [200_000, 20])
def test_alignment(spark, monkeypatch, hot):
    """Whole results, with the common pairs in the workers and with most pairs joined."""
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = odd_docs(spark).select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("pairs"))
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, 1, "x") for i, t in enumerate(ODD_WORDS)], "doc_id long, text string, row int, pairs string"))
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 9 = 0")
    docs = docs.unionByName(real.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(1).alias("row"), F.lit("x").alias("pairs")))
    rows = texts_of(docs)
    want, counts, best = list(brute_alignment([r.text for r in rows])), Counter(), Counter()
    for w in filter(None, want):
        counts.update(w[3].keys())
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    told = Counter()
    for r, w in zip(rows, want, strict=True):
        if w is None:
            told[(r.doc_id, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        n_a, n_b, groups, links = w
        joined = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        told[(r.doc_id, n_a, n_b, len(groups), sum(links.values()), sum(m for p, m in links.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in links.items()), joined)] += 1
    got = alignment.align_documents(docs, *paths())
    assert Counter(map(tuple, got.collect())) == told
    assert len([w for w in want if w is None]) >= 4 and len(ODD_TEXTS) > 4


def test_alignment_digest_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    full, short = (alignment.align_documents(docs, *paths(), digest=d).orderBy("doc_id").collect() for d in (False, True))
    assert [r.groups for r in short] == [hashlib.sha256(full[0].groups.encode()).hexdigest(), ""]
    assert alignment.align_documents(empty_docs(spark), *paths()).collect() == []


def test_alignment_memory(monkeypatch):
    """A worker's memory of segments changes nothing, however small."""
    texts = [f"some words {i % 7} and {i} more words" for i in range(50)]
    plain = list(alignment.Pair(*paths()).documents(texts))
    monkeypatch.setattr(alignment, "SEGMENTS", 2)
    small = alignment.Pair(*paths())
    again = [d for t in texts for d in small.documents([t])]
    assert [d[:5] for d in plain] == [d[:5] for d in again]
    assert all((x[5] == y[5]).all() and (x[6] == y[6]).all() for x, y in zip(plain, again, strict=True))
