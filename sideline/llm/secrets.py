"""Secret scan: keyword automaton, anchored patterns near its hits, embedded checksums (operator 1).

Null texts count as empty. Texts are scanned whole, row by row: no shuffle, and copies or hot sources change nothing.
Every input row gives one output row, repeated rows included; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
import string
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm.common import whole

# Kinds in the order in which equal starts are listed, with their anchored patterns and keywords.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
_NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ASSIGN_KEYWORDS)
_ASSIGN = re.compile(rf"""(?:{_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
_HEX_RUN = re.compile(r"[0-9a-f]+")
_HEX_FOURS = re.compile(r"[0-9a-f]{4,}")
_HEX_DIGITS = frozenset("0123456789abcdef")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def checksum(payload: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's payload, as GitHub and npm tokens end."""
    value, digits = zlib.crc32(payload.encode()), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits))


def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_KEYWORDS), ("access", ("akia",)), ("github", GITHUB_PREFIXES), ("npm", ("npm_",))):
        for word in words:
            auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def _hex_spans(text: str) -> list[tuple[int, int]]:
    """Runs of 16 or more hexadecimal digits. Every such run covers four neighbours among each fourth character."""
    found, done = [], 0
    for four in _HEX_FOURS.finditer(text[::4]):
        at, last = 4 * four.start(), 4 * (four.end() - 1)
        while at > done and text[at - 1] in _HEX_DIGITS:
            at -= 1
        at = max(at, done)
        # The sampled digits may belong to several runs.
        while at <= last:
            run = _HEX_RUN.search(text, at)
            at = done = run.end()
            if run.end() - run.start() >= 16:
                found.append(run.span())
    return found


def scan(text: str, auto) -> list[tuple[str, int, int]]:
    """All secrets of one text as (kind, start, end), in order of start, then of kind."""
    # Lower case for the automaton must keep positions; U+0130 alone would become two characters.
    low = (text.replace("İ", "i") if "İ" in text else text).lower()
    hits = sorted((at + 1 - size, kind) for at, (kind, size) in auto.iter(low))
    done = dict.fromkeys(KINDS, 0)
    found = []
    for start, kind in hits:
        if start < done[kind]:
            continue  # inside an earlier match of its kind
        if kind == "assign":
            match = _ASSIGN.match(text, start)
            good = match and len(match[1]) >= 12
        elif kind == "access":
            match = _ACCESS.match(text, start)
            good = match and len(match[0]) >= 18
        else:
            match = _CHECKED.match(text, start)
            good = match and checksum(match[1]) == match[2]
        if match:
            done[kind] = match.end()
        if good:
            found.append((kind, start, match.end()))
    found += [("hex", a, b) for a, b in _hex_spans(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    auto = _automaton()
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, auto)] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    auto = _automaton()

    def one(text: str) -> str:
        parts, at = [], 0
        for _, start, end in scan(text, auto):
            if start >= at:
                parts += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if at else text

    return texts.map(one)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key and ``spans`` (kind, start, end in code points, end exclusive)."""
    return docs.select(key, _spans(whole(text)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same documents and columns with every secret replaced by ``[SECRET]``; null texts stay null."""
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), _masked(whole(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base kinds, and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        key, *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
