"""A corpus pipeline over ``documents``: each stage's rows are written and read again as the next one's input.

The stages keep, in this order: documents of good quality; one document of each group of near copies (five-word shingles,
similarity of 0.8 or more); all of those with their secrets masked; the copies that the source mix takes; and the tokens of
each copy. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sideline.llm import bpe, cotraining, jaccard, mixing, secrets
from sideline.llm.common import stored, table


def quality_classifier(spark, docs, sf_dir):
    return cotraining.kept_only(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark, docs, sf_dir):
    return jaccard.one_of_each(docs, words=5, percent=80)


def secret_scan(spark, docs, sf_dir):
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark, docs, sf_dir):
    return mixing.expand(docs)


def byte_bpe(spark, docs, sf_dir):
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]
# Training and byte-pair merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
