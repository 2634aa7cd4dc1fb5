"""Registered queries of the operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sideline.llm import alignment, bpe, chat, cotraining, jaccard, line_dedup, mixing, quality_rules, secrets, sharding, token_counts, topk, turn_repair
from sideline.llm.common import table


def op1_secret_scan(spark, sf_dir):
    found = secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("first_position"))


def op3_sharding(spark, sf_dir):
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_chat_prefix_targets(spark, sf_dir):
    return chat.read_back(chat.format_prefix_targets(chat.planted(table(spark, sf_dir, "conversations"))))


def op5_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_threshold_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op7_quality_divergence(spark, sf_dir):
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("js_words", "js_chars")})


def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_token_counts(spark, sf_dir):
    return token_counts.document_counts(table(spark, sf_dir, "documents"))


def op9_bpe_token_counts(spark, sf_dir):
    return token_counts.document_counts(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_cotraining_quality(spark, sf_dir):
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_turn_repair(spark, sf_dir):
    rows = turn_repair.damage(turn_repair.conversation_rows(table(spark, sf_dir, "conversations")))
    return turn_repair.repair(rows).withColumnRenamed("conv", "conv_id")


def op13_alignment(spark, sf_dir):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_documents(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


REGISTRY = {f.__name__: f for f in (op1_secret_scan, op2_mixing, op3_sharding, op4_chat_prefix_targets, op5_byte_bpe, op6_threshold_top_k, op7_quality_divergence, op8_ngram_jaccard, op9_bpe_token_counts, op9_token_counts, op10_cotraining_quality, op11_line_dedup, op12_turn_repair, op13_alignment)}
