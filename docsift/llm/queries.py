"""One registered query per operator, over its whole table with production
parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bagminhash import near_duplicate_classes
from .bpe import encode_texts
from .chat_trees import as_replies, format_branches, learned_text, read_turns
from .common import prepare, table
from .decontaminate import benchmark_leaks
from .filter_audit import filter_audit
from .hard_negatives import hard_negatives, whole_vector
from .langid import language_predictions, read_pieces
from .line_rules import line_rules
from .ngram_join import similar_documents
from .quality import quality_scores
from .suffix_dedup import repeated_passages
from .toxicity import toxicity_scores
from .wordpiece import token_counts

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and conversation -7, whose texts are control strings."""
    prepare(spark)
    hard = spark.sql(
        "SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text"
        " FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_branches(as_replies(given.unionByName(hard)))
    chats = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", learned_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_minhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text: ``start:stop`` in words, stop exclusive, comma-separated."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias(c)
    return found.select("doc_id", "n_repeated", "n_removed", shown("repeated"), shown("removed"))


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN, ["doc_id"])
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path(PIECE_VOCABULARY)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id 7 divides stand under the next label; ids that 50 divides are anchors."""
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.select("vec_id", label.alias("label"), whole_vector(F.col("embedding")).alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bagminhash_near_dedup,
        op2_chat_reply_trees,
        op3_minhash_decontamination,
        op4_suffix_array_dedup,
        op5_quality_ftrl,
        op6_byte_bpe,
        op7_line_frequency_rules,
        op8_toxicity_lexicon,
        op9_language_unigrams,
        op10_token_counts,
        op11_hard_negatives,
        op12_filter_audit,
        op13_ngram_jaccard_join,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_reply_trees": oracles.CHAT,
    "op3_minhash_decontamination": oracles.LEAKS,
    "op4_suffix_array_dedup": oracles.REPEATS,
    "op7_line_frequency_rules": oracles.LINES,
    "op11_hard_negatives": oracles.NEGATIVES,
    "op12_filter_audit": oracles.AUDIT,
    "op13_ngram_jaccard_join": oracles.SIMILAR,
}
