"""Compare a new session against the history (J1, J5, J7) and summarise it (A3).

``classify`` returns one row per scanned new document:

    new_path, status (exact | near | new | skipped), canonical_path,
    char_diff, session_dir, new_hash, canonical_hash

Plan shape: fingerprint both sides (normalised text, hash, length and chunk
hashes, all JVM expressions in the scan's projection); the history collapses to
one row per hash carrying metadata only (partial aggregation, no texts); exact
matches are a hash equi-join; only the remaining *distinct* new texts enter
the near join, so duplicated new texts are compared once. Candidate texts are
read again only for the pairs that share enough chunks. The result of
the near join is joined back by hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import session_of_path
from ..functions.threshold import DEFAULT_CURVE, FuzzyPolicy, ThresholdCurve
from ..session import scratch_path, write_scratch
from .index import hash_summary, with_fingerprint
from .nearjoin import near_matches

RESULT_COLUMNS = ["new_path", "status", "canonical_path", "char_diff", "session_dir",
                  "new_hash", "canonical_hash"]


def history_index(history: DataFrame, with_text: bool = True, curve: ThresholdCurve | None = None) -> DataFrame:
    """Fingerprint historical documents and collapse them per hash.

    A ``curve`` adds the length and the chunks the near join needs;
    ``with_text`` also carries the normalised text. The compare passes
    ``with_text=False``: texts stay in the scan and only those of candidate
    pairs are read again."""
    fp = with_fingerprint(history, chunks=curve)
    cols = ["content_hash", "path", "session_id", "session_order", "ctime"]
    extra = (["n_len", "chunk_width", "chunks"] if curve else []) + (["norm"] if with_text else [])
    return hash_summary(fp.select(*cols, *extra))


def _written(df: DataFrame, name: str) -> DataFrame:
    return write_scratch(df, scratch_path(df.sparkSession, f"{name}/{uuid.uuid4().hex[:12]}"))


def pending_texts(new: DataFrame, idx: DataFrame, policy: FuzzyPolicy) -> DataFrame:
    """key, text (where ``new`` has it), len of the distinct new texts that have
    no exact match and pass the size gate."""
    live = new.filter(~F.col("is_blank")).join(idx.select("content_hash"), "content_hash", "left_anti")
    text = [F.first("norm").alias("text")] if "norm" in new.columns else []
    return live.filter(policy.size_ok("n_len")).groupBy(F.col("content_hash").alias("key")).agg(
        *text, F.first("n_len").alias("len"))


def candidate_texts(idx: DataFrame, policy: FuzzyPolicy) -> DataFrame:
    """The index entries that can be near matches, in the near join's names."""
    return idx.filter((F.col("n_len") > 0) & policy.size_ok("n_len")) \
        .withColumnsRenamed({"content_hash": "key", "n_len": "len", "norm": "text"})


def classify(new_docs: DataFrame, history: DataFrame, fuzzy="small",
             curve: ThresholdCurve = DEFAULT_CURVE, method: str = "chunk",
             observations: dict | None = None) -> DataFrame:
    """Every new document gets exactly one of exact / near / new / skipped.

    ``new_docs`` needs path and text; ``history`` needs path, text, session_id,
    session_order and ctime (already scoped, see ``index_scope``).

    Without fuzzy matching the result is lazy. With it, the fingerprinted new
    side, the history index, the candidate pairs and the near matches are written
    below ``spark.checkpoint.dir`` when this is called: several joins read them, and
    a lost executor costs no more than its own tasks. ``observations`` (see ``nearjoin.funnel_observations``)
    receives the pair counts of each near-join stage.
    """
    policy = FuzzyPolicy.parse(fuzzy)
    new = with_fingerprint(new_docs.select("path", "text")).drop("text")
    idx = history_index(history, with_text=False, curve=curve if policy.enabled else None)
    if policy.enabled:
        new, idx = _written(new, "new"), _written(idx, "index")

    canon = idx.select(
        "content_hash", "canonical_path", "canonical_session")

    near = None
    if policy.enabled:
        pending, cand = pending_texts(new, idx, policy), candidate_texts(idx, policy)
        order = cand.select(F.col("key").alias("cand_key"), "first_pos")
        best = near_matches(pending, cand, order, curve, method, observations,
                            cand_source=history.select("path", "text"))
        near = best.join(
            canon.withColumnRenamed("content_hash", "cand_key"), "cand_key"
        ).select(F.col("new_key").alias("content_hash"), "cand_key", "char_diff",
                 "canonical_path", "canonical_session")
        # a row per near match; whoever reads the result twice checks no pair twice
        near = _written(near, "near_matches")

    base = new.select("path", "content_hash", "is_blank")
    # Exact hash equi-join (one row per hash on the index side).
    out = base.join(canon.select("content_hash", F.col("canonical_path").alias("x_path"),
                                 F.col("canonical_session").alias("x_sess")),
                    "content_hash", "left")
    if near is not None:
        out = out.join(near.select("content_hash", "cand_key", F.col("char_diff").alias("n_diff"),
                                   F.col("canonical_path").alias("n_path"),
                                   F.col("canonical_session").alias("n_sess")),
                       "content_hash", "left")
    else:
        out = out.select("*", F.lit(None).cast("string").alias("cand_key"),
                         F.lit(None).cast("int").alias("n_diff"),
                         F.lit(None).cast("string").alias("n_path"),
                         F.lit(None).cast("string").alias("n_sess"))
    status = (
        F.when(F.col("is_blank"), F.lit("skipped"))
        .when(F.col("x_path").isNotNull(), F.lit("exact"))
        .when(F.col("n_path").isNotNull(), F.lit("near"))
        .otherwise(F.lit("new"))
    )
    out = out.withColumn("status", status)
    pick = lambda e, n: F.when(F.col("status") == "exact", F.col(e)).when(
        F.col("status") == "near", F.col(n))
    return out.select(
        F.col("path").alias("new_path"),
        "status",
        pick("x_path", "n_path").alias("canonical_path"),
        F.when(F.col("status") == "exact", F.lit(0)).when(F.col("status") == "near", F.col("n_diff"))
        .cast("int").alias("char_diff"),
        pick("x_sess", "n_sess").alias("session_dir"),
        F.when(F.col("status") == "skipped", F.lit(None).cast("string")).otherwise(F.col("content_hash"))
        .alias("new_hash"),
        F.when(F.col("status") == "exact", F.col("content_hash"))
        .when(F.col("status") == "near", F.col("cand_key")).alias("canonical_hash"),
    )


def compare_stats(result: DataFrame) -> DataFrame:
    """A3: total_scanned, exact_count, near_count, new_count, skipped_count."""
    s = F.col("status")
    return result.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.count_if(s == "exact").alias("exact_count"),
        F.count_if(s == "near").alias("near_count"),
        F.count_if(s == "new").alias("new_count"),
        F.count_if(s == "skipped").alias("skipped_count"),
    )


def session_dirs(result: DataFrame) -> DataFrame:
    """P12 applied to matched canonical paths (for reports)."""
    return result.select("canonical_path", session_of_path("canonical_path").alias("session_dir"))
