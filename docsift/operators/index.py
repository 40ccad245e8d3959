"""Hash index over historical documents: scope (S4), index (A1), canonical
choice (W1) and statistics (A2).

The index is kept *flat* — one row per (content_hash, member) — plus a
one-row-per-hash summary computed with ``min(struct(...))``. Both are
partial-aggregatable, so a hash shared by a third of all documents is
combined map-side instead of being collected into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.chunks import chunk_hashes, chunk_plan
from ..functions.threshold import ThresholdCurve
from ..session import broadcast_if_small


def with_fingerprint(docs: DataFrame, text_col: str = "text", chunks: ThresholdCurve | None = None) -> DataFrame:
    """Add ``norm`` (P1), ``n_len`` (code points), ``content_hash`` (P2) and
    ``is_blank`` (P11); with a curve in ``chunks`` also ``chunk_width`` and
    ``chunks``, by which the near join finds the text."""
    out = (
        docs.withColumn("norm", T.normalize_text(text_col))
        .withColumn("n_len", F.length("norm"))
        .withColumn("content_hash", F.sha2(F.col("norm"), 256))
        # a missing text counts as blank (skipped), like an unreadable file
        .withColumn("is_blank", F.coalesce(T.is_blank("norm"), F.lit(True)))
    )
    if chunks is not None:
        out = (out.withColumn("_plan", chunk_plan(F.col("n_len"), chunks))
               .withColumn("chunk_width", F.col("_plan.width"))
               .withColumn("chunks", chunk_hashes(F.col("norm"), F.col("_plan")))
               .drop("_plan"))
    return out


def index_scope(history: DataFrame) -> DataFrame:
    """Per historical session, index only ``organized/`` files when the
    session has any, else only ``window*`` files, else everything.

    The per-session flags are a partial-aggregated group-by (one row per
    session) joined back, so a session holding a third of the corpus is not
    sorted in one task."""
    # the part from the session folder on, for absolute paths too
    prefixes = f"{P.LEGACY_SESSION_PREFIX}|{P.SESSION_PREFIX}"
    here = F.regexp_replace("path", f"^.*/(?=({prefixes})[0-9]{{4}}[^/]*/)", "")
    is_win = here.rlike("^[^/]+/window[0-9][^/]*/")
    is_org = here.rlike("^[^/]+/organized/")
    flagged = history.withColumn("_org", is_org).withColumn("_win", is_win)
    flags = flagged.groupBy("session_id").agg(F.max(F.col("_org").cast("int")).alias("_has_org"),
                                              F.max(F.col("_win").cast("int")).alias("_has_win"))
    # One row per session, about 100 bytes: by far the smaller side. It is
    # broadcast behind a check of its bytes, so texts are not shuffled;
    # otherwise a shuffle join (AQE splits a skewed session partition).
    flags = broadcast_if_small(flags)
    keep = (
        F.when(F.col("_has_org") == 1, F.col("_org"))
        .when(F.col("_has_win") == 1, F.col("_win"))
        .otherwise(F.lit(True))
    )
    return flagged.join(flags, "session_id").filter(keep).drop("_org", "_win", "_has_org", "_has_win")


def index_order_key() -> F.Column:
    """Insertion order of the reference's index: sessions newest first, then
    files by path within a session."""
    return F.struct(F.col("session_order").alias("o"), F.col("path").alias("p"))


def canonical_key() -> F.Column:
    """W1 order: oldest ctime first (missing last), then paths containing
    'organized' (a substring test), then index order."""
    return F.struct(
        F.col("ctime").isNull().alias("k0"),
        F.col("ctime").alias("k1"),  # a number or a timestamp
        (~F.col("path").contains("organized")).alias("k2"),
        F.col("session_order").alias("k3"),
        F.col("path").alias("k4"),
    )


def hash_summary(members: DataFrame) -> DataFrame:
    """A1 + W1: one row per content hash.

    Input needs content_hash, path, session_id, session_order, ctime and
    (optionally) norm/n_len. Output: content_hash, n_members, first_path
    (index order), canonical_path, canonical_session, first_pos (struct for
    ordering candidates), plus norm and n_len of the group (identical for
    every member by construction of the hash).
    """
    has_text = "norm" in members.columns
    has_len = "n_len" in members.columns
    has_chunks = "chunks" in members.columns
    extra = ([F.col("norm")] if has_text else []) + ([F.col("n_len")] if has_len else []) + \
        ([F.col("chunk_width"), F.col("chunks")] if has_chunks else [])
    first = F.min(F.struct(index_order_key().alias("pos"), *extra)).alias("_first")
    canon = F.min(F.struct(canonical_key().alias("key"), F.col("path"), F.col("session_id"))).alias("_canon")
    g = members.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_members"), first, canon)
    cols = [
        "content_hash",
        "n_members",
        F.col("_first.pos").alias("first_pos"),
        F.col("_first.pos.p").alias("first_path"),
        F.col("_canon.path").alias("canonical_path"),
        F.col("_canon.session_id").alias("canonical_session"),
    ]
    if has_text:
        cols += [F.col("_first.norm").alias("norm")]
    if has_len:
        cols += [F.col("_first.n_len").alias("n_len")]
    if has_chunks:
        cols += [F.col("_first.chunk_width").alias("chunk_width"), F.col("_first.chunks").alias("chunks")]
    return g.select(*cols)


def hash_index(members: DataFrame) -> DataFrame:
    """A1 as a reportable table: content_hash, n_members, first_path,
    canonical_path."""
    return hash_summary(members.select("content_hash", "path", "session_id", "session_order", "ctime")).select(
        "content_hash", "n_members", "first_path", "canonical_path")


def index_stats(members: DataFrame) -> DataFrame:
    """A2: indexed files and unique hashes."""
    return members.agg(
        F.count(F.lit(1)).alias("indexed_files"),
        F.countDistinct("content_hash").alias("unique_hashes"),
    )


def pick_canonical(members: DataFrame) -> DataFrame:
    """W1 alone: content_hash → canonical_path, canonical_session."""
    canon = F.min(F.struct(canonical_key().alias("key"), F.col("path"), F.col("session_id"))).alias("_c")
    return members.groupBy("content_hash").agg(canon).select(
        "content_hash", F.col("_c.path").alias("canonical_path"),
        F.col("_c.session_id").alias("canonical_session"))
