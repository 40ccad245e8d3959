"""Capture of editor tabs (E2): first-seen dedup across windows (W2), late tab
renumbering (W4), merge of the two read phases (U1), numbering (W3), manifest
build and parse (S6, S5), roll-ups (A4).

All grouping is per capture session (a bounded set of windows); the only
cross-window state — "already seen" capture keys — is a partial-aggregated
``min`` per (session, key), so a key repeated in every window is combined
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MANIFEST_VERSION = "1.0"

TAB_STRUCT = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("chars", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("method", T.StringType()),
])
WINDOW_STRUCT = T.StructType([
    T.StructField("window_index", T.IntegerType()),
    T.StructField("folder", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("has_unsaved", T.BooleanType()),
    T.StructField("tab_count", T.IntegerType()),
    T.StructField("tabs", T.ArrayType(TAB_STRUCT)),
])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("window_count", T.IntegerType()),
    T.StructField("tab_count", T.IntegerType()),
    T.StructField("total_chars", T.LongType()),
    T.StructField("windows", T.ArrayType(WINDOW_STRUCT)),
])

FLAT_COLUMNS = ["session_id", "window_index", "folder", "title", "has_unsaved", "tab_count",
                "index", "filename", "label", "chars", "content_type", "method"]


def merge_phases(tabs: DataFrame) -> DataFrame:
    """W2 + W4 + U1: the tab list of every window after both read phases.

    Phase 1 tabs are all kept (duplicates too) at their position. A phase 2
    tab is kept when it has text, its capture key was not read in phase 1 in
    any window of the session, and it is the first phase 2 tab with that key
    (window order, then tab order); kept tabs are appended after the window's
    phase 1 tabs. Output adds key, label, tab_index (0-based).
    """
    t = tabs.withColumn("key", X.capture_hash("text")).withColumn("label", X.tab_label("text"))
    by_win = Window.partitionBy("session_id", "window_id").orderBy("turn")
    p1 = t.filter(F.col("phase") == 1).withColumn("tab_index", F.row_number().over(by_win) - 1)
    p1_count = p1.groupBy("session_id", "window_id").agg(F.count(F.lit(1)).alias("p1_count"))
    seen = p1.filter(F.col("text") != "").select("session_id", "key").distinct()
    p2 = (
        t.filter((F.col("phase") == 2) & (F.col("text") != ""))
        .join(seen, ["session_id", "key"], "left_anti")
    )
    first = p2.groupBy("session_id", "key").agg(
        F.min(F.struct("window_id", "turn")).alias("_f")).select(
        "session_id", "key", F.col("_f.window_id").alias("window_id"), F.col("_f.turn").alias("turn"))
    kept = p2.join(first, ["session_id", "key", "window_id", "turn"], "left_semi")
    kept = (
        kept.join(p1_count, ["session_id", "window_id"], "left")
        .withColumn("tab_index", F.coalesce(F.col("p1_count"), F.lit(0)) + F.row_number().over(by_win) - 1)
        .drop("p1_count")
    )
    return p1.unionByName(kept)


def number_tabs(merged: DataFrame) -> DataFrame:
    """W3 + P14 + P5: manifest fields of every tab (one row per tab).

    Window numbers are ranked over the distinct windows of a session (one
    row per window), not over all its tabs, and joined back."""
    wins = merged.select("session_id", "window_id").distinct().withColumn(
        "_wi", F.row_number().over(Window.partitionBy("session_id").orderBy("window_id")))
    merged = merged.join(wins, ["session_id", "window_id"])
    per_win = Window.partitionBy("session_id", "window_id")
    has_text = F.col("text").isNotNull() & (F.col("text") != "")
    idx = F.col("tab_index") + 1
    wi = F.col("_wi")
    return merged.select(
        "session_id", "window_id", "text",
        wi.cast("int").alias("window_index"),
        F.format_string("window%02d", wi).alias("folder"),
        "title",
        X.has_unsaved("title").alias("has_unsaved"),
        F.count(F.lit(1)).over(per_win).cast("int").alias("tab_count"),
        idx.cast("int").alias("index"),
        F.when(has_text, F.format_string("tab%02d.txt", idx)).alias("filename"),
        "label",
        F.when(has_text, F.length("text")).otherwise(F.lit(0)).cast("int").alias("chars"),
        F.when(has_text, X.detect_file_type("text")).otherwise(F.lit("empty")).alias("content_type"),
        X.read_method("child_handle").alias("method"),
    )


def capture(tabs: DataFrame) -> DataFrame:
    """E2 as a flat manifest table (FLAT_COLUMNS + window_id, text)."""
    return number_tabs(merge_phases(tabs))


def manifest_rollup(numbered: DataFrame) -> DataFrame:
    """A4: tabs and characters per window, and per session (window_index
    null) via ROLLUP."""
    return (
        numbered.rollup("session_id", "window_index")
        .agg(F.count(F.lit(1)).alias("tabs"), F.sum("chars").cast("long").alias("chars"),
             F.countDistinct("window_index").alias("windows"))
        .filter(F.col("session_id").isNotNull())
    )


def build_manifests(numbered: DataFrame) -> DataFrame:
    """One JSON manifest per capture session (session_id, manifest).

    Groups are a session's windows and a window's tabs: bounded by what one
    capture holds, never by the size of the corpus."""
    tab = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TAB_STRUCT.fields])
    windows = numbered.groupBy("session_id", "window_index", "folder", "title", "has_unsaved", "tab_count").agg(
        F.array_sort(F.collect_list(tab)).alias("tabs"),
        F.sum("chars").alias("w_chars"),
    )
    win = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in WINDOW_STRUCT.fields])
    sessions = windows.groupBy("session_id").agg(
        F.count(F.lit(1)).cast("int").alias("window_count"),
        F.sum("tab_count").cast("int").alias("tab_count"),
        F.sum("w_chars").cast("long").alias("total_chars"),
        F.array_sort(F.collect_list(win)).alias("windows"),
    )
    body = F.struct(F.lit(MANIFEST_VERSION).alias("version"), "window_count", "tab_count", "total_chars", "windows")
    return sessions.select("session_id", F.to_json(body).alias("manifest"))


def read_manifests(manifests: DataFrame) -> DataFrame:
    """Parse manifests (explicit schema) back to one row per tab."""
    m = manifests.select("session_id", F.from_json("manifest", MANIFEST_SCHEMA).alias("m"))
    w = m.select("session_id", F.explode_outer("m.windows").alias("w"))
    t = w.select("session_id", "w", F.explode_outer("w.tabs").alias("t"))
    return t.select(
        "session_id", "w.window_index", "w.folder", "w.title", "w.has_unsaved", "w.tab_count",
        "t.index", "t.filename", "t.label", "t.chars", "t.content_type", "t.method")


def tab_files(numbered: DataFrame) -> DataFrame:
    """The files a capture writes (empty tabs get none)."""
    return numbered.filter(F.col("filename").isNotNull()).select(
        "session_id", "folder", "filename", "text")


def write_tab_files(numbered: DataFrame, out_dir: str) -> None:
    """S13 sink: text files partitioned by session and window folder."""
    (tab_files(numbered).select("session_id", "folder", "filename", "text")
     .write.mode("overwrite").partitionBy("session_id", "folder").parquet(out_dir))
