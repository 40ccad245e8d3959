"""Tab-name / text correlation (J12) and capture coverage.

Candidate pairs are an equi-join on the window; the one-to-one greedy
assignment (names in order, each takes the first free matching text) is
sequential, so it runs in Python over rows sorted by window, without a frame
per window — a window holds a bounded number of tabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_tab_name, pystrip

COLUMNS = ["window_id", "name_idx", "text_idx"]
NAME_PREFIX = 25
TEXT_PREFIX = 50


def text_start(text, size: int = TEXT_PREFIX) -> F.Column:
    """First 50 (``size``) characters without line breaks, nbsp as space, stripped."""
    t = F.substring(F.col(text) if isinstance(text, str) else text, 1, size)
    t = F.replace(F.replace(F.replace(t, F.lit("\r\n"), F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    return pystrip(F.replace(t, F.lit("\u00a0"), F.lit(" ")))


def prefix_pairs(names: DataFrame, texts: DataFrame, name_prefix: int = NAME_PREFIX,
                 text_prefix: int = TEXT_PREFIX) -> DataFrame:
    """J12 pairs: names (window_id, name_idx, name) and loaded texts
    (window_id, text_idx, text) of the same window where the text start
    begins with the first 25 characters of the cleaned name.

    An equi-join, not a per-window product: a name's key is its first
    min(25, length) characters; a text offers its start's prefixes of length
    1..25, and the join matches (window, length, prefix)."""
    n = names.withColumn("clean", clean_tab_name("name")).filter(F.col("clean") != "")
    n = n.select("window_id", "name_idx",
                 F.least(F.length("clean"), F.lit(name_prefix)).alias("plen"),
                 F.substring("clean", 1, name_prefix).alias("prefix"))
    t = texts.filter(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("start", text_start("text", text_prefix))
    t = t.filter(F.length("start") > 0).select(
        "window_id", "text_idx", "start",
        F.explode(F.sequence(F.lit(1), F.least(F.length("start"), F.lit(name_prefix)))).alias("plen"))
    t = t.select("window_id", "text_idx", "plen", F.substring("start", 1, F.col("plen")).alias("prefix"))
    return n.join(t, ["window_id", "plen", "prefix"]).select("window_id", "name_idx", "text_idx")


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by window, name and text."""
    window, name, used, done = None, None, set(), False
    for batch in batches:
        out = []
        for w, n, t in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
            if w != window:
                window, name, used = w, None, set()
            if n is None:
                continue
            if n != name:
                name, done = n, False
            if not done and (t is None or t not in used):
                done = True
                if t is not None:
                    used.add(t)
                out.append((w, n, t))
        cols = zip(*out, strict=True) if out else [()] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=COLUMNS)


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one greedy assignment per window."""
    rows = pairs.select(*(F.col(c).cast("long").alias(c) for c in COLUMNS)).repartition("window_id")
    rows = rows.sortWithinPartitions("window_id", "name_idx", F.col("text_idx").asc_nulls_last())
    return rows.mapInArrow(_assign, "window_id long, name_idx long, text_idx long")


def coverage(names: DataFrame, texts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Windows, tabs, loaded texts, tabs with text (matched + orphan
    texts), unloaded names, characters and the coverage percentage."""
    loaded = texts.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    per_win = names.groupBy("window_id").agg(F.count(F.lit(1)).alias("tabs"))
    lw = texts.groupBy("window_id").agg(F.count(F.lit(1)).alias("loaded"))
    tw = loaded.groupBy("window_id").agg(F.count(F.lit(1)).alias("with_text"), F.sum(F.length("text")).alias("chars"))
    mw = assigned.groupBy("window_id").agg(F.count(F.lit(1)).alias("matched"))
    w = (per_win.join(lw, "window_id", "left").join(tw, "window_id", "left").join(mw, "window_id", "left")
         .na.fill(0, ["loaded", "with_text", "chars", "matched"]))
    tot = w.agg(F.count(F.lit(1)).alias("windows"), F.sum("tabs").alias("total_tabs"),
                F.sum("loaded").alias("loaded_tabs"), F.sum("with_text").alias("tabs_with_text"),
                F.sum(F.col("tabs") - F.col("matched")).alias("tabs_unloaded"), F.sum("chars").alias("total_chars"))
    return tot.withColumn("coverage_pct", F.round(F.col("tabs_with_text") / F.greatest(F.col("total_tabs"), F.lit(1))
                                                  * 100, 1))
