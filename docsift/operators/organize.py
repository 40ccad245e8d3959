"""Category plans applied to a document inventory (E3) and the organised-link
split / rejoin: P15, P16, P17, J9, J10, J11, A6, A7, L3.

A plan is raw model output text; parsing is a batch column job (no driver
loop). The model call itself is outside this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import category_of_path
from ..functions.text import pystrip

PLAN_ENTRY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("new_name", T.StringType()),
    T.StructField("reason", T.StringType()),
])
PLAN_SCHEMA = T.ArrayType(PLAN_ENTRY)
DEFAULT_CATEGORY = "misc"
FENCE = "```"


def _strip_fence(text) -> F.Column:
    """Drop a leading code fence line, and the last line when it is only a
    fence; strip the rest."""
    lines = F.split(text, "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    last_is_fence = pystrip(F.try_element_at(body, F.lit(-1))) == FENCE
    body = F.when((F.size(body) > 0) & last_is_fence,
                  F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return pystrip(F.array_join(body, "\n"))


def parse_plan(raw) -> F.Column:
    """Plan text → array<struct<source, category, new_name, reason>>.

    The whole text must parse as JSON; an array is the plan, any other JSON
    value gives null. When it does not parse, the span from the first '[' to
    the last ']' is tried instead."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    t0 = pystrip(raw)
    text = F.when(t0.startswith(FENCE), _strip_fence(t0)).otherwise(t0)
    valid = F.try_parse_json(text).isNotNull()
    start = F.instr(text, "[")
    end = F.length(text) - F.instr(F.reverse(text), "]") + 1
    span = F.when((start > 0) & (F.instr(text, "]") > 0) & (end > start),
                  F.substring(text, start, end - start + 1))
    return (
        F.when(valid & text.startswith("["), F.from_json(text, PLAN_SCHEMA))
        .when(~valid & span.isNotNull() & F.try_parse_json(span).isNotNull(), F.from_json(span, PLAN_SCHEMA))
    )


def plan_entries(plans: DataFrame, raw_col: str = "raw", keys: tuple = ("session_id", "plan_id")) -> DataFrame:
    """Explode parsed plans to one row per entry with P15 defaults applied."""
    p = plans.select(*keys, F.posexplode(parse_plan(raw_col)).alias("pos", "e"))
    source = F.coalesce(F.col("e.source"), F.lit(""))
    return p.select(
        *keys, "pos",
        source.alias("source"),
        F.coalesce(F.col("e.category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.nullif(F.col("e.new_name"), F.lit("")), F.translate(source, "/\\", "__")).alias("new_name"),
        F.coalesce(F.col("e.reason"), F.lit("")).alias("reason"),
    )


def apply_plan(entries: DataFrame, inventory: DataFrame, linked: DataFrame) -> DataFrame:
    """Action per plan entry.

    ``inventory``: session_id, rel_path (files present in the session);
    ``linked``: session_id, rel_path, canonical_path (successful dedup links
    whose canonical exists). Action: 'error' when the source is missing,
    'link' when it is a linked duplicate, else 'copy'. Destination is
    category/new_name; ``collision`` marks destinations used more than once.
    """
    inv = inventory.select("session_id", F.col("rel_path").alias("source")).withColumn("_exists", F.lit(True))
    lk = linked.select("session_id", F.col("rel_path").alias("source"), "canonical_path")
    e = entries.join(inv, ["session_id", "source"], "left").join(lk, ["session_id", "source"], "left")
    action = (
        F.when(F.col("_exists").isNull(), F.lit("error"))
        .when(F.col("canonical_path").isNotNull(), F.lit("link"))
        .otherwise(F.lit("copy"))
    )
    dest = F.concat(F.col("category"), F.lit("/"), F.col("new_name"))
    out = e.withColumn("action", action).withColumn("destination", F.when(action != "error", dest))
    dup = (out.filter(F.col("destination").isNotNull()).groupBy("session_id", "destination")
           .agg(F.count(F.lit(1)).alias("_uses")))
    out = out.join(dup, ["session_id", "destination"], "left")
    return out.select(
        "session_id", "plan_id", "pos", "source", "category", "new_name", "reason", "action", "destination",
        F.when(F.col("action") == "link", F.col("canonical_path")).alias("canonical_path"),
        F.coalesce(F.col("_uses") > 1, F.lit(False)).alias("collision"),
    )


def organize_stats(applied: DataFrame) -> DataFrame:
    """Copied / linked / errors per session."""
    a = F.col("action")
    return applied.groupBy("session_id").agg(
        F.count_if(a == "copy").alias("copied"),
        F.count_if(a == "link").alias("linked"),
        F.count_if(a == "error").alias("errors"),
    )


def category_summary(applied: DataFrame) -> DataFrame:
    """Files per category (successful entries), with the first and last
    name in sorted order; the full sorted listing is ``category_files``."""
    ok = applied.filter(F.col("action") != "error")
    return ok.groupBy("session_id", "category").agg(
        F.count(F.lit(1)).alias("files"),
        F.min("new_name").alias("first_file"),
        F.max("new_name").alias("last_file"),
    )


def category_files(applied: DataFrame) -> DataFrame:
    """A6 listing: one row per organised file, to be written sorted."""
    return applied.filter(F.col("action") != "error").select("session_id", "category", "new_name")


def reference_names(linked: DataFrame) -> DataFrame:
    """L3: distinct 'category/name' of canonical paths in a link map."""
    return linked.select("session_id", category_of_path("canonical_path").alias("reference")).distinct()


def prompt_context(manifest_totals: DataFrame, refs: DataFrame) -> DataFrame:
    """Per session the counts (thousands separators) and the sorted
    reference list rendered as prompt text. The list is per session and
    bounded by the session's links."""
    r = refs.groupBy("session_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("- "), F.col("reference")))), "\n").alias("refs"))
    m = manifest_totals.join(r, "session_id", "left")
    return m.select(
        "session_id",
        F.col("window_count").cast("string").alias("window_count"),
        F.col("tab_count").cast("string").alias("tab_count"),
        F.format_number(F.col("total_chars"), 0).alias("total_chars"),
        F.coalesce(F.col("refs"), F.lit("")).alias("reference_list"),
    )


def separate_links(organized: DataFrame, organized_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split organised files into links and real files.

    ``organized``: session_id, rel_path; ``organized_links``: session_id,
    rel_path, canonical, link_type. Names starting '_' are metadata and
    skipped. Returns (links, real)."""
    files = organized.filter(~F.element_at(F.split("rel_path", "/"), -1).startswith("_"))
    flagged = files.join(organized_links.select("session_id", "rel_path", "canonical", "link_type")
                         .withColumn("_is_link", F.lit(True)), ["session_id", "rel_path"], "left")
    links = flagged.filter(F.col("_is_link").isNotNull()).drop("_is_link")
    real = flagged.filter(F.col("_is_link").isNull()).select("session_id", "rel_path")
    return links, real


def join_links(real: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put link rows back unless their destination already exists.
    Returns (rejoined organised files, skipped link rows)."""
    back = links.join(real, ["session_id", "rel_path"], "left_anti")
    skipped = links.join(real, ["session_id", "rel_path"], "left_semi")
    rejoined = real.withColumn("is_link", F.lit(False)).unionByName(
        back.select("session_id", "rel_path").withColumn("is_link", F.lit(True)))
    return rejoined, skipped
