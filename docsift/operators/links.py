"""Links from duplicates to their canonical copies, as tables (replaces
filesystem linking): U4, K1, S8, S10, S12, A5.

Nothing here touches a filesystem; ``link_type`` is a label and ``success``
is decided from the document inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, suffix
from .ordering import sequence_number

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
LINK_STRATEGIES = ["symlink", "hardlink", "descriptor", "auto"]
BACKUP_SUFFIX = ".orig"
DESCRIPTOR_SCHEMA_VERSION = 1
DESCRIPTOR_SUFFIX = ".link.json"
LINK_MANIFEST_VERSION = "1.0"
# ---------------------------------------------------------------------------

LINK_COLUMNS = ["new_path", "canonical_path", "link_type", "success", "error", "backup_path"]


def matches_to_link(result: DataFrame, include_near: bool = False) -> DataFrame:
    """U4: exact matches, plus near ones when asked."""
    wanted = ["exact", "near"] if include_near else ["exact"]
    return result.filter(F.col("status").isin(wanted)).select(
        "new_path", "canonical_path", F.col("status").alias("match_type"), "char_diff", "canonical_hash")


def plan_links(matches: DataFrame, inventory: DataFrame, strategy: str = "symlink",
               backup: bool = True) -> DataFrame:
    """K1: one link row per match.

    Success needs a known strategy and a canonical file that is present in
    the inventory; 'auto' resolves to 'symlink' (the non-desktop choice).
    """
    resolved = "symlink" if strategy == "auto" else strategy
    known = resolved in ("symlink", "hardlink", "descriptor")
    present = inventory.select(F.col("path").alias("canonical_path")).distinct().withColumn("_present", F.lit(True))
    m = matches.join(present, "canonical_path", "left")
    ok = F.lit(known) & F.coalesce(F.col("_present"), F.lit(False))
    err = (F.lit(f"Unknown strategy: {resolved}") if not known else
           F.when(~ok, F.concat(F.lit("Target missing: "), F.col("canonical_path"))))
    return m.select(
        "new_path", "canonical_path",
        F.lit(resolved).alias("link_type"),
        ok.alias("success"),
        err.cast("string").alias("error"),
        (F.concat(F.col("new_path"), F.lit(BACKUP_SUFFIX)) if backup else F.lit(None).cast("string")).alias("backup_path"),
    )


def link_counts(links: DataFrame) -> DataFrame:
    """A5: successes and failures per link type."""
    return links.groupBy("link_type").agg(
        F.count_if(F.col("success")).alias("link_count"),
        F.count_if(~F.col("success")).alias("error_count"),
    )


def linked_paths(links: DataFrame) -> DataFrame:
    """S8 read side: successful links as new_path → canonical_path; when a
    path appears twice the later entry wins (``seq`` order when present)."""
    ok = links.filter(F.col("success"))
    if "seq" in ok.columns:
        last = ok.groupBy("new_path").agg(F.max(F.struct("seq", "canonical_path")).alias("_l"))
        return last.select("new_path", F.col("_l.canonical_path").alias("canonical_path"))
    return ok.select("new_path", "canonical_path").dropDuplicates(["new_path"])


def link_descriptors(links: DataFrame, inventory: DataFrame, matches: DataFrame) -> DataFrame:
    """Descriptor fields per link (clock fields omitted): the link, the
    target's presence, size, extension and creation time, and the reason."""
    inv = inventory.select(F.col("path").alias("canonical_path"), F.col("size").alias("target_size"),
                           F.col("ctime").alias("target_ctime"))
    reasons = matches.select("new_path", F.concat(F.lit("dedup_"), F.col("match_type"), F.lit("_match")).alias("reason"))
    d = links.join(inv, "canonical_path", "left").join(reasons, "new_path", "left")
    return d.select(
        F.concat(F.col("new_path"), F.lit(DESCRIPTOR_SUFFIX)).alias("descriptor_path"),
        F.lit(DESCRIPTOR_SCHEMA_VERSION).alias("schema_version"),
        F.col("new_path").alias("original_path"),
        F.col("canonical_path").alias("target_path"),
        F.lit("descriptor").alias("link_type"),
        F.col("target_size").isNotNull().alias("target_exists"),
        F.coalesce(F.col("target_size"), F.lit(0)).cast("long").alias("target_size"),
        suffix("canonical_path").alias("target_extension"),
        F.col("target_ctime").alias("target_created"),
        "reason",
    )


def descriptor_json(desc: DataFrame) -> DataFrame:
    """S10 sink form: the nested descriptor as JSON text."""
    body = F.struct(
        F.col("schema_version"),
        F.struct(F.col("original_path"), F.col("target_path"), F.lit("descriptor").alias("type"),
                 F.lit(False).alias("relative_path")).alias("link"),
        F.struct(F.col("target_exists").alias("exists"), F.lit("file").alias("type"),
                 F.col("target_size").alias("size"), F.col("target_extension").alias("extension"),
                 F.struct(F.col("target_created").alias("created")).alias("timestamps")).alias("target"),
        F.struct(F.lit("open").alias("default_mode")).alias("config"),
        F.struct(F.col("reason")).alias("context"),
    )
    return desc.select("descriptor_path", F.to_json(body).alias("descriptor"))


def review_list(result: DataFrame) -> DataFrame:
    """Numbered pair list, exact matches first, then near ones.

    pair_num runs through both groups; label is 'n: a = b (exact)' or
    'n: a ~ b (d chars diff)' with file names."""
    m = result.filter(F.col("status").isin("exact", "near")).select(
        "new_path", "canonical_path", "status", "char_diff",
        F.when(F.col("status") == "exact", F.lit(0)).otherwise(F.lit(1)).alias("_grp"))
    numbered = sequence_number(m, ["_grp", "new_path"], "pair_num")
    new_name, canon_name = basename("new_path"), basename("canonical_path")
    label = F.when(
        F.col("status") == "exact",
        F.format_string("%d: %s = %s (exact)", F.col("pair_num"), new_name, canon_name),
    ).otherwise(
        F.format_string("%d: %s ~ %s (%d chars diff)", F.col("pair_num"), new_name, canon_name, F.col("char_diff")))
    return numbered.select("pair_num", "new_path", "canonical_path", "status", label.alias("label"))
