"""Daily-history jobs: traffic merge (J13), backfill (J14), date union (U3),
tracking summary (A12) and the recently-used list (W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MRU_DEPTH = 10
# The fields of a stored history row, in their order.
HISTORY_FIELDS = ["date", "capturedAt", "clones", "downloads", "views", "total", "ciCheckouts",
                  "organicClones", "stars", "forks", "openIssues", "uniqueClones", "uniqueViews", "ciRuns",
                  "organicUniqueClones"]


def merge_traffic(clones: DataFrame, views: DataFrame) -> DataFrame:
    """Full outer join of daily clones and views by date, zero-filled.
    Inputs: timestamp, count, uniques."""
    c = clones.select("timestamp", F.col("count").alias("clones"), F.col("uniques").alias("clone_uniques"))
    v = views.select("timestamp", F.col("count").alias("views"), F.col("uniques").alias("view_uniques"))
    j = c.join(v, "timestamp", "full_outer")
    return j.select(F.col("timestamp").alias("date"),
                    *[F.coalesce(F.col(k), F.lit(0)).cast("int").alias(k)
                      for k in ["clones", "clone_uniques", "views", "view_uniques"]])


def date_union(clones: DataFrame, views: DataFrame) -> DataFrame:
    """Distinct dates of either series."""
    return clones.select(F.col("timestamp").alias("date")).union(
        views.select(F.col("timestamp").alias("date"))).distinct()


def backfill(history: DataFrame, merged: DataFrame) -> DataFrame:
    """Add a history row for every merged date not already present;
    derived fields: total = clones + views, organic = clones, zeros for the
    counters the traffic feed does not have."""
    missing = merged.join(history.select("date"), "date", "left_anti")
    z = F.lit(0).cast("int")
    added = missing.select(
        "date", F.col("date").alias("capturedAt"), F.col("clones"), z.alias("downloads"), F.col("views"),
        (F.col("clones") + F.col("views")).cast("int").alias("total"), z.alias("ciCheckouts"),
        F.col("clones").alias("organicClones"), z.alias("stars"), z.alias("forks"), z.alias("openIssues"),
        F.col("clone_uniques").alias("uniqueClones"), F.col("view_uniques").alias("uniqueViews"),
        z.alias("ciRuns"), F.col("clone_uniques").alias("organicUniqueClones"))
    return history.select(*HISTORY_FIELDS).withColumn("added", F.lit(False)).unionByName(
        added.withColumn("added", F.lit(True)))


def tracking_summary(history: DataFrame) -> DataFrame:
    """First tracked day, number of days, number added."""
    return history.agg(F.min("date").alias("tracking_since"), F.count(F.lit(1)).alias("days"),
                       F.count_if(F.col("added")).alias("added_days"))


def recent_items(pushes: DataFrame, depth: int = DEFAULT_MRU_DEPTH) -> DataFrame:
    """Per owner the most recent ``depth`` distinct items, most recent
    first (re-pushing an item moves it to the front). ``pushes``: owner,
    item, ts, seq (tie-break for equal ts)."""
    last = pushes.groupBy("owner", "item").agg(F.max(F.struct("ts", "seq")).alias("_l"))
    w = Window.partitionBy("owner").orderBy(F.col("_l").desc())
    # row_number + filter is planned as a window group limit (partial top-k).
    return (last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth)
            .select("owner", "rank", "item", F.col("_l.ts").alias("last_ts")))


def nth_recent(recent: DataFrame, k: int) -> DataFrame:
    return recent.filter(F.col("rank") == k).select("owner", "item")
