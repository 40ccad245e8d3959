"""Remaining cases of the reference's test suite, restated on DataFrames."""

import json

from pyspark.sql import functions as F

from docsift.operators.corpus import incremental_hashes
from docsift.operators.history import nth_recent, recent_items
from docsift.operators.linediff import unified_diffs
from docsift.operators.links import descriptor_json, link_descriptors, plan_links


def test_unified_diff_marks_changed_line(spark):
    pairs = spark.createDataFrame([("a.txt", "b.txt", "line 1\nline 2\nline 3", "line 1\nline 2 modified\nline 3")],
                                  "new_path string, canonical_path string, new_text string, canonical_text string")
    lines = [r.line for r in unified_diffs(pairs).orderBy("seq").collect()]
    text = "".join(lines)
    assert "-line 2\n" in text and "+line 2 modified\n" in text


def test_descriptor_fields(spark):
    matches = spark.createDataFrame([("new/a.txt", "old/b.txt", "exact", 0, "h")],
                                    "new_path string, canonical_path string, match_type string, char_diff int, "
                                    "canonical_hash string")
    inv = spark.createDataFrame([("old/b.txt", 12, 5)], "path string, size long, ctime long")
    links = plan_links(matches, inv, "descriptor")
    d = json.loads(descriptor_json(link_descriptors(links, inv, matches)).first().descriptor)
    assert d["schema_version"] == 1
    assert d["link"]["original_path"] == "new/a.txt" and d["target"]["exists"] and d["target"]["size"] == 12
    assert d["target"]["extension"] == ".txt" and d["context"]["reason"] == "dedup_exact_match"


def test_recent_items_cap_and_repush(spark):
    pushes = [("u", f"item{i}", i, i) for i in range(1, 6)]                       # push 1..5
    df = spark.createDataFrame(pushes, "owner string, item string, ts long, seq long")
    got = [r.item for r in recent_items(df, depth=3).orderBy("rank").collect()]
    assert got == ["item5", "item4", "item3"]
    again = spark.createDataFrame(pushes + [("u", "item2", 6, 6)], "owner string, item string, ts long, seq long")
    got = [r.item for r in recent_items(again, depth=3).orderBy("rank").collect()]
    assert got == ["item2", "item5", "item4"]                                       # moved to front, no duplicate
    assert nth_recent(recent_items(again, depth=3), 2).first().item == "item5"


def test_hash_cache_builds_same_index_twice(spark):
    files = spark.createDataFrame([("s/a.txt", 1.0, 3, "abc"), ("s/b.txt", 2.0, 3, "xyz")],
                                  "path string, mtime double, size long, text string")
    hasher = lambda d: d.withColumn("sha256", F.sha2("text", 256))
    empty = spark.createDataFrame([], "path string, sha256 string, mtime double, size long")
    first = incremental_hashes(empty, files, hasher)
    assert {r.source for r in first.collect()} == {"hashed"}
    second = incremental_hashes(first.drop("source"), files, hasher)
    assert {r.source for r in second.collect()} == {"cache"}
    assert sorted((r.path, r.sha256) for r in first.collect()) == sorted((r.path, r.sha256) for r in second.collect())


def test_unified_diff_udtf_in_sql(spark):
    from docsift.functions.chardiff import unified_diff_udtf

    spark.udtf.register("unified_diff", unified_diff_udtf())
    spark.createDataFrame([("a", "b", "line 1\nline 2\nline 3", "line 1\nline 2 modified\nline 3")],
                          "np string, cp string, x string, y string").createOrReplaceTempView("diff_pairs")
    lines = [r.line for r in spark.sql(
        "SELECT d.seq, d.line FROM diff_pairs p, LATERAL unified_diff(p.x, p.y, p.np, p.cp, 3) d "
        "ORDER BY d.seq").collect()]
    assert "-line 2\n" in lines and "+line 2 modified\n" in lines
