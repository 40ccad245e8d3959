"""ST2 against a changing index, ST3 with merged deltas."""

import os

from docsift.functions.text import content_hash
from docsift.sources.results import write_version
from docsift.streaming import dedup_stream as D

SCHEMA = "path string, text string, mtime double, size long"


def hashes(spark, pairs):
    df = spark.createDataFrame(pairs, "path string, text string")
    return {(r.path, r.h) for r in df.select("path", content_hash("text").alias("h")).collect()}


def stored(spark, root):
    return {(r.path, r.sha256) for r in D.load_upserted(spark, root).collect()}


def test_merge_keeps_rows_and_bounds_files(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert D.load_upserted(spark, root).count() == 0 and D.merge_upserted(spark, root) == -1
    batches = [spark.createDataFrame([(f"p{i % 3}", f"text {i}", float(i), 1), ("late", f"l{i}", 9.0 - i, 1)], SCHEMA) for i in range(4)]
    for i in range(3):
        D.upsert_batch(batches[i], root, i)
    before = stored(spark, root)
    assert D.merge_upserted(spark, root) == 2 and stored(spark, root) == before
    assert not [x for x in os.listdir(root) if x.startswith("batch=")]
    D.upsert_batch(batches[1], root, 1)  # replayed after the merge
    assert stored(spark, root) == before and D.merge_upserted(spark, root) == 2
    D.upsert_batch(batches[3], root, 3)
    D.upsert_batch(batches[3], root, 3)
    want = hashes(spark, [("p0", "text 3"), ("p1", "text 1"), ("p2", "text 2"), ("late", "l0")])
    assert stored(spark, root) == want
    # cut short before it was published, then repeated
    D._stored(spark, root).write.parquet(f"{root}-base/v=4")
    assert stored(spark, root) == want and D.merge_upserted(spark, root) == 3 and stored(spark, root) == want


def test_each_batch_meets_the_published_index(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    index = lambda *texts: spark.createDataFrame([(t, f"old/{t}", "s") for t in texts], "t string, canonical_path string, canonical_session string").select(content_hash("t").alias("content_hash"), "canonical_path", "canonical_session")

    def arrive(name, *texts):
        spark.createDataFrame([(f"{name}/{t}", t) for t in texts], "path string, text string").coalesce(1).write.mode("append").parquet(at("in"))
        s = D.file_stream(spark, at("in"), "path string, text string")
        D.compare_latest(s, at("index"), at("out"), at("ckpt")).trigger(availableNow=True).start().awaitTermination()
        return {(r.path, r.status, r.index_version) for r in spark.read.parquet(at("out")).collect()}

    one = arrive("a", "x", "y", " ")
    assert one == {("a/x", "new", None), ("a/y", "new", None), ("a/ ", "skipped", None)}
    write_version(index("x"), at("index"))
    two = one | {("b/x", "exact", 1), ("b/y", "new", 1)}
    assert arrive("b", "x", "y") == two
    write_version(index("x", "y"), at("index"))
    assert arrive("c", "y") == two | {("c/y", "exact", 2)}
