"""Edge cases: distributed numbering, empty sides."""

from pyspark.sql import functions as F

from docsift.operators.matching import classify, compare_stats
from docsift.operators.ordering import sequence_number


def test_sequence_number_is_contiguous_and_ordered(spark):
    df = spark.range(0, 20000).select((F.col("id") * 7919 % 20000).alias("k"), F.col("id").alias("v"))
    got = sequence_number(df, ["k"], "seq", partitions=13).select("k", "seq").collect()
    pairs = sorted((r.k, r.seq) for r in got)
    assert [s for _, s in pairs] == list(range(1, 20001))


def test_classify_with_empty_sides(spark):
    hist = spark.createDataFrame([], "path string, text string, session_id string, session_order int, ctime long")
    new = spark.createDataFrame([("n/a.txt", "hello"), ("n/b.txt", "  ")], "path string, text string")
    st = compare_stats(classify(new, hist, "small")).first()
    assert (st.total_scanned, st.new_count, st.skipped_count) == (2, 1, 1)
    none = spark.createDataFrame([], "path string, text string")
    hist2 = spark.createDataFrame([("s/a.txt", "hello", "s", 0, 1)],
                                  "path string, text string, session_id string, session_order int, ctime long")
    assert classify(none, hist2, "small").count() == 0


def test_hot_hash_group(spark):
    """A third of the history shares one text (a hot hash), and many new
    documents are copies of it: one canonical, all exact, nothing dropped."""
    hot = "the same boilerplate note\n"
    rows = [(f"s{i % 7}/window01/t{i}.txt", hot if i % 3 == 0 else f"note number {i} about item {i * 7}",
             f"s{i % 7}", -(i % 7), i) for i in range(3000)]
    hist = spark.createDataFrame(rows, "path string, text string, session_id string, session_order int, ctime long")
    new = spark.createDataFrame([(f"n/c{i}.txt", hot) for i in range(500)] + [("n/x.txt", "note number 5 about item 36")],
                                "path string, text string")
    res = classify(new, hist, "small")
    st = compare_stats(res).first()
    assert (st.total_scanned, st.exact_count) == (501, 500)
    assert res.filter("status = 'exact'").select("canonical_path").distinct().first()[0] == "s0/window01/t0.txt"
    near = res.filter("new_path = 'n/x.txt'").first()
    assert near.status == "near" and near.canonical_path == "s5/window01/t5.txt"


def test_spread_leaves_large_inputs_alone(spark):
    from docsift.sources.tables import spread

    target = 2 * spark.sparkContext.defaultParallelism
    big = spark.range(0, 10000, numPartitions=target * 4)
    assert spread(big) is big
    small = spark.range(0, 100, numPartitions=1)
    spread_small = spread(small)
    assert spread_small is not small and spread_small.rdd.getNumPartitions() == target
    assert sorted(r.id for r in spread_small.collect()) == list(range(100))


def test_sequence_number_with_extra_columns(spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    out = sequence_number(df, ["k"], "n", partitions=16)
    got = out.agg(F.count("n"), F.countDistinct("n"), F.max("n"), F.min("n"), F.countDistinct("x")).first()
    assert tuple(got) == (300_000, 300_000, 300_000, 1, 300_000)
    first = out.orderBy("n").select("k").limit(1000).collect()
    assert [r.k for r in first] == sorted(r.k for r in first)


def test_white_space_runs_are_linear(spark):
    import time

    from docsift.functions import text as T

    text = "a" + " " * 400_000 + "x" + "\n" * 200_000 + "y" + "\t" * 200_000
    df = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    row = df.select(T.normalize_text("t").alias("n"), T.capture_key("t").alias("k"), T.pystrip("t").alias("s")).first()
    assert time.time() - began < 20
    assert row.n == text.rstrip("\t") and row.k == row.n and row.s == text.strip()


def test_later_link_of_a_path_wins(spark, tmp_path):
    from docsift.operators import links as L
    from docsift.sources import results as R

    rows = [(i, f"p{i % 50}", f"c{i}", "symlink", True, None, None) for i in range(5000)]
    df = spark.createDataFrame(rows, "seq long, new_path string, canonical_path string, link_type string, success boolean, error string, backup_path string")
    R.write_link_manifest(df.repartition(9), str(tmp_path))
    got = {r.new_path: r.canonical_path for r in L.linked_paths(R.load_link_manifest(spark, str(tmp_path))).collect()}
    assert got == {f"p{k}": f"c{4950 + k}" for k in range(50)}


def test_index_scope_of_absolute_paths(spark):
    from docsift.operators.index import index_scope

    rows = [("s", "/archive/r1/nc-2024-01-02__09/organized/a/x.txt"), ("s", "/archive/r1/nc-2024-01-02__09/window01/y.txt")]
    kept = index_scope(spark.createDataFrame(rows, "session_id string, path string")).collect()
    assert [r.path for r in kept] == [rows[0][1]]


def test_a_path_in_two_versions(spark):
    from docsift.operators.matching import classify

    old = "the quick brown fox jumps over the lazy dog again and again " * 3
    hist = spark.createDataFrame([("h/a.txt", old, "nc-2024-01-01", -1, 1), ("h/a.txt", old[::-1], "nc-2024-01-01", -1, 2)],
                                 "path string, text string, session_id string, session_order int, ctime long")
    new = spark.createDataFrame([("n/b.txt", old.replace("lazy", "lazi", 1))], "path string, text string")
    row = classify(new, hist, fuzzy="all").first()
    from docsift.functions.text import content_hash

    want = hist.filter(F.col("ctime") == 1).select(content_hash("text").alias("h")).first().h
    assert row.status == "near" and row.canonical_hash == want


def test_replayed_batch_of_the_upsert(spark, tmp_path):
    from docsift.functions.text import content_hash
    from docsift.streaming import dedup_stream as D

    root, schema = str(tmp_path / "cache"), "path string, text string, mtime double, size long"
    one = spark.createDataFrame([("a", "old", 1.0, 3), ("a", "older", 0.5, 5), ("b", "kept", 1.0, 4)], schema)
    two = spark.createDataFrame([("a", "new", 2.0, 3), ("b", "late", 0.1, 4)], schema)
    for batch, at in ((one, 0), (two, 1), (two, 1)):
        D.upsert_batch(batch, root, at)
    want = spark.createDataFrame([("a", "new"), ("b", "kept")], "path string, text string").select("path", content_hash("text").alias("sha256"))
    assert set(D.load_upserted(spark, root).select("path", "sha256").collect()) == set(want.collect())


def test_every_given_text_reaches_the_queries_whole(spark):
    from docsift.sources.tables import capture_tabs, inventory, table

    sf = "/root/testdata/sf0.01"
    tabs = capture_tabs(spark, sf).select(F.col("window_id").alias("conv_id"), "turn", "text")
    given = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    assert given.exceptAll(tabs).count() == 0
    plain = lambda c: F.regexp_replace(c, r"\s+", "")  # noqa: E731 - captures change line ends and trailing blanks only
    docs = table(spark, sf, "documents").select("doc_id", plain("text").alias("t"))
    assert docs.exceptAll(inventory(spark, sf).select("doc_id", plain("text").alias("t"))).count() == 0


def test_near_join_takes_timestamps_as_age(spark):
    import datetime

    rows = [("h/a.txt", "some text", "s", 0, datetime.datetime(2024, 1, 2)), ("h/b.txt", "some text", "s", 0, datetime.datetime(2024, 1, 1))]
    hist = spark.createDataFrame(rows, "path string, text string, session_id string, session_order int, ctime timestamp")
    new = spark.createDataFrame([("n/a.txt", "some text")], "path string, text string")
    assert classify(new, hist, "none").first().canonical_path == "h/b.txt"
