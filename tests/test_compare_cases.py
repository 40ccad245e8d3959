"""The reference's compare scenarios, restated on DataFrames."""

from pyspark.sql import functions as F

from docsift.operators.corpus import discover_sessions
from docsift.operators.index import index_stats, with_fingerprint
from docsift.operators.links import link_counts, matches_to_link, plan_links
from docsift.operators.matching import classify, compare_stats

HIST_SCHEMA = "path string, text string, session_id string, session_order int, ctime long"
NEW_SCHEMA = "path string, text string"


def _run(spark, hist_rows, new_rows, fuzzy="small"):
    h = spark.createDataFrame(hist_rows, HIST_SCHEMA)
    n = spark.createDataFrame(new_rows, NEW_SCHEMA)
    res = classify(n, h, fuzzy)
    stats = compare_stats(res).first().asDict()
    return res, stats


def _hist(session, order, files, t0=0):
    return [(f"{session}/window01/{name}", text, session, order, t0 + i) for i, (name, text) in enumerate(files)]


def test_exact_match(spark):
    hist = _hist("session-2026-01-01_00-00-00", 0,
                 [("tab01.txt", "shopping list\nmilk\neggs\n"), ("tab02.txt", "meeting notes\n")])
    new = [("new/tab01.txt", "shopping list\r\nmilk\r\neggs"), ("new/tab02.txt", "brand new content")]
    res, stats = _run(spark, hist, new, fuzzy="none")
    assert (stats["exact_count"], stats["new_count"]) == (1, 1)
    row = res.filter("status = 'exact'").first()
    assert row.char_diff == 0 and row.canonical_path.endswith("tab01.txt")


def test_near_match(spark):
    note = ("Meeting with the design team on Tuesday at 10am.\nDiscuss the new landing page, the "
            "colour palette and the onboarding copy.\nBring the printed mockups.")
    hist = _hist("nc-2026-01-01__00-00-00", 0, [("tab01.txt", note)])
    new = [("new/tab01.txt", note.replace("Tuesday", "Wednesday"))]
    res, stats = _run(spark, hist, new)
    assert stats["near_count"] == 1
    row = res.first()
    assert 0 < row.char_diff <= 5


def test_no_match(spark):
    hist = _hist("nc-2026-01-01__00-00-00", 0, [("tab01.txt", "The quick brown fox jumps over the lazy dog.")])
    res, stats = _run(spark, hist, [("new/tab01.txt", "Completely unrelated text about quantum physics.")])
    assert stats["new_count"] == 1


def test_empty_files_skipped(spark):
    hist = _hist("nc-2026-01-01__00-00-00", 0, [("tab01.txt", "x")])
    res, stats = _run(spark, hist, [("new/a.txt", ""), ("new/b.txt", "   \n\n")])
    assert stats["skipped_count"] == 2


def test_multi_session(spark):
    hist = (_hist("nc-2026-01-01__00-00-00", 1, [("tab01.txt", "first session note")])
            + _hist("nc-2026-02-01__00-00-00", 0, [("tab01.txt", "second session note")], t0=10))
    new = [("new/1.txt", "first session note"), ("new/2.txt", "second session note"),
           ("new/3.txt", "a completely new idea")]
    _, stats = _run(spark, hist, new, fuzzy="none")
    assert (stats["exact_count"], stats["new_count"]) == (2, 1)


def test_tiny_file_rejects_large_diff(spark):
    hist = _hist("session-2026-01-01_00-00-00", 0, [("tab01.txt", "short original text")])
    _, stats = _run(spark, hist, [("new/tab01.txt", "XXXXX XXXXXXXX XXXX")])
    assert stats["near_count"] == 0 and stats["new_count"] == 1


def test_canonical_is_oldest_then_organized(spark):
    text = "same text everywhere"
    hist = [("s1/window01/a.txt", text, "s1", 0, 5), ("s2/organized/x/b.txt", text, "s2", 1, 5),
            ("s3/window01/c.txt", text, "s3", 2, 9)]
    res, _ = _run(spark, hist, [("new/a.txt", text)])
    assert res.first().canonical_path == "s2/organized/x/b.txt"


def test_discovery_formats_and_false_positives(spark):
    files = [("/base/session-2026-01-01_00-00-00/manifest.json",),
             ("/base/session-2026-01-01_00-00-00/window01/tab01.txt",),
             ("/base/session-2026-01-02/manifest.json",),
             ("/base/nc-2026-01-03__00-00-00/manifest.json",),
             ("/base/nc-2026-01-04__00-00-00/manifest.json",),
             ("/base/nc-backups/x.txt",), ("/base/nc-scratch/y.txt",), ("/base/nc-old-stuff/z.txt",)]
    listing = spark.createDataFrame(files, "path string")
    dirs = spark.createDataFrame([(0, "/base"), (1, "/base")], "pos int, dir string")
    got = discover_sessions(listing, dirs)
    assert got.count() == 4
    only_real = discover_sessions(listing.filter(~F.col("path").contains("-01-0")), dirs)
    assert only_real.count() == 0


def test_index_stats_and_links(spark):
    hist = _hist("nc-2026-01-01__00-00-00", 0, [("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")])
    h = spark.createDataFrame(hist, HIST_SCHEMA)
    st = index_stats(with_fingerprint(h)).first()
    assert (st.indexed_files, st.unique_hashes) == (3, 2)
    res, _ = _run(spark, hist, [("new/a.txt", "one")], fuzzy="none")
    inv = h.select("path")
    links = plan_links(matches_to_link(res), inv, "symlink")
    row = links.first()
    assert row.success and row.backup_path == "new/a.txt.orig"
    counts = link_counts(links).first()
    assert (counts.link_count, counts.error_count) == (1, 0)
    bad = plan_links(matches_to_link(res), inv, "teleport").first()
    assert not bad.success and bad.error == "Unknown strategy: teleport"
