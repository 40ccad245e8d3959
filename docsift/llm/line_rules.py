"""Quality rules: text measures and cross-document line frequency, in
DataFrame functions only.

Lines are compared after lower-casing and squeezing white space. A line that
stands in more than ``LINE_DOCS`` documents of a host, and in more than
``LINE_SHARE`` of the host's documents, is boilerplate of that host and counts
as removed. A document is depleted if less than ``LEFT_SHARE`` of the
characters of its lines is left. Both limits are shares or small constants, so
the rule is the same at any size.

One pass over the texts writes the measures and the line hashes of every
document; all that is shuffled afterwards are hashes and counts. A line in a
third of all documents is counted by partial aggregation, and the join that
marks it has one row per line on its small side.

Defined results: a null text has no words and fails the base rules, as an empty
one does; rows without a host share one; repeated rows (same id and text) count
as one document and each get the result; a document without lines is not
depleted; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, prepare, row_key

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 5
LINE_DOCS = 10
LINE_SHARE = 0.01
LEFT_SHARE = 0.5


def split_words(text: Column) -> Column:
    """The runs of anything but the six ASCII white-space characters."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _covered(windows: Column, n: int = REPEAT_WORDS) -> Column:
    """Words in windows of ``n`` words found twice or more, from the sorted
    (hash, start) pairs of all windows."""
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    size = F.greatest(F.size(windows), F.lit(1))
    rows = F.arrays_zip(windows.alias("w"), F.slice(windows, 2, size).alias("after"), F.concat(nothing, windows).alias("before"))
    same = lambda r, side: F.coalesce(r["w"]["h"] == r[side]["h"], F.lit(False))  # noqa: E731 - false beyond either end
    twice = F.filter(rows, lambda r: same(r, "after") | same(r, "before"))
    starts = F.sort_array(F.transform(twice, lambda r: r["w"]["i"]))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        return F.struct((s + n).alias("end"), (acc["n"] + s + n - F.greatest(acc["end"], s)).alias("n"))

    return F.aggregate(starts, begin, step, lambda acc: acc["n"])


def measures(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, host``, the base measures and ``lines``, an array of
    (hash, characters) of the normalised lines."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))
    df = df.withColumn("hashes", F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", gram_hashes(F.col("hashes"), REPEAT_WORDS))
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("windows", F.when(repeated, F.sort_array(placed)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    df = df.withColumn("raw", F.transform(lines, lambda x: F.xxhash64(x)))
    squeezed = F.transform(F.split(F.lower("text"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t-\r]+", " ")))
    shown = F.filter(squeezed, lambda x: x != "")
    bare = F.translate("text", SPACE, "")
    return df.select(
        "k1",
        "k2",
        "doc_id",
        "host",
        F.size("hashes").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("windows")), F.lit(0)).alias("n_repeat_words"),
        F.transform(shown, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).cast("long").alias("c"))).alias("lines"),
    )


def line_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the measures, ``base_failed``,
    ``kept`` and ``removed_share`` (of the characters of its lines)."""
    scratch = Scratch(prepare(docs.sparkSession), "lines")
    facts = scratch.table(measures(docs), "facts")
    one = facts.dropDuplicates(["k1", "k2"]).select("k1", "k2", "host", F.inline("lines"))
    lines = scratch.table(one.groupBy("host", "h", "k1", "k2").agg(F.sum("c").alias("c")), "lines")
    size = facts.select("host", "k1", "k2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    often = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LINE_DOCS)
    often = often.join(size, "host").filter(F.col("n") > LINE_SHARE * F.col("host_docs")).select("host", "h", F.lit(True).alias("often"))
    marked = lines.join(scratch.table(often, "often"), ["host", "h"], "left")
    share = marked.groupBy("k1", "k2").agg((F.sum(F.when(F.col("often"), F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))
    out = facts.drop("lines").join(share, ["k1", "k2"], "left").withColumn("removed_share", F.coalesce("share", F.lit(0.0)))
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    failed = (F.col("n_words") < MIN_WORDS) | repeats
    kept = ~failed & (1 - F.col("removed_share") >= LEFT_SHARE)
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *measured, failed.alias("base_failed"), kept.alias("kept"), "removed_share")
