"""Benchmark decontamination: containment search by size-partitioned MinHash,
in DataFrame functions only.

Texts are lower-cased words of letters and digits, in five-word shingles. A
test item is short and a document long, so what is asked is containment: which
share of the item's shingles the document has. The items are partitioned by
their number of shingles (powers of two). In each partition the MinHash sketch
of an item is its smallest shingle hashes, 16 at most; a document that has the
share c of the item has each sketch value with probability c. Documents probe
all their shingles against the sketches; a document is a candidate for an item
if it meets a quarter of the sketch and is long enough for the partition. At
containment 0.8 that loses one pair in four million (none among items of up to
16 shingles, whose sketch is whole). Candidates are verified by exact shingle
containment.

The items are worked off in blocks of a bounded number of shingles, so the
broadcast sketches and items are bounded too, whatever the benchmark's size.

An item of one to four words has one shingle, all its words, and is found in
every document with these words in a row.

Defined results: items without a word match nothing; null texts count as empty; repeated items and repeated documents
(same id and text) count once; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, id_of, keyed, prepare, row_key, whole_rows

SHINGLE = 5
CONTAINMENT = 0.8
SKETCH = 16
BLOCK_SHINGLES = 500_000


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def with_shingles(df: DataFrame, name: str = "shingles", n: int = SHINGLE) -> DataFrame:
    """Adds the distinct shingle hashes of ``text``. The word hashes are a
    column of their own first, so that each is computed once."""
    df = df.withColumn("word_hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return df.withColumn(name, F.array_distinct(gram_hashes(F.col("word_hashes"), n))).drop("word_hashes")


def _items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``i1, i2, shingles, q, sketch, need`` of every item with a shingle."""
    i1, i2 = row_key(F.col("item_id"), F.col("text"))
    items = benchmark.select(i1.alias("i1"), i2.alias("i2"), F.col("text").cast("string").alias("text")).dropDuplicates(["i1", "i2"])
    items = with_shingles(items).select("i1", "i2", "shingles", F.size("shingles").alias("q"))
    items = items.withColumn("sketch", F.slice(F.sort_array("shingles"), 1, SKETCH))
    items = items.withColumn("partition", F.ceil(F.log2(F.col("q").cast("double"))).cast("int"))
    return scratch.table(items.withColumn("need", F.ceil(F.size("sketch") / 4).cast("int")), "items").filter("q > 0")


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``k1, k2, i1, i2, containment`` for every document and item of which it
    holds at least that share."""
    scratch = Scratch(prepare(docs.sparkSession), "decontaminate")
    items = _items(benchmark, scratch)
    total = items.agg(F.sum("q")).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SHINGLES))
    found = None
    for b in range(blocks):
        block = items.filter(F.pmod("i2", F.lit(blocks)) == b)
        one = _matches(docs, block, containment, scratch, b)
        found = one if found is None else found.unionByName(one)
    return found.unionByName(_short_items(docs, benchmark, scratch))


def _short_items(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for items of fewer words than a shingle: these words in a row."""
    i1, i2 = row_key(F.col("item_id"), F.col("text"))
    items = benchmark.select(i1.alias("i1"), i2.alias("i2"), F.col("text").cast("string").alias("text")).dropDuplicates(["i1", "i2"])
    items = scratch.table(items.withColumn("n", F.size(words(F.col("text")))).filter((F.col("n") > 0) & (F.col("n") < SHINGLE)), "short")
    found = scratch.spark.createDataFrame([], "k1 long, k2 long, i1 long, i2 long, containment double")
    for r in items.groupBy("n").agg(F.count(F.lit(1)).alias("items")).orderBy("n").collect():  # four sizes at most
        blocks = math.ceil(r["items"] / BLOCK_SHINGLES)
        for b in range(blocks):
            block = items.filter((F.col("n") == r["n"]) & (F.pmod("i2", F.lit(blocks)) == b)).select("i1", "i2", "text")
            sought = with_shingles(block, n=r["n"]).select("i1", "i2", F.explode("shingles").alias("h"))
            probe = with_shingles(keyed(docs), n=r["n"]).select("k1", "k2", F.explode_outer("shingles").alias("h"))
            one = probe.join(F.broadcast(sought), "h").select("k1", "k2", "i1", "i2", F.lit(1.0).alias("containment")).distinct()
            found = found.unionByName(scratch.table(one, f"short{r['n']}_{b}"))
    return found


def _matches(docs, items, containment, scratch, b) -> DataFrame:
    smallest = F.floor(F.pow(F.lit(2.0), F.col("partition") - 1)) + 1  # item of the partition
    least = F.ceil(F.lit(containment) * smallest)
    sketch = items.select("i1", "i2", "need", least.alias("least"), F.explode("sketch").alias("h"))
    # explode, unlike explode_outer, would add a filter on the shingles and compute them twice
    probe = with_shingles(keyed(docs)).select("k1", "k2", F.size("shingles").alias("size"), F.explode_outer("shingles").alias("h"))
    hits = probe.join(F.broadcast(sketch), "h").filter(F.col("size") >= F.col("least"))
    hits = hits.groupBy("k1", "k2", "i1", "i2", "need").agg(F.count(F.lit(1)).alias("hits"))
    candidates = scratch.table(hits.filter("hits >= need").select("k1", "k2", "i1", "i2"), f"candidates{b}")
    having = candidates.select("k1", "k2").distinct()
    texts = with_shingles(keyed(docs).join(having, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "has").select("k1", "k2", "has")
    pairs = candidates.join(texts, ["k1", "k2"]).join(F.broadcast(items.select("i1", "i2", "q", "shingles")), ["i1", "i2"])
    share = F.size(F.array_intersect("shingles", "has")) / F.col("q")
    exact = pairs.select("k1", "k2", "i1", "i2", share.alias("containment")).filter(F.col("containment") >= containment)
    return scratch.table(exact, f"contained{b}")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, containment`` of every leak."""
    found = contained_items(docs, benchmark, containment)
    return found.select(id_of(F.col("k1")).alias("doc_id"), id_of(F.col("i1")).alias("item_id"), "containment")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = contained_items(docs, benchmark, containment).select("k1", "k2").distinct()
    return whole_rows(docs).join(found, ["k1", "k2"], "left_anti").select("row.*")
