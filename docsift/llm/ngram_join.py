"""Components of documents whose sets of word 4-grams have a Jaccard similarity
of 0.85 or more, by rare-first prefix filtering.

A document's set are its distinct 4-word shingles (A-Z lowered; words are runs
without space and the control characters 9-13); with one to three words, all of
them as one shingle. Documents of equal sets are one node.

1. Every shingle of every document is counted in one of 2^20 hashed cells: each
   task adds up its own, the cells are summed across tasks and sent back to all
   (2 MB, whatever the corpus). The cell's count, then the shingle, is the order
   of all sets; a count that others add to only moves a shingle back, for every
   document alike, so no result depends on it.
2. A set posts the first n - ceil(0.85 n) + 1 shingles in that order: two similar
   sets share one of them.
3. Sets that meet at a shingle are compared unless their lengths differ too much
   (length filter) or too few shingles follow the one they share (positional
   filter); the suffix filter looks at the sizes of the sets' pieces before the
   sets are intersected. Posting lists of a group of copies go through a hub
   instead of all their pairs (``crowds``, where both are stated), each pair once.

Result: one row per row of the input.

* ``component_id`` is the smallest doc_id that links reach, null where no row of
  the component has one;
* null texts and texts without a word have no shingle, ``n_shingles`` 0, and are
  linked with nothing: their component is their own id;
* repeated rows have equal sets; an empty table gives an empty result; extra
  columns are ignored. Shingles and sets are told apart by 64 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_of, keyed, prepare
from .components import components
from .crowds import Crowds
from .hashing import gram_hashes, word_hashes

WORDS = 4
PERCENT = 85
_BITS, _PER_ROW = 20, 4096  # cells of the count table, and of one of its rows


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.encode().lower().split()  # of bytes: ASCII letters, the six separators
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(WORDS, len(words))))


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, as rows of cells in the narrowest type that holds them."""
    cells = np.zeros(1 << _BITS, dtype=np.int64)
    for b in batches:
        for text in b.column("text").to_pylist():
            np.add.at(cells, _cell(shingle_set(text or "")), 1)
    some = [(i, row.astype(np.min_scalar_type(row.max()))) for i, row in enumerate(cells.reshape(-1, _PER_ROW)) if row.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in some], pa.int32()), pa.array([r.dtype.itemsize for _, r in some], pa.int32()), pa.array([r.tobytes() for _, r in some], pa.binary())],
        names=["row", "width", "cells"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, width, cells in zip(*(b.column(c).to_pylist() for c in ("row", "width", "cells")), strict=True):
            total.setdefault(i, np.zeros(_PER_ROW, dtype=np.int64))
            total[i] += np.frombuffer(cells, f"<u{width}").astype(np.int64)
    out = [(i, np.minimum(c, 2**16 - 1).astype("<u2").tobytes()) for i, c in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())], names=["row", "cells"])


def prefix(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that a set posts, rarest first."""
    order = np.lexsort((grams, counts[_cell(grams)]))
    return grams[order[: len(grams) - -(-percent * len(grams) // 100) + 1]]


class _Run:
    def __init__(self, docs: DataFrame, percent: int):
        self.spark = prepare(docs.sparkSession)
        self.scratch = Scratch(self.spark, "ngram_join")
        self.percent = percent
        self.docs = keyed(docs)

    def counts(self) -> np.ndarray:
        """The count of every cell, up to 65,535."""
        parts = self.docs.select("text").mapInArrow(_count, "row int, width int, cells binary")
        rows = parts.repartition(64, "row").mapInArrow(_add, "row int, cells binary").collect()  # 256 rows of 8 KB
        out = np.zeros((1 << _BITS) // _PER_ROW * _PER_ROW, dtype="<u2").reshape(-1, _PER_ROW)
        for r in rows:
            out[r["row"]] = np.frombuffer(r["cells"], "<u2")
        return out.reshape(-1)

    def posted(self) -> DataFrame:
        """``k1, k2, n, sid, prefix`` of every row; ``sid`` null without words."""
        sent, percent = self.spark.sparkContext.broadcast(self.counts()), self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingle_set(t or "") for t in b.column("text").to_pylist()]
                sids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                first = [prefix(s, sent.value, percent).view(np.int64) if len(s) else [] for s in sets]
                cols = [b.column("k1"), b.column("k2"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "n", "sid", "prefix"])

        return self.scratch.table(self.docs.mapInArrow(run, "k1 long, k2 long, n long, sid binary, prefix array<long>"), "rows")

    def texts(self, rows: DataFrame, sids: DataFrame) -> DataFrame:
        """One text of each of these sets."""
        one = rows.filter("sid IS NOT NULL").groupBy(F.col("sid").alias("tid")).agg(F.min(F.struct("k1", "k2")).alias("own"))
        one = self.scratch.table(one.join(sids, "tid", "left_semi").select("tid", "own.k1", "own.k2"), "nodes")
        # grows with the corpus, so it is never broadcast
        return self.scratch.table(self.docs.join(one.hint("merge"), ["k1", "k2"]).select("tid", "text").dropDuplicates(["tid"]), "texts")

    def result(self) -> DataFrame:
        rows = self.posted()
        sets = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        postings = sets.select(F.col("sid").alias("tid"), "n", F.col("n").alias("size"), F.posexplode("prefix").alias("at", "key"))
        postings = postings.select("key", "tid", "n", "size", (F.col("at") + 1).cast("long").alias("pos"), F.lit(True).alias("away"))
        crowds = Crowds(self.scratch, self.percent, shingle_set, lambda sids: self.texts(rows, sids))
        roots = components(crowds.links(self.scratch.table(postings, "postings")), self.scratch)
        ids = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(id_of(F.col("k1"))).alias("id"))
        node = ids.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "id", F.coalesce("root", "sid").alias("root"))
        least = node.groupBy("root").agg(F.min("id").alias("component_id"))
        of = self.scratch.table(node.join(least, "root").select("sid", "component_id"), "components")
        doc_id = id_of(F.col("k1")).alias("doc_id")
        linked = rows.filter("sid IS NOT NULL").select("sid", doc_id, F.col("n").alias("n_shingles")).join(of, "sid")
        alone = rows.filter("sid IS NULL").select(doc_id, F.col("n").alias("n_shingles"), id_of(F.col("k1")).alias("component_id"))
        return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``
    (``doc_id, text``)."""
    return _Run(docs, percent).result()
