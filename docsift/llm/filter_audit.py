"""What each filter of a chain removes, in every order of the filters.

One pass over the texts notes which of five filters every document fails; after
that only counts matter. Per part they form a 2 x 2 x 2 x 2 x 2 tensor (pass or
fail along each filter's axis), with one further axis for what is counted: all
documents, good ones, toxic ones. A step of an order is a contraction of that
tensor: an axis takes "pass" for the filters before the step, "fail" for the
step's own, and "all" for those after it. All 600 steps of the 120 orders are
one ``einsum`` with a selector matrix per axis, and so are the documents that
fail one filter only.

Filters, on the words (runs without space and the control characters 9-13) and
characters of a whole text:

A  under 100 words
B  distinct words are under 80 % of the words (case-sensitive)
C  over 10 % of the code points are A-Z
D  holds any of ``#$%&*|``
E  the same text stands under a smaller doc_id, anywhere in the table

Defined results: a null text counts as empty (it fails A; and E, if another
empty text has a smaller id); every row counts, repeated rows too, and rows of
one id are no copies of each other; a null doc_id is smaller than no id, has no
label and fails E never; a null lang is the part ``''``; a label row with nulls
counts for what it says, repeated label rows once; an empty table has no part
and gives no row; extra columns are ignored.

Texts are told apart by their MD5. The counts of a part are 32 rows after
partial aggregation, so a part with most of the rows is no heavier than
another; copies of one text meet as one row per task and text.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def failures(text: str | None) -> int:
    """The filters A-D that a text fails, as bits 0-3."""
    data = (text or "").encode()
    words = data.split()  # bytes are split at exactly the six separators
    n, points = len(words), len(text or "")
    upper = len(data) - len(data.translate(None, _UPPER))
    symbols = len(data.translate(None, _SYMBOLS)) < len(data)
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * upper > 10 * points) << 2 | symbols << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        fails = pa.array([failures(t) for t in texts], pa.int32())
        same = pa.array([hashlib.md5((t or "").encode()).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), fails, same], names=["doc_id", "part", "fails", "same"])


def _selectors(own: tuple[int, int], before: tuple[int, int], after: tuple[int, int]) -> list[np.ndarray]:
    """Per axis a matrix (step of an order) x (pass, fail)."""
    rows = [[own if f == o[k] else before if f in o[:k] else after for f in FILTERS] for o in ORDERS for k in range(len(FILTERS))]
    return list(np.array(rows, dtype=np.int64).transpose(1, 0, 2))


def contract(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """The seven counts of every step, steps in the order of ``ORDERS``. The
    tensor's axes are the five filters, then (all, good, toxic)."""
    take = lambda s: np.einsum("abcdem,sa,sb,sc,sd,se->sm", tensor, *s, optimize=True)
    removed = take(_selectors(_FAIL, _PASS, _ALL))
    failing = take(_selectors(_FAIL, _ALL, _ALL))[:, 0]
    alone = take(_selectors(_FAIL, _PASS, _PASS))[:, 0]
    kept = take(_selectors(_PASS, _PASS, _ALL))[:, 0]
    letters = np.array([FILTERS.index(f) for o in ORDERS for f in o])
    shapley = np.bincount(letters, removed[:, 0], len(FILTERS)).astype(np.int64)[letters]
    return dict(zip(_COUNTS, (kept, removed[:, 0], failing - removed[:, 0], alone, removed[:, 1], removed[:, 2], shapley), strict=True))


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for part, cells in zip(b["part"], b["cells"], strict=True):
            tensor = np.zeros((32, 3), dtype=np.int64)
            for c in cells:
                tensor[c["fails"]] = c["n"], c["good"], c["toxic"]
            # the bit of filter A is the lowest: reshaping puts E first
            counts = contract(tensor.reshape(2, 2, 2, 2, 2, 3).transpose(4, 3, 2, 1, 0, 5))
            steps = [(part, o, k + 1) for o in ORDERS for k in range(len(FILTERS))]
            yield pd.DataFrame(steps, columns=["part", "filter_order", "step"]).assign(**counts)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails`` of every row: bits 0-4 for the filters A-E."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "filter_audit")
    rows = scratch.table(given.mapInArrow(_judge, "doc_id long, part string, fails int, same binary"), "rows")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # the texts of two ids or more; read from a table, both sides of the join are
    # plain exchanges, so the rows of a very common text are split over tasks
    copies = scratch.table(first.filter("last > first").select("same", "first"), "copies")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(copies, "same", "left").select("doc_id", "part", (F.col("fails") + F.lit(16) * copied).alias("fails"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module text."""
    prepare(docs.sparkSession)
    says = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    cells = judged(docs).join(says, "doc_id", "left").groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    return parts.mapInPandas(_steps, _RESULT)
