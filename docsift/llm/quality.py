"""Quality score: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates (FTRL-proximal, McMahan et al., 2013).

Tokens are words and runs of symbols; features are hashed unigrams and bigrams
(a word that repeats the one before it makes one common bigram feature). A
text is a sparse vector of square-rooted counts, scaled to length 1, so long
and short texts compare. The score is the logistic of one sparse dot product.

Training takes a bounded sample: at most ``TRAIN_ROWS`` labelled rows, those of
the smallest hash of doc_id, texts whole. The sample passes the trainer
``EPOCHS`` times in hash order, one document at a time; the state between
passes is the two FTRL vectors (2^18 numbers each), nothing else. A label weighs by the
square root of how rare it is in the sample. Scoring reads all documents.

Defined results: null and empty texts have no feature and get the bias alone;
a null doc_id counts as not held out and never trains; of several labels of one
id the smallest counts; repeated rows are scored one by one; without training
rows every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .hashing import STEP, mix, word_hashes

BITS = 18
SIZE = 1 << BITS
TRAIN_ROWS = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's sparse vector."""
    h = word_hashes(_TOKEN.findall(text or ""))
    pair = mix(h[:-1] * STEP + h[1:])
    pair[h[:-1] == h[1:]] = 0
    index = (np.concatenate([h, pair]) >> np.uint64(64 - BITS)).astype(np.int32)
    index, count = np.unique(index, return_counts=True)
    value = np.sqrt(count)
    return index, value / max(np.sqrt((value**2).sum()), 1e-9)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias."""

    def __init__(self, state: bytes | None = None):
        self.z, self.n = np.frombuffer(state).reshape(2, -1).copy() if state else np.zeros((2, SIZE + 1))

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        i, x = np.append(index, SIZE), np.append(value, 1.0)
        w = self.weights(i)
        g = weight * (_logistic(w @ x) - label) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def state(self) -> bytes:
        return np.stack([self.z, self.n]).tobytes()


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        index, value = zip(*map(features, b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("h"), b.column("label"), pa.array([x.tobytes() for x in index], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())],
            names=["h", "label", "i", "v"],
        )


def _trainer(state: bytes | None, weight: dict[int, float]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(state)
        for b in batches:
            for label, i, v in zip(*(b.column(c).to_pylist() for c in ("label", "i", "v")), strict=True):
                model.learn(np.frombuffer(i, np.int32), np.frombuffer(v), label, weight[label])
        yield pa.RecordBatch.from_arrays([pa.array([model.state()], pa.binary())], names=["state"])

    return train


def held_out(doc_id, folds: int, fold: int):
    """True for the rows that are never learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from ``labels`` (``doc_id, label``) and the texts of ``docs``."""
    scratch = Scratch(prepare(docs.sparkSession), "quality")
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    sample = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    sample = scratch.table(sample, "sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows_in = scratch.table(texts.select("h", "label", "text").mapInArrow(_featurise, "h long, label int, i binary, v binary"), "features")
    rows_in = rows_in.repartition(1).sortWithinPartitions("h", "label", "i", "v")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weight = {label: (sum(n.values()) / (len(n) * own)) ** 0.5 for label, own in n.items()}
    state = None
    for _ in range(epochs):
        new = rows_in.mapInArrow(_trainer(state, weight), "state binary").first()
        if new is None:  # no row to learn from
            break
        state = bytes(new["state"])
    return Ftrl(state).weights()


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                i, v = features(text)
                out.append(float(_logistic(w[i] @ v + w[SIZE])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learnt from ``labels.quality``
    of the rows that are not held out (crc32(doc_id) mod 3 = 1)."""
    out = held_out(F.col("doc_id"), 3, 1)
    weights = train(docs, labels.filter(~out).select("doc_id", F.col("quality").alias("label")))
    return score(docs, weights).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def weights_table(weights: np.ndarray) -> pd.DataFrame:
    """The non-zero weights, for saving."""
    at = np.flatnonzero(weights)
    return pd.DataFrame({"feature": at, "weight": weights[at]})
