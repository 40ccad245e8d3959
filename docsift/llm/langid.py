"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, by
the forward algorithm; a text's is the product over its words. Words are runs
of letters, lower-cased, with the vocabulary's word-start mark before them. A
character that the vocabulary lacks is one unknown piece. Words of 48 letters or
more are summed one by one, on a scale per language; in training they are cut
every 48 letters.

Training is expectation maximisation (forward-backward) over the word counts of
a bounded sample: at most ``TRAIN_ROWS`` rows per language, those of the
smallest hash of doc_id, texts whole. Word counts stay on Spark; per round the
expected piece counts (vocabulary x languages, a fixed size) are summed there
and come back as the next parameters. Scoring reads all documents; word
probabilities are kept in a bounded cache per worker.

The score is the posterior probability of the predicted language, all
languages being as likely before.

Defined results: ``und`` with score 0 if the text is null or has no letter; a
null doc_id is not held out and never trains; a null lang never trains; ties go
to the language first in order; repeated rows are predicted one by one; without
training rows all is ``und``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, prepare, resident, whole_rows
from .quality import held_out

TRAIN_ROWS = 400
ROUNDS = 4
SMOOTHING = 0.05
LONGEST_WORD = 48
START = "▁"
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE_SIZE = 120_000
_TEXTS = 100  # texts whose new words are worked out together
_BLOCK = 20_000  # words that are worked on together; fewer than 2^15


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model that stand for text."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not special(i)]


class Lattice:
    """All pieces in all places of words, as edge lists."""

    def __init__(self, pieces: list[str]):
        self.piece = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        self.beginning = {p[:n] for p in self.piece for n in range(1, len(p) + 1)}
        self.unknown = len(self.piece)
        self.size = self.unknown + 1

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every edge, by end, then by word."""
        packed: list[int] = []
        piece, beginning, unknown = self.piece, self.beginning, self.unknown
        for w, word in enumerate(words):
            n = len(word)
            for s in range(n):
                at = w << 26 | s << 20
                if word[s] not in piece:
                    packed.append(s + 1 << 41 | at | unknown)
                for e in range(s + 1, n + 1):
                    part = word[s:e]
                    if part not in beginning:
                        break
                    if part in piece:
                        packed.append(e << 41 | at | piece[part])
        x = np.sort(np.array(packed, dtype=np.int64))
        return x >> 26 & 0x7FFF, x >> 20 & 0x3F, x >> 41, x & 0xFFFFF

    def forward(self, words: list[str], prob: np.ndarray, edges=None) -> np.ndarray:
        """alpha[word, position, language]; ``prob`` is piece x language."""
        w, s, e, p = self.edges(words) if edges is None else edges
        alpha = np.zeros((len(words), max(map(len, words)) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for end, at in _groups(e):
            add = alpha[w[at], s[at]] * prob[p[at]]
            first = np.flatnonzero(np.r_[True, np.diff(w[at]) != 0])
            alpha[w[at][first], end] = np.add.reduceat(add, first, axis=0)
        return alpha

    def long_log_probability(self, word: str, prob: np.ndarray) -> np.ndarray:
        """The same sum for one long word: the places that a piece can still
        reach back to, each language on a scale of its own."""
        reach = max(map(len, self.beginning), default=1)
        alpha, log_scale = np.zeros((reach + 1, prob.shape[1])), np.zeros(prob.shape[1])
        alpha[0] = 1
        for end in range(1, len(word) + 1):
            now = np.zeros(prob.shape[1])
            for start in range(max(0, end - reach), end):
                part = word[start:end]
                if part in self.piece:
                    now += alpha[start % (reach + 1)] * prob[self.piece[part]]
            if word[end - 1] not in self.piece:
                now += alpha[(end - 1) % (reach + 1)] * prob[self.unknown]
            alpha[end % (reach + 1)] = now
            if end % 16 == 0:
                top = np.maximum(alpha.max(axis=0), 1e-300)
                alpha /= top
                log_scale += np.log(top)
        return log_scale + np.log(np.maximum(alpha[len(word) % (reach + 1)], 1e-300))

    def log_probabilities(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """word x language"""
        alpha = self.forward(words, prob)
        return np.log(np.maximum(alpha[np.arange(len(words)), [len(x) for x in words]], 1e-300))

    def expected(self, words: list[str], count: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; ``count`` is word x language."""
        edges = w, s, e, p = self.edges(words)
        alpha = self.forward(words, prob, edges)
        size = np.array([len(x) for x in words])
        beta = np.zeros_like(alpha)
        beta[np.arange(len(words)), size] = 1
        order = np.lexsort((w, s))  # by start
        for start, at in reversed(_groups(s[order])):
            at = order[at]
            add = beta[w[at], e[at]] * prob[p[at]]
            first = np.flatnonzero(np.r_[True, np.diff(w[at]) != 0])
            beta[w[at][first], start] = np.add.reduceat(add, first, axis=0)
        share = count / np.maximum(alpha[np.arange(len(words)), size], 1e-300)
        use = alpha[w, s] * prob[p] * beta[w, e] * share[w]
        out = np.zeros_like(prob)
        np.add.at(out, p, use)
        return out


def _groups(sorted_values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    return [(int(sorted_values[i[0]]), i) for i in np.split(np.arange(len(sorted_values)), cut)]


_LATTICES: dict[int, Lattice] = {}


def _lattice(pieces: list[str]) -> Lattice:
    """One lattice per worker and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(pieces)
    return _LATTICES[key]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _BLOCK):
            yield b.slice(i, _BLOCK)


@dataclass
class Model:
    key: str
    pieces: list[str]
    languages: list[str]
    prob: np.ndarray  # piece x language


def marked(run: str) -> list[str]:
    """A run of lower-case letters as words of the vocabulary, for training;
    scoring sums over the segmentations of whole runs."""
    word = START + run
    return [word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` of each batch."""
    for b in batches:
        seen: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for run, n in Counter(_LETTERS.findall(text.lower())).items():
                for word in marked(run):
                    seen[lang, word] += n
        langs, words = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])


def _expectation(pieces: list[str], languages: list[str], prob: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(pieces)
        total = np.zeros_like(prob)
        for b in _small(batches):
            if b.num_rows:
                words, of = np.unique(b.column("word").to_pylist(), return_inverse=True)
                count = np.zeros((len(words), len(languages)))
                np.add.at(count, (of, [languages.index(x) for x in b.column("lang").to_pylist()]), b.column("n").to_numpy())
                total += lattice.expected(words.tolist(), count, prob)
        p, x = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(x), pa.array(total[p, x])], names=["piece", "language", "uses"])

    return run


def train(docs: DataFrame, pieces: list[str], rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """A model from ``doc_id, text, lang``; rows without one of them are left out."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "langid")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    sample = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("nth", nth).filter(F.col("nth") <= rows)
    sample = scratch.table(sample.select("doc_id", "lang").distinct(), "sample")
    chosen = docs.join(F.broadcast(sample), ["doc_id", "lang"])
    words = chosen.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
    words = scratch.table(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    lattice = Lattice(pieces)
    prob = np.full((lattice.size, len(languages)), 1 / lattice.size)
    for _ in range(rounds if languages else 0):
        uses = words.mapInArrow(_expectation(pieces, languages, prob), "piece long, language long, uses double")
        got = uses.groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.zeros_like(prob)
        total[got["piece"], got["language"]] = got["uses"]
        # what a language lacks it takes, at a small rate, from all languages
        common = total.sum(axis=1, keepdims=True) + 1
        prob = total / np.maximum(total.sum(axis=0), 1e-9) * (1 - SMOOTHING) + SMOOTHING * common / common.sum()
    return Model(uuid.uuid4().hex, list(lattice.piece), languages, prob)


class Scorer:
    """Log-probabilities of runs of letters, in a bounded cache of two
    generations: what was used since the last change of generation stays."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, _lattice(model.pieces)
        self.row: dict[str, int] = {}
        self.value = np.zeros((_CACHE_SIZE, len(model.languages)))
        self.before: tuple[dict[str, int], np.ndarray] = ({}, self.value)

    def _learn(self, needed: set[str]) -> None:
        """Makes sure that this generation has a row for all of ``needed``."""
        runs = needed - self.row.keys()
        if len(self.row) + len(runs) > len(self.value):
            self.before = (self.row, self.value)
            self.row, self.value = {}, np.zeros((max(_CACHE_SIZE, len(needed)), self.value.shape[1]))
            runs = needed
        old, known = self.before
        at = len(self.row)
        have = [r for r in runs if r in old]
        self.value[at : at + len(have)] = known[[old[r] for r in have]]
        new = [r for r in runs if r not in old]
        at += len(have)
        short = [r for r in new if len(r) < LONGEST_WORD]
        for i in range(0, len(short), _BLOCK):
            some = short[i : i + _BLOCK]
            self.value[at + i : at + i + len(some)] = self.lattice.log_probabilities([START + r for r in some], self.model.prob)
        long = [r for r in new if len(r) >= LONGEST_WORD]
        for i, r in enumerate(long, at + len(short)):
            self.value[i] = self.lattice.long_log_probability(START + r, self.model.prob)
        self.row.update(zip([*have, *short, *long], range(len(self.row), at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for i in range(0, len(texts), _TEXTS):
            runs = [_LETTERS.findall((t or "").lower()) for t in texts[i : i + _TEXTS]]
            self._learn(set().union(*runs))
            for own in runs:
                if not self.model.languages or not any(any(map(str.isalpha, r)) for r in own):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = self.value[list(map(self.row.__getitem__, own))].sum(axis=0)
                p = np.exp(total - total.max())
                langs.append(self.model.languages[int(total.argmax())])
                scores.append(float(p.max() / p.sum()))
        return langs, scores


def _scorer(model: Model) -> Scorer:
    """A worker keeps the scorer of the model it last saw."""
    return resident(("langid", model.key), lambda: Scorer(model))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for b in batches:
            langs, scores = scorer.predict(b.column("text").to_pylist())
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def language_predictions(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learnt from the rows that are
    not held out (crc32(doc_id) mod 5 = 0)."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.filter(~out).select("doc_id", "text", "lang"), read_pieces(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(rows, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a posterior of at
    least ``least``."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.filter(~out).select("doc_id", "text", "lang"), read_pieces(vocabulary))
    rows = whole_rows(docs).select("row", F.col("row.text").cast("string").alias("text"))
    good = predict(rows, model, ["row"]).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return good.select("row.*")
