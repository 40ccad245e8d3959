"""Toxicity score: a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other alphabets and
digit or sign substitutions become the letters they stand for. Lexicon entries
are beginnings of words (so inflected forms are met) and count only at a word's
start; a match inside an exception phrase is void. The weights of the matches
are added and normalised by length, and a logistic curve maps the result to a
score.

All parts are learnt from labelled rows, at most ``TRAIN_ROWS`` per label,
those of the smallest hash of doc_id, texts whole. Candidates are word
beginnings of 4 to ``LONGEST`` letters and whole words; shorter words, which
would begin many others, are matched up to the word's end. Copies would lend any
of their words a strong weight, so documents count once per fingerprint (the
smallest hash of their word triples). An entry needs ``SUPPORT`` of the toxic
fingerprints, but no more than ``ENOUGH`` and no less than three, and a share of
toxic ones above ``PRECISION``; of nested entries the shortest stays. Two-word phrases around an entry that occur
in clean documents only, as often at least, become exceptions. Scoring reads
all documents.

Defined results: null and empty texts have no match and get the lowest score;
a null doc_id is not held out and never trains; of several labels of one id the
largest counts; repeated rows are scored one by one; without training rows the
lexicon is empty and every score below 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .quality import held_out

TRAIN_ROWS = 4000
SHORTEST, LONGEST = 4, 10
SUPPORT, ENOUGH = 0.01, 16
END = "\0"  # closes an entry that is a whole word
PRECISION = 0.95
#: Letters that look like Latin ones, and digits and signs that
#: are written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_FOLD = str.maketrans(LOOKALIKES)
_WORD = re.compile(r"[^\W\d_]+")
_TWO_WORDS = re.compile(r"([^\W\d_]+)( [^\W\d_]+)?")


def fold(text: str | None) -> str:
    """Full-width forms are mapped too. One character stays one character."""
    out = (text or "").replace("İ", "i").lower().translate(_FOLD)  # the one letter whose lower case is two
    if not out.isascii():
        out = "".join([chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in out]) if re.search("[！-～]", out) else out
    return out


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    slope: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for word, weight in self.entries.items():
            whole = word.endswith(END)
            a.add_word(word.rstrip(END), (len(word) - whole, weight, whole))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None, False))
        if len(a):
            a.make_automaton()
        return a


def matches(text: str, automaton) -> list[tuple[int, int, float | None]]:
    """(start, end, weight) of what stands at a word's start in a folded
    text; weight None marks an exception phrase."""
    if not len(automaton):
        return []
    found = []
    for last, (size, weight, whole) in automaton.iter(text):
        start = last - size + 1
        if whole and text[last + 1 : last + 2].isalpha():
            continue
        if start == 0 or not text[start - 1].isalpha():
            found.append((start, last + 1, weight))
    return found


def weighed(text: str, automaton) -> float:
    """Sum of the weights, by length: per match-free text of 100 words the
    sum counts half as much with every further factor e of length."""
    found = matches(text, automaton)
    if not found:
        return 0.0
    void = [(s, e) for s, e, w in found if w is None]
    total = sum(w for s, e, w in found if w is not None and not any(a <= s and e <= b for a, b in void))
    words = text.count(" ") + text.count("\n") + 1
    return total / (1 + math.log1p(words / 100))


def probability(value, lexicon: Lexicon):
    return 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * value, -35, 35)))


def fingerprint(words: list[str]) -> int:
    """Equal for copies, mostly equal for near copies."""
    triples = zip(words, words[1:], words[2:], strict=False)
    return min((xxhash.xxh3_64_intdigest(" ".join(t)) for t in triples), default=xxhash.xxh3_64_intdigest(" ".join(words))) >> 1


def beginnings(words: Iterable[str]) -> set[str]:
    out = {w for w in words if len(w) >= SHORTEST}
    short = {w + END for w in words if len(w) < SHORTEST}
    return out | short | {w[:n] for w in out for n in range(SHORTEST, min(len(w), LONGEST + 1))}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``entry, toxic, clean``: how many documents of a task have it."""
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            (toxic if label else clean).update(beginnings(set(_WORD.findall(fold(text)))))
    names = [k for k in toxic if toxic[k] > 0] + [k for k in clean if k not in toxic]
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        counts = (pa.array([c[k] for k in part], pa.int64()) for c in (toxic, clean))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], names=["entry", "toxic", "clean"])


def _phrases(entries: dict[str, float]):
    """``entry, toxic, clean`` of the two-word phrases around an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        automaton = Lexicon(entries).automaton()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                text, seen = fold(text), set()
                for start, _, _ in matches(text, automaton):
                    here = _TWO_WORDS.match(text, start)
                    first = start - 1
                    while first > 0 and text[first - 1].isalpha():
                        first -= 1
                    if 0 <= first < start - 1 and text[start - 1] == " ":
                        seen.add(text[first:start] + here[1])
                    if here[2]:
                        seen.add(here[0])
                (toxic if label else clean).update(seen)
        names = list(toxic | clean)
        counts = (pa.array([c[k] for k in names], pa.int64()) for c in (toxic, clean))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["entry", "toxic", "clean"])

    return run


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = [fingerprint(_WORD.findall(fold(t))) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "label", "text")), pa.array(marks, pa.int64())], names=["h", "label", "text", "mark"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from ``labels`` (``doc_id, label``) and the texts of ``docs``."""
    scratch = Scratch(prepare(docs.sparkSession), "toxicity")
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    sample = [known.filter(c).orderBy("h", "doc_id").limit(rows) for c in ("label = 1", "label != 1")]
    sample = scratch.table(sample[0].unionByName(sample[1]).selectExpr("doc_id", "CAST(label = 1 AS INT) AS label", "h"), "sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.select("h", "label", "text").mapInArrow(_prints, "h long, label int, text string, mark long")
    texts = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "mark", "label").dropDuplicates(["mark", "label"])
    texts = scratch.table(texts.select("label", "text"), "texts")
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    totals = lambda df: df.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kind = "entry string, toxic long, clean long"
    rate = F.col("toxic") / n[1] / (F.col("toxic") / n[1] + F.col("clean") / n[0])
    support = max(3, min(ENOUGH, SUPPORT * n[1]))
    found = totals(texts.mapInArrow(_candidates, kind)).filter((F.col("toxic") >= support) & (rate > PRECISION))
    entries: dict[str, float] = {}
    for r in sorted(found.collect(), key=lambda r: (len(r["entry"]), r["entry"])):
        if not any(r["entry"][:k] in entries for k in range(SHORTEST, len(r["entry"].rstrip(END)))):
            entries[r["entry"]] = math.log((r["toxic"] + 0.5) / (n[1] + 1)) - math.log((r["clean"] + 0.5) / (n[0] + 1))
    if not entries:
        return Lexicon()
    phrases = totals(texts.mapInArrow(_phrases(entries), kind)).filter((F.col("clean") >= support) & (F.col("toxic") == 0))
    lexicon = Lexicon(entries, sorted(r["entry"] for r in phrases.collect()))
    return _calibrated(lexicon, texts)


def _weigher(lexicon: Lexicon, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            value = pa.array([weighed(fold(t), automaton) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), value], names=[*names, "value"])

    return run


def _calibrated(lexicon: Lexicon, texts: DataFrame) -> Lexicon:
    """Logistic regression of the label on the normalised sum, by Newton steps
    (at most 2 * TRAIN_ROWS pairs of numbers)."""
    got = texts.select("label", "text").mapInArrow(_weigher(lexicon, ["label"]), "label int, value double").collect()
    x = np.array([r["value"] for r in got])
    y = np.array([r["label"] for r in got], dtype=float)
    a = np.stack([np.ones(len(x)), x], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (weight * (p - y)) + 0.1 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return Lexicon(lexicon.entries, lexicon.exceptions, float(w[0]), float(w[1]))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_weigher(lexicon, ["doc_id"]), "doc_id long, value double")
    p = 1 / (1 + F.exp(-(F.lit(lexicon.bias) + F.lit(lexicon.slope) * F.col("value"))))
    return out.select("doc_id", p.alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learnt from ``labels.toxic`` of
    the rows that are not held out (crc32(doc_id) mod 5 = 0)."""
    out = held_out(F.col("doc_id"), 5, 0)
    lexicon = learn(docs, labels.filter(~out).select("doc_id", F.col("toxic").alias("label")))
    return score(docs, lexicon).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
