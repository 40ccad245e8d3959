"""Token counts: greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie. A node that the next letter does not leave has a
failure link to the node of what is left over after the longest pieces are
taken off its front, and the number of pieces so taken, both precomputed. A
word is read letter by letter, without going back and without building pieces:
the count is the sum of the numbers on the failure links followed (LinMaxMatch,
Song et al., 2021).

Words are what white space separates; a word begins with the vocabulary's
word-start mark, later pieces carry none. A word that cannot be cut into pieces
counts as one unknown token.

Defined results: null and empty texts have no word and no token; repeated rows
are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

START = "▁"
_CACHE_SIZE = 300_000
_UNKNOWN = 1 << 40  # one unknown token, above the count of tokens


class Automaton:
    """Node 0 is the start of a word, node 1 the place after a piece."""

    def __init__(self, pieces: list[str]):
        self.goto: list[dict[str, int]] = [{}, {}]
        self.fail: list[int | None] = [None, None]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        for p in dict.fromkeys(pieces):
            node = 0 if p.startswith(START) else 1
            for c in p:
                if c not in self.goto[node]:
                    self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.fail.append(None)
                    self.popped.append(0)
                node = self.goto[node][c]
            ends.add(node)
        queue = deque((r, r) for r in (0, 1))
        while queue:
            node, _ = queue.popleft()
            for c, child in self.goto[node].items():
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    count, left = self.popped[node], self.fail[node]
                    while left is not None and c not in self.goto[left]:
                        count, left = count + self.popped[left], self.fail[left]
                    if left is not None:
                        self.fail[child], self.popped[child] = self.goto[left][c], count
                queue.append((child, node))

    def count(self, word: str) -> int | None:
        """Pieces of a word with its start mark; None if it has no cut."""
        goto, fail, popped, node, n = self.goto, self.fail, self.popped, 0, 0
        for c in word:
            while (to := goto[node].get(c)) is None:
                n, node = n + popped[node], fail[node]
                if node is None:
                    return None
            node = to
        while node != 1:
            n, node = n + popped[node], fail[node]
            if node is None:
                return None
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(START + word)
        value = _UNKNOWN + 1 if n is None else n
        if len(self) >= _CACHE_SIZE:
            self.clear()
        if len(word) < 64:
            self[word] = value
        return value


_COUNTS: dict[str, _Counts] = {}


def _counts(pieces: list[str]) -> _Counts:
    """One automaton and cache per worker and vocabulary."""
    key = hashlib.md5("\n".join(pieces).encode()).hexdigest()
    if key not in _COUNTS:
        _COUNTS[key] = _Counts(Automaton(pieces))
    return _COUNTS[key]


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every row."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counts(shared.value)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = (text or "").split()
                total = sum([of[w] for w in words])
                rows.append((len(words), total % _UNKNOWN, total // _UNKNOWN))
            n = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
