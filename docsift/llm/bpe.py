"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece one number is stored: the last token of that
prefix's encoding. A token that ends at a prefix is the last one if and only if
it may follow the last token of the prefix before it; exactly one token
qualifies, so the table is filled left to right and the tokens are read off
from the end. Because the table of a prefix never depends on what follows,
bytes can be appended exactly, and after an edit only the entries from the edit
on are made anew, until they agree with the old ones again. For the same reason
pieces that begin alike share entries: of short pieces, only the entries that
the last one asks for are made, and a worker keeps them for the next pieces.

Whether token b may follow token a: undo the merges at their border, the latest
merge first, and see whether BPE would ever have merged across it before.

A text is cut by the tokenizer's pattern first and every match encoded by
itself. Spaces between two characters that are not white space always begin a
match, so texts are taken apart there, and each such part is looked up in a
bounded cache of the worker; parts seen first go through the pattern and the
table.

Defined results: a null text counts as empty; an empty text has no tokens;
decoding gives the exact bytes back; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, resident

_CACHE_SIZE = 150_000
_SHORT = 64  # bytes of a piece whose entries are made from its end


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Ranks:
    """A vocabulary with its merges undone: ``left``, ``right`` of a token are
    the two tokens it is merged from; a single byte has none."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        self.ends: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (halves := self._split(token, rank)):
                self.parts[rank] = halves
                self.merged[halves] = rank
        #: tokens that merging can make; any other one only stands for a whole piece
        self.made = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.parts}
        self.packed = {i: struct.pack("<I", i) for i in self.bytes_of}

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two tokens that merging the bytes by lower ranks leaves."""
        part = [token[i : i + 1] for i in range(len(token))]
        while len(part) > 2:
            best = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(part, part[1:], strict=False))))
            if best[0] >= rank:
                return None
            i = best[1]
            part[i : i + 2] = [part[i] + part[i + 1]]
        return self.ranks[part[0]], self.ranks[part[1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between tokens a and b."""
        if len(self.known) > 2 * _CACHE_SIZE:
            self.known.clear()
        kept = self.known[a << 32 | b] = self._border(a, b)
        return kept

    def _border(self, a: int, b: int) -> bool:
        latest = len(self.ranks) + 256  # a merge across counts if it came before this one
        while True:
            if self.merged.get((a, b), latest) < latest:
                return False
            inner_a, inner_b = self.parts.get(a), self.parts.get(b)
            # the later merge is undone first; of equal ranks, the right one
            if inner_a and (not inner_b or a > b):
                latest, a = a, inner_a[1]
            elif inner_b:
                latest, b = b + 1, inner_b[0]
            else:
                return True

    def last(self, data: bytes) -> int:
        """The last token of ``data``, for short data only. It looks up the
        entries of the prefixes that it asks for, the longest token first;
        entries are kept, as many pieces begin alike."""
        made, known, ends = self.made.get, self.known.get, self.ends.get
        for begin in range(max(len(data) - self.longest, 0), len(data)):
            token = made(data[begin:])
            if token is None:
                continue
            if begin:
                head = data[:begin]
                before = ends(head)
                if before is None:
                    before = self.last(head)
                kept = known(before << 32 | token)
                if kept is None:
                    kept = self.follows(before, token)
                if not kept:
                    continue
            if len(self.ends) > 2 * _CACHE_SIZE:
                self.ends.clear()
            self.ends[data] = token
            return token
        raise ValueError("the vocabulary lacks a byte")

    def tokens(self, data: bytes) -> list[int]:
        if len(data) > _SHORT:
            return PrefixTable(self, data).tokens()
        out = []
        while data:
            token = self.ends.get(data)
            out.append(self.last(data) if token is None else token)
            data = data[: -len(self.bytes_of[out[-1]])]
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def _last(self, end: int) -> int:
        data, last, ranks = self.data, self.last, self.ranks
        made, known = ranks.made.get, ranks.known.get
        for begin in range(end - 1, max(end - ranks.longest, 0) - 1, -1):
            token = made(data[begin:end])
            if token is None:
                continue
            if not begin:
                return token
            kept = known(last[begin - 1] << 32 | token)
            if kept is None:
                kept = ranks.follows(last[begin - 1], token)
            if kept:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of ``data[start:stop]``. Returns how many
        entries were made anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        same, end = 0, start
        while end < len(self.data):
            end += 1
            self.last.append(self._last(end))
            # as many equal entries as the longest token has bytes: the rest cannot differ
            same = same + 1 if end > start + len(new) and old[end - 1 - shift] == self.last[-1] else 0
            if same >= self.ranks.longest:
                self.last += old[end - shift :]
                break
        return end - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.ranks.bytes_of[out[-1]])
        return out[::-1]


class _Cache(dict):
    """A bounded cache of two generations: what was used since the last change
    of generation stays."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64 and "\n" not in key:  # words around a line feed rarely recur
            if len(self) >= _CACHE_SIZE:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class _Pieces(_Cache):
    """Little-endian ids of a piece."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def make(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.ranks.get(data)
        if whole is not None:
            return self.ranks.packed[whole]
        return b"".join([self.ranks.packed[i] for i in self.ranks.tokens(data)])


class _Parts(_Cache):
    """The same for what stands between two single spaces, with the space
    before it."""

    def __init__(self, pieces: _Pieces, pattern: str):
        super().__init__()
        self.pieces, self.find = pieces, regex.compile(pattern).findall

    def encode(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.find(text)])

    def make(self, part: str) -> bytes:
        return self.encode(" " + part)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = Ranks(ranks)
        self.parts = _Parts(_Pieces(self.ranks), pattern)
        vocabulary = np.zeros(max(ranks.values()) + 1, dtype=object)
        for token, i in ranks.items():
            vocabulary[i] = token
        self.vocabulary = vocabulary

    #: Spaces at which a text can be cut: white space on neither side.
    _BETWEEN = regex.compile(r"(?<=\S) (?=\S)")
    _GAPS = regex.compile(r"\s\s|^\s|\s$")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self._BETWEEN.split(text) if self._GAPS.search(text) else text.split(" ")
        first = self.parts.encode(parts[0])
        return first + b"".join([self.parts[p] for p in parts[1:]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.vocabulary[np.frombuffer(ids, dtype="<u4")].tolist())


def encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder that a worker keeps for a vocabulary; ``data`` are the bytes of the
    vocabulary file."""
    key = hashlib.md5(data + pattern.encode()).hexdigest()

    def make() -> Encoder:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        return Encoder(ranks, pattern)

    return resident(("bpe", key), make)


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], as_array: bool = False) -> DataFrame:
    """The columns ``keep`` of ``df`` and, for its column ``text``, ``ids``
    (little-endian unsigned 32-bit integers in a binary, or an array of int)
    and ``decoded`` (binary, made from the ids). The vocabulary file is read by
    the driver and sent to the tasks; its size is fixed."""
    spark = prepare(df.sparkSession)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value, pattern)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            decoded = pa.array([enc.decode(i) for i in ids], pa.binary())
            if as_array:
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            else:
                out = pa.array(ids, pa.binary())
            own = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, out, decoded], names=[*b.schema.names[:-1], "ids", "decoded"])

    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = df.select(*numbered, F.col("text").cast("string").alias("c_text"))
    schema = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)])
    out = rows.mapInArrow(run, schema.add("ids", T.ArrayType(T.IntegerType()) if as_array else T.BinaryType()).add("decoded", "binary"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")
