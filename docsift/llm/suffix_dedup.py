"""Repeated passages by a sparse suffix array.

Reported is every word that lies in a window of 50 words found in at least two
documents; the document with the smallest (id, hash) keeps a repeated window,
the others lose it.

1. Retained suffixes: a text's suffix is kept where the hash of its first 16
   words is the smallest among 35 neighbouring positions (a minimiser). Every
   window of 50 words holds one, chosen by its content, so two copies of a
   window retain the same suffix; about one position in 18 is kept.
2. The suffixes are sorted globally by their leading words; those whose
   neighbours do not share them are dropped.
3. What is left is sorted again as suffix array entries with their context: 50
   words to the right, 34 to the left. Neighbours are compared (common prefix),
   then matches are extended to the left: for each of the 35 windows that hold
   the suffix and have it as their minimiser, entries of a run with a long
   enough common prefix and equal left words are the same window.
4. The sort is by ranges whose last keys are id and position, so a passage held
   by a third of all documents spreads over many tasks. Windows of a suffix
   group that may go on in the next range are settled by one aggregation over
   window hashes.

Words are maximal runs of non-white-space. Where the same 16 words recur within
35 words (periodic text), a window's minimiser is the leftmost of the equal ones
in it, so copies of the window agree whatever stands around it; such a stretch
keeps a suffix per period.

Defined results: null, empty and shorter texts have no window; repeated rows
count as one document; exact copies repeat each other; an empty table gives an
empty result; extra columns are carried by ``drop_repeats`` and ignored by
``repeated_passages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, id_of, keyed, prepare, whole_rows
from .hashing import STEP, gram_hashes, mix, word_hashes

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1  # positions among which one suffix is retained
LEFT = WINDOW - GRAM
_WORD = re.compile(r"\S+")


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = op(out[: len(out) - step], out[step:])
        done += step
    return out


def _previous(g: np.ndarray) -> np.ndarray:
    """Where each value stood last, -1 for the first time."""
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    out = np.full(len(g), -1, dtype=np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def _own(g: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Position x a: the window that begins a words before the suffix lies in
    the text and the suffix is its minimiser, of equal ones the leftmost. That
    depends on the window alone, so all copies of a window agree."""
    low, last = _slide(g, SPAN, np.minimum), _previous(g)[pos]
    start = pos[:, None] - np.arange(SPAN)
    inside = (start > last[:, None]) & (start >= 0) & (start < len(low))
    return inside & (low[np.where(inside, start, 0)] == g[pos][:, None])


def retained(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the retained suffixes of a text of word hashes ``h``, the
    minimisers of its windows, and the hashes of their leading words."""
    g = gram_hashes(h, GRAM)
    if len(h) < WINDOW:
        return np.empty(0, dtype=np.int64), g[:0]
    low = _slide(g, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), SPAN, np.maximum) == g)
    if len(np.unique(g[at])) < len(at):  # equal ones: some are leftmost in no window
        at = at[_own(g, at).any(axis=1)]
    return at, g[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, pos, count = [], [], []
        for text in b.column("text").to_pylist():
            at, leading = retained(word_hashes((text or "").split()))
            count.append(len(at))
            key.append(leading)
            pos.append(at)
        if not key:
            continue
        of = np.repeat(np.arange(len(count)), count)
        cols = [np.concatenate(key).view(np.int64), *(b.column(c).to_numpy()[of] for c in ("k1", "k2")), np.concatenate(pos).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "k1", "k2", "pos"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, those whose neighbours share the leading words and
    stand in another document. A group at the edge of the range may go on in
    the next one and is kept."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    key, k1, k2, pos = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("key", "k1", "k2", "pos"))
    group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[group, len(key)])
    last = group + size - 1
    several = (k1[group] != k1[last]) | (k2[group] != k2[last])
    several[0] = several[-1] = True
    keep = np.repeat(several, size)
    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (k1, k2, pos)], names=["k1", "k2", "pos"])


def _windows(g: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Bit a: the window that begins a words before the suffix is its own."""
    return (_own(g, pos).astype(np.int64) << np.arange(SPAN)).sum(axis=1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(7)]
        for k1, k2, text, at in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "at")), strict=True):
            h = word_hashes(text.split())
            pos = np.array(sorted(set(at)), dtype=np.int64)
            short = (h >> np.uint64(32)).astype(np.uint32)
            short[short == 0] = 1  # 0 stands for: no word here
            padded = np.concatenate([np.zeros(LEFT, np.uint32), short, np.zeros(WINDOW, np.uint32)])
            right = padded[pos[:, None] + LEFT + np.arange(WINDOW)]
            left = padded[pos[:, None] + LEFT - 1 - np.arange(LEFT)]
            g = gram_hashes(h, GRAM)
            n = len(pos)
            new = (g[pos].view(np.int64), [r.tobytes() for r in right], [x.tobytes() for x in left], _windows(g, pos), [k1] * n, [k2] * n, pos.astype(np.int32))
            for have, more in zip(rows, new, strict=True):
                have.extend(more)
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["key", "right", "left", "windows", "k1", "k2", "pos"])


def _words(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, width)


class _Entries:
    """Suffix array entries, in order."""

    def __init__(self, batches: list[pa.RecordBatch]):
        col = lambda c: np.concatenate([b.column(c).to_numpy() for b in batches])
        self.key, self.k1, self.k2, self.pos = col("key"), col("k1"), col("k2"), col("pos").astype(np.int64)
        self.windows = col("windows")
        self.right = np.concatenate([_words(b.column("right"), WINDOW) for b in batches])
        self.left = np.concatenate([_words(b.column("left"), LEFT) for b in batches])

    def matches(self, open_keys: set[int]) -> pa.RecordBatch:
        n = len(self.key)
        same = (self.right[1:] == self.right[:-1]) & (self.right[1:] != 0)
        common = np.r_[0, np.logical_and.accumulate(same, axis=1).sum(axis=1)]
        common[np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])] = 0
        order = np.lexsort((self.k2, self.k1))
        new = np.r_[True, (np.diff(self.k1[order]) != 0) | (np.diff(self.k2[order]) != 0)]
        who = np.empty(n, dtype=np.int64)
        who[order] = np.cumsum(new) - 1
        doc = order[new]  # an entry of each document
        is_open = np.isin(self.key, list(open_keys))
        later, first = np.zeros((n, LEFT + 1), bool), np.zeros((n, LEFT + 1), bool)
        left_hash, prefix = np.zeros(n, np.uint64), self._prefix_hashes(is_open)
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        salt = np.arange(1, LEFT + 2).astype(np.uint64) * STEP
        for a in range(LEFT + 1):  # the window that begins a words before the suffix
            need = WINDOW - a
            run = np.cumsum(common < need).astype(np.uint64)
            row = np.flatnonzero(self.windows >> a & 1)
            code = mix(left_hash[row] + run[row] * STEP)
            o = np.lexsort((who[row], code))
            r, c = row[o], code[o]
            if len(r):
                start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                size = np.diff(np.r_[start, len(c)])
                low, high = (np.repeat(who[r[x]], size) for x in (start, start + size - 1))
                not_low = who[r] != low
                later[r[not_low], a] = True
                undecided = is_open[r] & ~not_low
                first[r[~not_low & (low != high) & ~undecided], a] = True
                if undecided.any():
                    u, top = r[undecided], doc[high[undecided]]
                    wh = mix(mix(prefix[is_open.cumsum()[u] - 1, need - 1] + left_hash[u]) + salt[a])
                    begin = self.pos[u] - a
                    for have, more in zip(out, (self.k1[u], self.k2[u], begin, begin + WINDOW, wh.view(np.int64), self.k1[top], self.k2[top]), strict=True):
                        have.append(more)
            if a < LEFT:
                left_hash = mix(left_hash + self.left[:, a] * STEP + np.uint64(1))
        closed = [self._spans(later), self._spans(first)]
        kind = np.concatenate([np.full(len(closed[0][0]), 1), np.full(len(closed[1][0]), 0)]).astype(bool)
        k1, k2, start, stop = (np.concatenate(x) for x in zip(*closed, strict=True))
        more = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        m, blank = len(more[0]), [None] * len(k1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[k1, more[0]]),
                pa.array(np.r_[k2, more[1]]),
                pa.array(np.r_[start, more[2]].astype(np.int32)),
                pa.array(np.r_[stop, more[3]].astype(np.int32)),
                pa.array([*kind.tolist(), *[None] * m], pa.bool_()),
                *(pa.array([*blank, *x.tolist()], pa.int64()) for x in more[4:]),
            ],
            names=["k1", "k2", "start", "stop", "later", "window", "m1", "m2"],
        )

    def _prefix_hashes(self, rows: np.ndarray) -> np.ndarray:
        out, acc = np.empty((int(rows.sum()), WINDOW), np.uint64), mix(self.key[rows].view(np.uint64))
        for j in range(WINDOW):
            acc = mix(acc + self.right[rows, j] * STEP + np.uint64(1))
            out[:, j] = acc
        return out

    def _spans(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """From the first to the last window marked; they overlap, all holding
        the suffix."""
        r = np.flatnonzero(at.any(axis=1))
        most, least = LEFT - at[r, ::-1].argmax(axis=1), at[r].argmax(axis=1)
        return self.k1[r], self.k2[r], self.pos[r] - most, self.pos[r] - least + WINDOW


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches among the sorted entries of one range, group after group. The
    first and the last group may go on in other ranges."""
    held: list[pa.RecordBatch] = []
    first = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        first = key[0] if first is None else first
        cut = int(np.searchsorted(key, key[-1]))  # the last group goes on
        if cut == 0 and held and held[-1].column("key")[-1].as_py() == key[0]:
            held.append(b)
            continue
        if held or cut:
            yield _Entries([*held, b.slice(0, cut)]).matches({int(first)})
        held = [b.slice(cut)]
    if held:
        yield _Entries(held).matches({int(first), held[-1].column("key")[-1].as_py()})


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _minus(spans: list[tuple[int, int]], holes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ``spans`` without the sorted disjoint ``holes``."""
    out, i = [], 0
    for s, e in spans:
        while i < len(holes) and holes[i][1] <= s:
            i += 1
        j = i
        while j < len(holes) and holes[j][0] < e:
            if s < holes[j][0]:
                out.append((s, holes[j][0]))
            s = max(s, holes[j][1])
            j += 1
        if s < e:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, removed = [], []
        for spans in b.column("spans").to_pylist():
            later = _merge([(s["start"], s["stop"]) for s in spans if s["later"]])
            first = _merge([(s["start"], s["stop"]) for s in spans if not s["later"]])
            found.append(_merge(later + first))
            removed.append(_minus(later, first))
        as_rows = lambda x: pa.array([[{"start": s, "stop": e} for s, e in y] for y in x], _SPANS)
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), as_rows(found), as_rows(removed)], names=["k1", "k2", "repeated", "removed"])


def passages(docs: DataFrame) -> DataFrame:
    """``k1, k2, repeated, removed`` (arrays of word spans, stop exclusive) of
    every document with a repeated window."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "suffixes")
    texts = keyed(docs)
    order = ["key", "k1", "k2", "pos"]
    suffixes = scratch.table(texts.mapInArrow(_anchors, "key long, k1 long, k2 long, pos int"), "suffixes")
    shared = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, "k1 long, k2 long, pos int")
    at = shared.groupBy("k1", "k2").agg(F.collect_list("pos").alias("at"))
    at = scratch.table(at, "positions")
    found = texts.join(at, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    entries = found.mapInArrow(_contexts, "key long, right binary, left binary, windows long, k1 long, k2 long, pos int")
    order = ["key", "right", "left", "k1", "k2", "pos"]
    entries = scratch.table(entries, "entries").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "k1 long, k2 long, start int, stop int, later boolean, window long, m1 long, m2 long"
    matched = scratch.table(entries.mapInArrow(_compare, schema), "matched")
    ends = matched.filter("window IS NOT NULL").groupBy("window").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("m1", "m2")).alias("high"))
    ends = ends.filter("low.k1 != high.m1 OR low.k2 != high.m2").select("window", "low")
    later = (F.col("k1") != F.col("low.k1")) | (F.col("k2") != F.col("low.k2"))
    across = matched.filter("window IS NOT NULL").drop("later").join(ends, "window").select("k1", "k2", "start", "stop", later.alias("later"))
    spans = matched.filter("window IS NULL").select("k1", "k2", "start", "stop", "later").unionByName(across)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop", "later")).alias("spans"))
    pair = "array<struct<start:int,stop:int>>"
    return spans.mapInArrow(_settle, f"k1 long, k2 long, repeated {pair}, removed {pair}")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_repeated, n_removed, repeated, removed`` of every document
    with a passage of 50 words or more that another document has too."""
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return passages(docs).select(
        id_of(F.col("k1")).alias("doc_id"), size("repeated").alias("n_repeated"), size("removed").alias("n_removed"), "repeated", "removed"
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after each."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, done = [], 0
    for s, e in spans:
        kept.append(text[done : at[s]])
        done = at[e]
    return "".join([*kept, text[done:]])


def _cutter(text_at: int, size_at: int | None):
    """Cuts ``removed`` out of column ``text_at`` and sets column ``size_at``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            spans = b.column("removed").to_pylist()
            if any(spans):
                texts, keep = columns[text_at].to_pylist(), [True] * b.num_rows
                sizes = columns[size_at].to_pylist() if size_at is not None else []
                for i in (i for i, s in enumerate(spans) if s):
                    texts[i] = cut_words(texts[i], [(s["start"], s["stop"]) for s in spans[i]])
                    keep[i] = not (texts[i] == "" or texts[i].isspace())
                    if size_at is not None:
                        sizes[i] = len(texts[i])
                columns[text_at] = pa.array(texts, pa.string())
                if size_at is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(keep))
            else:
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
            yield b

    return cut


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of all documents but the
    first; ``n_chars``, if there, is set anew. Documents of which no word is
    left go; rows without a cut stay as they are."""
    removed = passages(docs).filter(F.size("removed") > 0).select("k1", "k2", "removed")
    names = docs.columns
    numbered = [F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = whole_rows(docs).join(removed, ["k1", "k2"], "left").select(*numbered, "removed")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    size_at = names.index("n_chars") if "n_chars" in names else None
    cut = rows.mapInArrow(_cutter(names.index("text"), size_at), schema)
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
