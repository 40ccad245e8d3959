"""Chunk signatures for the near-match join.

A candidate text is cut into ``count`` consecutive chunks of ``width``
characters. With difference d <= k at most 2d - |length difference| characters
are inserted or deleted, each of which spoils at most one piece; every other
piece stands unchanged in the new text, at most k places away. So of any 2k + 1
pieces one stands there, and the join looks for a candidate's 2k + 1 rarest only
(the decisive ones). Pieces are doubles of two neighbouring chunks where these
give 2k + 1 doubles: long pieces are rare in any text. The single chunks are
left for candidates whose doubles many others have, such as a common header.
Width and count follow from the length alone, through the largest k any partner
can bring, so the new side knows which widths to look for. The cost per text is
bounded by the square of the logarithm of its length, not by its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .threshold import ThresholdCurve

CHUNK_CHARS = 8  # widest chunk; any width is exact, wider is more selective
MOST_CHUNKS = 4  # times the decisive ones


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression used inside a
    lambda is otherwise evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plan(n: Column, bound: Column) -> tuple[Column, Column]:
    needed = bound.cast("int") * 2 + 1
    whole = F.floor(n / needed).cast("int")
    # a piece of CHUNK_CHARS or more is cut as a double
    width = F.when(whole < CHUNK_CHARS, whole).otherwise(F.least(F.lit(CHUNK_CHARS), F.floor(whole / 2).cast("int")))
    return width, F.when(width > 0, F.least(F.floor(n / width).cast("int"), needed * MOST_CHUNKS)).otherwise(F.lit(0))


def chunk_plan(n: Column, curve: ThresholdCurve) -> Column:
    """(width, count) of a candidate of ``n`` characters: up to four times the
    decisive chunks; count 0 where the text is too
    short to leave any chunk whole."""
    def plan(bound):
        width, count = _plan(n, bound)
        return F.struct(width.alias("width"), count.alias("count"))

    return _let(_let(curve.first_bound(n), lambda u: curve.second_bound(n, u)), plan)


def _hashes(text: Column, width: Column, count: Column, stride: Column, block: int) -> Column:
    """Hashes of ``count`` pieces of ``width`` characters, ``stride`` apart,
    cut from short blocks: a substring costs the length of what it is cut from."""
    def pieces(part, b):
        here = F.least(F.lit(block), count - b * block)
        return F.transform(F.sequence(F.lit(0), here - 1), lambda j: F.xxhash64(F.substring(part, j * stride + 1, width)))

    def cut(head):
        starts = F.sequence(F.lit(0), F.floor((count - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: F.substring(head, b * block * stride + 1, stride * (block - 1) + width))
        return F.flatten(F.transform(parts, pieces))

    head = F.substring(text, F.lit(1), (count - 1) * stride + width)
    return F.when(count > 0, _let(head, cut)).otherwise(F.array().cast("array<bigint>"))


def decisive(n: Column, curve: ThresholdCurve) -> Column:
    """How many of its chunks a candidate is looked up by."""
    return _let(_let(curve.first_bound(n), lambda u: curve.second_bound(n, u)), lambda u: u.cast("int") * 2 + 1)


def doubles(chunks: Column) -> Column:
    """The hashes of a candidate's pieces of two chunks, in order."""
    def pairs(c):
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int") - 1), lambda j: F.xxhash64(c[j * 2], c[j * 2 + 1]))

    return F.when(F.size(chunks) > 1, _let(chunks, pairs)).otherwise(F.array().cast("array<bigint>"))


def double_windows(windows: Column, width: Column) -> Column:
    """The hashes of the pieces of two chunks, one at every place, from those of one."""
    def pairs(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - width - 1), lambda j: F.xxhash64(w[j], w[j + width]))

    return F.when(F.size(windows) > width, _let(windows, pairs)).otherwise(F.array().cast("array<bigint>"))


def chunk_hashes(text: Column, plan: Column) -> Column:
    """array<bigint>: the hashes of a candidate's chunks, in order."""
    return _hashes(text, plan["width"], plan["count"], plan["width"], 8)


def window_hashes(text: Column, width: Column, count: Column) -> Column:
    """array<bigint>: the hashes of the first ``count`` windows of ``width``
    characters, one at every place."""
    return _hashes(text, width, count, F.lit(1), 64)


def partner_plans(n: Column, allowed: Column, curve: ThresholdCurve) -> Column:
    """array<struct<len, width, reach, double>>: every candidate length a new
    text of ``n`` characters can match, with its chunk width, the characters its
    chunks cover and whether its pieces are doubles."""
    low = F.greatest(n - allowed, F.ceil(n / 2).cast("int"), F.lit(1))
    lengths = F.sequence(low, F.least(n + allowed, n * 2))
    firsts = F.transform(lengths, curve.first_bound)
    bounds = F.transform(firsts, lambda u, i: curve.second_bound(low + i, u))

    def one(bound, i):
        width, count = _plan(low + i, bound)
        doubled = count >= (bound.cast("int") * 2 + 1) * 2
        return F.struct((low + i).alias("len"), width.alias("width"), (width * count).alias("reach"), doubled.alias("double"))

    return F.transform(bounds, one)
