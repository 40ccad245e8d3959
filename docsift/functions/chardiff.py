"""Python-worker functions: character difference (P19) and unified diff (P20).

These are the only places where per-row Python runs. They are Arrow-batched
and are applied to *pruned candidate pairs* only, never to all pairs.
"""

from __future__ import annotations

import difflib
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import bounded_diff


def char_diff_py(a: str, b: str) -> int:
    """``max(len a, len b) - matched`` with Ratcliff/Obershelp matching blocks
    (difflib, autojunk off). Direction matters: a is the new text."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return max(len(a), len(b)) - sum(bl.size for bl in m.get_matching_blocks())


def bag_bound_py(a: str, b: str) -> int:
    """Lower bound of char_diff from the character multisets."""
    ca, cb = Counter(a), Counter(b)
    if len(ca) > len(cb):
        ca, cb = cb, ca
    common = sum(min(n, cb.get(ch, 0)) for ch, n in ca.items())
    return max(len(a), len(b)) - common


SPOT_CHARS = 8  # pieces of the second text that are looked for in the first


def spoilt_pieces_py(a: str, b: str, k: int) -> bool:
    """True when a char_diff of up to k is impossible: it leaves at most
    2k - |length difference| insertions and deletions, each of which spoils one
    piece of b; the others stand in a at most k places away."""
    most = 2 * k - abs(len(a) - len(b))
    width = min(SPOT_CHARS, len(b) // (most + 1))
    if width < 1:
        return False
    spoilt = 0
    for j in range(0, len(b) - width + 1, width):
        if a.find(b[j:j + width], max(0, j - k), j + width + k) < 0:
            spoilt += 1
            if spoilt > most:
                return True
    return False


def indels_over_py(a: str, b: str, most: int) -> bool:
    """True when more than ``most`` insertions and deletions lead from b to a
    (furthest reach per diagonal and number of edits, as diff does)."""
    n, m = len(a), len(b)
    aim = n - m
    if abs(aim) > most:
        return True
    reach = {1: 0}
    for edits in range(most + 1):
        left = most - edits  # edits that remain must lead back to the last diagonal
        low, high = max(-edits, aim - left), min(edits, aim + left)
        low += (low + edits) % 2
        new = {}
        for d in range(low, high + 1, 2):
            up, down = reach.get(d + 1, -1), reach.get(d - 1, -2) + 1
            x = up if up > down else down
            if x < 0 or x > n or x - d > m:
                continue
            y = x - d
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            if x == n and y == m:
                return False
            new[d] = x
        reach = new
    return True


def bounded_char_diff_py(a: str, b: str, k: int) -> int:
    """char_diff when it is <= k, else -1 (cheap bounds first, then the
    exact bounded matcher of ``blocks``)."""
    if a is None or b is None:
        return -1
    if abs(len(a) - len(b)) > k:
        return -1
    if spoilt_pieces_py(a, b, k) or bag_bound_py(a, b) > k or indels_over_py(a, b, 2 * k - abs(len(a) - len(b))):
        return -1
    return bounded_diff(a, b, k)


@F.pandas_udf(T.IntegerType())
def bounded_char_diff(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
    """Arrow UDF: char_diff(a, b) if <= k else -1."""
    return pd.Series([bounded_char_diff_py(x, y, int(z)) for x, y, z in zip(a, b, k)], dtype="int32")


# Spark moves a filter on a deterministic column in front of the repartition
# before it: the pairs would be checked in few tasks, and then once more.
bounded_char_diff = bounded_char_diff.asNondeterministic()


@F.pandas_udf(T.IntegerType())
def char_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow UDF: unbounded char_diff (for small fixtures and reports)."""
    return pd.Series([char_diff_py(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def unified_diff_lines(a: str, b: str, from_name: str, to_name: str, n: int = 3) -> list[str]:
    """P20: unified line diff of two normalised texts (lines keep their ends)."""
    return list(difflib.unified_diff(
        (a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True),
        fromfile=from_name, tofile=to_name, n=n))


def unified_diff_udtf():
    """Python UDTF emitting (seq, line) rows of a unified diff per pair."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="seq: int, line: string")
    class UnifiedDiff:
        def eval(self, a: str, b: str, from_name: str, to_name: str, n: int):
            for i, line in enumerate(unified_diff_lines(a, b, from_name, to_name, n)):
                yield i, line

    return UnifiedDiff
