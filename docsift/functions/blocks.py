"""Matched-character total of Ratcliff/Obershelp matching blocks, bounded.

Same greedy as ``difflib.SequenceMatcher(None, a, b, autojunk=False)``: take the
longest common substring of the current ranges (earliest start in ``a``, then
earliest start in ``b``), recurse left and right of it. Differences from
difflib are only in *how* the longest match is found:

* small ranges: difflib's own search on the two pieces;
* large ranges: binary search on the length with vectorised polynomial
  hashes (numpy, arithmetic mod 2^64), then the earliest candidates are
  confirmed by comparing the strings. Should a hash collision ever make a
  confirmation fail, the pair is recomputed with difflib itself;
* early exit: once the matches found plus what the open ranges could still
  match fall below ``need``, the answer is "more than k differences".
"""

from __future__ import annotations

import difflib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1           # odd → invertible mod 2^64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SMALL = 4096                            # na * nb below this: difflib's search


class _Collision(Exception):
    pass


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)


class _Hashes:
    """Prefix sums that give the polynomial hash of any substring in O(1),
    vectorised over start positions."""

    def __init__(self, s: str):
        n = len(s)
        c = _codes(s)
        with np.errstate(over="ignore"):
            pw = np.ones(n + 1, dtype=np.uint64)
            ipw = np.ones(n + 1, dtype=np.uint64)
            if n:
                pw[1:] = np.uint64(_BASE)
                ipw[1:] = np.uint64(_BASE_INV)
                pw = np.cumprod(pw, dtype=np.uint64)
                ipw = np.cumprod(ipw, dtype=np.uint64)
            p = np.zeros(n + 1, dtype=np.uint64)
            p[1:] = np.cumsum(c * ipw[:n], dtype=np.uint64)
        self.pw, self.p = pw, p

    def window(self, lo: int, hi: int, length: int) -> np.ndarray:
        """Hashes of s[t:t+length] for t in [lo, hi - length]."""
        starts = np.arange(lo, hi - length + 1)
        with np.errstate(over="ignore"):
            return (self.p[starts + length] - self.p[starts]) * self.pw[starts + length - 1]


def _small_longest(a, b, alo, ahi, blo, bhi):
    """The longest match of two short ranges, by difflib itself."""
    m = difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).find_longest_match()
    return alo + m.a, blo + m.b, m.size


def _hash_longest(a, b, ha: _Hashes, hb: _Hashes, alo, ahi, blo, bhi):
    lo, hi = 0, min(ahi - alo, bhi - blo)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if np.isin(ha.window(alo, ahi, mid), hb.window(blo, bhi, mid)).any():
            lo = mid
        else:
            hi = mid - 1
    if lo == 0:
        return alo, blo, 0
    wa, wb = ha.window(alo, ahi, lo), hb.window(blo, bhi, lo)
    for i in np.flatnonzero(np.isin(wa, wb)):
        for j in np.flatnonzero(wb == wa[i]):
            si, sj = alo + int(i), blo + int(j)
            if a[si:si + lo] == b[sj:sj + lo]:
                return si, sj, lo
    raise _Collision


def matched_chars(a: str, b: str, need: int = 0) -> int:
    """Σ matching-block sizes of (a, b), or -1 as soon as the total can no
    longer reach ``need``."""
    la, lb = len(a), len(b)
    ha = hb = None
    queue = [(0, la, 0, lb)]
    total = 0
    potential = min(la, lb)
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        potential -= min(ahi - alo, bhi - blo)
        if (ahi - alo) * (bhi - blo) <= _SMALL:
            i, j, k = _small_longest(a, b, alo, ahi, blo, bhi)
        else:
            if ha is None:
                ha, hb = _Hashes(a), _Hashes(b)
            i, j, k = _hash_longest(a, b, ha, hb, alo, ahi, blo, bhi)
        if k:
            total += k
            if alo < i and blo < j:
                queue.append((alo, i, blo, j))
                potential += min(i - alo, j - blo)
            if i + k < ahi and j + k < bhi:
                queue.append((i + k, ahi, j + k, bhi))
                potential += min(ahi - i - k, bhi - j - k)
        if total + potential < need:
            return -1
    return total


def bounded_diff(a: str, b: str, k: int) -> int:
    """max(len) - matched when that is <= k, else -1; exact (falls back to
    difflib if a hash collision is ever detected)."""
    longest = max(len(a), len(b))
    try:
        m = matched_chars(a, b, longest - k)
    except (_Collision, UnicodeEncodeError):
        sm = difflib.SequenceMatcher(None, a, b, autojunk=False)
        m = sum(bl.size for bl in sm.get_matching_blocks())
    if m < 0:
        return -1
    d = longest - m
    return d if d <= k else -1
