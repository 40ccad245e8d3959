"""Plain restatements of the operators, for small tables."""

from __future__ import annotations

import collections
import itertools


def bag(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def near_classes(rows, least=0.8):
    """{(doc_id, text): class id} by comparing all pairs; rows have ids."""
    keys = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in keys]
    for i, j in itertools.combinations(range(len(keys)), 2):
        if bags[i] and (keys[i][1] == keys[j][1] or similarity(bags[i], bags[j]) >= least):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {k: keys[find(i)][0] for i, k in enumerate(keys)}


def repeats(rows, n=50):
    """{doc_id: (repeated word positions, removed ones)} over distinct ids."""
    seen = collections.defaultdict(set)
    words = {i: (t or "").split() for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - n + 1):
            seen[tuple(w[p : p + n])].add(i)
    out = {}
    for i, w in words.items():
        later, first = set(), set()
        for p in range(len(w) - n + 1):
            owners = seen[tuple(w[p : p + n])]
            if len(owners) > 1:
                (first if min(owners) == i else later).update(range(p, p + n))
        if later | first:
            out[i] = (later | first, later - first)
    return out


def tokens(text):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()


def leaks(docs, items, least=0.8):
    def grams(text, n=5):
        w = tokens(text)
        n = min(n, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    q = {i: (grams(t), min(5, len(tokens(t)))) for i, t in items}
    out = set()
    for d, t in docs:
        g = {n: grams(t, n) for n in range(1, 6)}
        out |= {(d, i) for i, (x, n) in q.items() if x and len(x & g[n]) >= least * len(x)}
    return out


def greedy(word, first, later):
    """Pieces of a marked word by longest match; None if stuck."""
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def segmentations(word, prob):
    """Sum over all segmentations of the product of probabilities."""
    if not word:
        return 1.0
    return sum(prob[word[:k]] * segmentations(word[k:], prob) for k in range(1, len(word) + 1) if word[:k] in prob)
