"""Operator 13 and the crowds it shares with operator 1, against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
from test_operators import edited, prose

from docsift.llm import crowds, ngram_join

KIND = "doc_id long, text string, sid string, n int, key long, component_id int"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def joined(rows, percent=85):
    """[(doc_id, n_shingles, component)] by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, percent=85):
    df = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], KIND)
    return sorted((tuple(r) for r in ngram_join.similar_documents(df, percent).collect()), key=str)


def dense(rng):
    """Groups that are hard for a hub: the text all copies come from is absent
    or far, cut texts, chains of small steps, parts of one long text."""
    base = [prose(rng, 90) for _ in range(4)]
    texts = [edited(rng, base[0], rng.choice((0.004, 0.01, 0.015, 0.02, 0.04))) for _ in range(90)]
    texts += [" ".join(base[1].split()[: rng.randint(50, 90)]) for _ in range(40)]
    step = base[2]
    for _ in range(60):
        step = edited(rng, step, 0.012)
        texts.append(step)
    lines = [prose(rng, 12) for _ in range(20)]
    texts += [" ".join(rng.sample(lines, 17)) for _ in range(30)] + [" ".join(x for x in lines if rng.random() < 0.93) for _ in range(60)]
    return texts


@pytest.mark.parametrize(("seed", "group"), [(1, 8), (2, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, group):
    rng = random.Random(seed)
    monkeypatch.setattr(crowds, "GROUP", group)
    monkeypatch.setattr(crowds, "GROUP_LATER", group)
    texts = dense(rng) + [prose(rng, rng.randint(1, 30)) for _ in range(40)]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), "so so so so so so", "so so so so", "so so so", "ÄB c", "äb c"]
    rows = [(i + 5, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert found(spark, rows) == joined(rows)


def test_edges(spark):
    rng = random.Random(4)
    long = prose(rng, 60_000)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n ", "one", "One", "a b c", long, long + " so", "x" * 200_000, "a\x1fb c d"])]
    rows += [rows[3], rows[3], rows[0], (None, "one"), (None, None), (None, "only this here without id"), (-3, "ONE"), (3, "other text of three")]
    assert found(spark, rows) == joined(rows)
    assert found(spark, []) == []
    assert found(spark, [(7, None)]) == [(7, 0, 7)]


def test_other_similarity(spark):
    rng = random.Random(5)
    rows = list(enumerate(dense(rng)))
    assert found(spark, rows, 70) == joined(rows, 70)


def test_prefix_is_rare_first():
    grams = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64) * 2)
    counts = np.ones(1 << 20, dtype="<u2")
    counts[ngram_join._cell(grams[:90])] = 50
    got = ngram_join.prefix(grams, counts, 85)
    assert len(got) == 16 and set(grams[90:]) <= set(got[:10])
    for n in (1, 2, 6, 7, 20):  # two sets that overlap enough share a posted shingle
        assert len(ngram_join.prefix(grams[:n], counts, 85)) == n - -(-85 * n // 100) + 1


def test_crowded_group_is_not_expanded(spark):
    """600 copies with own changes: pairs that are compared grow with the copies."""
    rng = random.Random(6)
    base = prose(rng, 120)
    made = {}
    for copies in (150, 600):
        rows = [(i, edited(rng, base, 0.012)) for i in range(copies)]
        run = ngram_join._Run(spark.createDataFrame(rows, "doc_id long, text string"), 85)
        run.result().count()
        made[copies] = sum(spark.read.parquet(f"{run.scratch.base}/round{k}_pairs").count() for k in range(2))
    assert made[600] < 8 * made[150] and made[600] < 600 * 30
