"""Operators 11 and 12 against plain restatements, with the edge cases."""

import itertools
import random
import re

from docsift.llm import filter_audit, hard_negatives

KIND = "vec_id long, label int, vector array<long>, anchor boolean, uid string, block int, id long"


def mined(rows, positives=5, negatives=3):
    rows = {(i, lab, tuple(v)): a for i, lab, v, a in rows if None not in (i, lab, v) and None not in v}
    out = []
    for (i, lab, v), anchor in rows.items():
        if not anchor:
            continue
        dot = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        scored = sorted((-dot(w), j, m) for j, m, w in rows if (j, m, w) != (i, lab, v))
        for s, j, m in [x for x in scored if x[2] == lab][:positives]:
            fit = [x for x in scored if x[2] != lab and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "u", 1, 2) for r in rows], KIND)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **more).collect())


def test_negatives_equal_all_scores(spark, monkeypatch):
    rng = random.Random(8)
    centre = [[rng.randint(-90, 90) for _ in range(20)] for _ in range(3)]
    rows = []
    for i in range(900):
        v = [x + rng.randint(-60, 60) for x in centre[i % 3]]
        rows.append((i, (i % 3 + (i % 7 == 0)) % 3, v[: rng.choice((20, 20, 20, 7))], i % 20 == 0))
    rows += [(2000, 1, [], True), (2001, 2, [0] * 20, True), (2002, 1, [10**6] * 20, True), (2003, 1, [-(10**6)] * 20, True)]
    rows += [(None, 1, [1, 2], True), (2004, None, [1, 2], True), (2005, 1, None, True), (2006, 1, [1, None], True), (2007, 1, [3, 4], None)]
    rows += rows[:40]  # repeated rows
    monkeypatch.setattr(hard_negatives, "ROWS", 128)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    want = mined(rows)
    assert len(want) > 300 and found(spark, rows) == want
    assert found(spark, rows, positives=2, negatives=4) == mined(rows, 2, 4)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, 0, [10], True)] + [(i, 0, [10], False) for i in range(1, 9)] + [(i, 1, [9], False) for i in range(20, 29)]
    assert found(spark, rows) == [(0, p, k + 1, 20 + k, 100, 90) for p in range(1, 6) for k in range(3)] == mined(rows)


def test_no_rows_no_anchors(spark):
    assert found(spark, []) == found(spark, [(1, 1, [1], False), (2, 1, [1], None)]) == []
    assert found(spark, [(1, 1, [1], True)]) == []


def test_index_leaves_dimensions_out():
    import numpy as np

    v = np.zeros((4, 64), dtype="<i8")
    v[:, 0], v[1, 60], v[3] = (100, 100, 1, 0), 90, 0
    row = np.arange(4, dtype="<i8").tobytes()
    y = hard_negatives.Block(row, row, np.zeros(4, "<i8").tobytes(), v.tobytes())
    a, r, s = hard_negatives.threshold_join(y, np.array([0]), y, np.array([9000.0]), "same")
    assert sorted(zip(a.tolist(), r.tolist(), s.tolist())) == [(0, 0, 10000), (0, 1, 10000)]  # row 1 without its 60th dimension, rows 2 and 3 not at all


def test_whole_vectors(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(0.1f, -0.1f)), (2, array(1f, NULL)), (3, array(float('nan'))), (4, array(float('inf'))), (5, NULL), (6, array()) AS t(i, e)")
    got = {r.i: r.v for r in df.select("i", hard_negatives.whole_vector(df.e).alias("v")).collect()}
    assert got == {1: [25, -26], 2: None, 3: None, 4: None, 5: None, 6: []}


# 12 -----------------------------------------------------------------------
def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        judged.append((i, lang or "", fails))
    out = {}
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [(i, x) for i, x in mine if not any(x[g] for g in order[:k])]
                lost = [i for i, x in here if x[f]]
                out[part, order, k + 1] = [
                    len(here) - len(lost),
                    len(lost),
                    sum(x[f] for _, x in mine) - len(lost),
                    sum(x[f] and sum(x.values()) == 1 for _, x in mine),
                    sum(i in good for i in lost),
                    sum(i in toxic for i in lost),
                ]
    whole = {(p, f): sum(v[1] for (q, o, k), v in out.items() if q == p and o[k - 1] == f) for p in {k[0] for k in out} for f in "ABCDE"}
    return {k: (*v, whole[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["so", "ÄB", "x\x1fy", "a b", "&", "LOUD", "mi", "tu"]) + str(rng.randint(0, 400))
    texts = [None, "", " \t\n ", "A" * 100_000] + [" ".join(word() for _ in range(rng.choice((5, 99, 100, 140, 400)))) for _ in range(60)]
    texts += [" ".join(["la"] * rng.choice((20, 120))) for _ in range(6)] + [rng.choice(texts) for _ in range(60)]
    docs = [(i, t, rng.choice(("en", "de", None, ""))) for i, t in enumerate(texts)]
    docs += [docs[5], docs[5], (None, texts[7], "fr"), (None, None, None), (5, texts[9], "en")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "p", 2) for x in docs], "doc_id long, text string, lang string, fails int, part string, same int")
    got = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 600 * 4 and {r[:3]: r[3:] for r in rows} == audited(docs, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert {(r.removed, r.shapley) for r in filter_audit.filter_audit(one, labels).filter("substr(filter_order, step, 1) = 'A'").collect()} == {(1, 120)}
