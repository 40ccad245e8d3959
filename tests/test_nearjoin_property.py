"""The pruned near-duplicate join must equal the brute-force loop."""

import random

from pyspark.sql import functions as F

from brute import brute_compare
from docsift.operators.matching import classify

ALPHA = "abcdefghij klmno\n"


def _mutate(rnd, s, edits):
    s = list(s)
    for _ in range(edits):
        op, pos = rnd.random(), rnd.randint(0, len(s))
        if op < 0.33 and s:
            s.pop(min(pos, len(s) - 1))
        elif op < 0.66:
            s.insert(pos, rnd.choice(ALPHA))
        elif s:
            s[min(pos, len(s) - 1)] = rnd.choice(ALPHA)
    return "".join(s)


def _corpus(seed, n_hist=60, n_new=40):
    rnd = random.Random(seed)
    hist = []
    for i in range(n_hist):
        length = rnd.choice([1, 2, 3, 4, 5, 8, 12, 15, 20, 30, 60, 200, 900])
        hist.append("".join(rnd.choice(ALPHA) for _ in range(length)))
    new = []
    for i in range(n_new):
        base = rnd.choice(hist)
        new.append(_mutate(rnd, base, rnd.randint(0, 6)) if rnd.random() < 0.8 else
                   "".join(rnd.choice(ALPHA) for _ in range(rnd.randint(1, 40))))
    return hist, new


def _frames(spark, hist, new):
    h = spark.createDataFrame(
        [(f"nc-2024-01-{1 + i % 9:02d}__00-00-00/window01/t{i}.txt", t, f"s{i % 9}", -(i % 9), i)
         for i, t in enumerate(hist)],
        "path string, text string, session_id string, session_order int, ctime long")
    n = spark.createDataFrame([(f"new/t{i}.txt", t) for i, t in enumerate(new)], "path string, text string")
    return h, n


def test_all_methods_equal_brute_force(spark):
    for seed in (1, 2, 3):
        hist, new = _corpus(seed)
        h, n = _frames(spark, hist, new)
        expect = brute_compare(
            [(f"new/t{i}.txt", t) for i, t in enumerate(new)],
            [(f"nc-2024-01-{1 + i % 9:02d}__00-00-00/window01/t{i}.txt", t, -(i % 9), i)
             for i, t in enumerate(hist)])
        for method in ("chunk", "band", "ratio"):
            got = {r.new_path: (r.status, r.canonical_path, r.char_diff, r.canonical_hash)
                   for r in classify(n, h, "small", method=method).collect()}
            assert got == expect, (seed, method)
        assert any(v[0] == "near" for v in expect.values())


def test_chunks_exact_for_other_curves(spark):
    """Chunk widths and partner bounds are derived from the curve, so other
    coefficients must stay exact too (one flatter, one steeper)."""
    from docsift.functions.threshold import ThresholdCurve

    hist, new = _corpus(5)
    h, n = _frames(spark, hist, new)
    for curve in (ThresholdCurve(0.9, -3.0, 6.0), ThresholdCurve(2.0, -8.0, 12.0),
                  ThresholdCurve(0.0, 0.0, 300.0)):
        expect = brute_compare(
            [(f"new/t{i}.txt", t) for i, t in enumerate(new)],
            [(f"nc-2024-01-{1 + i % 9:02d}__00-00-00/window01/t{i}.txt", t, -(i % 9), i)
             for i, t in enumerate(hist)], curve=curve)
        for method in ("chunk", "band"):
            got = {r.new_path: (r.status, r.canonical_path, r.char_diff, r.canonical_hash)
                   for r in classify(n, h, "small", curve=curve, method=method).collect()}
            assert got == expect, (curve, method)


def test_fuzzy_modes_equal_brute_force(spark):
    """Size gates apply to both sides of a pair, in every mode."""
    hist, new = _corpus(13)
    h, n = _frames(spark, hist, new)
    for mode in ("none", "all", "lte 100", "gt 50"):
        expect = brute_compare(
            [(f"new/t{i}.txt", t) for i, t in enumerate(new)],
            [(f"nc-2024-01-{1 + i % 9:02d}__00-00-00/window01/t{i}.txt", t, -(i % 9), i)
             for i, t in enumerate(hist)], fuzzy=mode)
        got = {r.new_path: (r.status, r.canonical_path, r.char_diff, r.canonical_hash)
               for r in classify(n, h, mode).collect()}
        assert got == expect, mode
