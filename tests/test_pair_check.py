"""The pair check runs once per pair, spread over tasks, and rejects early."""

import random

from docsift.functions import chardiff as C
from docsift.operators.nearjoin import verified_pairs


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _pair(rng):
    a = "".join(rng.choices("abc", k=rng.randint(0, 14)))
    b = list(a)
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5 and b:
            b.pop(rng.randrange(len(b)))
        else:
            b.insert(rng.randint(0, len(b)), rng.choice("abc"))
    return a, "".join(b)


def test_bounds_lose_nothing():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = _pair(rng)
        edits = len(a) + len(b) - 2 * _subsequence(a, b)
        diff = C.char_diff_py(a, b)
        for most in range(8):
            assert C.indels_over_py(a, b, most) == (edits > most), (a, b, most)
            assert C.bounded_char_diff_py(a, b, most) == (diff if diff <= most else -1), (a, b, most)


def test_checked_once_after_the_spread(spark):
    x = spark.createDataFrame([("a", "some text", 9)], "key string, text string, len int")
    y = spark.createDataFrame([("b", "some test", 9)], "key string, text string, len int")
    pairs = spark.createDataFrame([("a", "b", 2)], "new_key string, cand_key string, k int")
    found = verified_pairs(pairs, x, y)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression")
    assert [tuple(r) for r in found.collect()] == [("a", "b", 1)]
