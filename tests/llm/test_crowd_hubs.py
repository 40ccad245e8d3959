"""Overlapping large buckets share a hub, and no link is lost by it."""

import random

import numpy as np

from docsift.llm.common import Scratch, prepare
from docsift.llm.components import components
from docsift.llm.crowds import GROUP, Crowds

SCHEMA = "key long, tid binary, n long, size long, pos long, away boolean"


def crowds(spark, percent=80, texts=lambda t: t):
    return Crowds(Scratch(prepare(spark), "test"), percent, lambda t: np.unique(np.array(t.split(), dtype=np.uint64)), texts)


def test_overlapping_buckets_share_a_hub(spark):
    ms = [b"m%02d" % i for i in range(10)]
    buckets = {1: [b"p", *ms], 2: ms, 3: [b"p", *(b"q%02d" % i for i in range(20))]}
    one = crowds(spark)
    whole = one.filled(spark.createDataFrame([(k, t, 10, 10, 1, True) for k, ts in buckets.items() for t in ts], SCHEMA), "whole")
    got = one.hub_pairs(whole, GROUP, "first", True).collect()
    # before: bucket 2 had a hub of its own, and its members met two
    assert {(bytes(r.x), bytes(r.y)) for r in got} == {(t, b"p") for t in buckets[1] + buckets[3] if t != b"p"} and len(got) == 30


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    sets = {}
    common = rng.sample(range(1 << 62), 40)
    for f in range(12):
        base = rng.sample(common, 25) + rng.sample(range(1 << 62), 35)
        for i in range(25):
            s = list(base)
            for _ in range(rng.choice([0, 2, 5, 8, 12])):
                s[rng.randrange(len(s))] = rng.choice([rng.randrange(1 << 62), rng.choice(base), rng.choice(common)])
            sets[b"%02d-%02d" % (f, i)] = sorted(set(s))
    texts = spark.createDataFrame([(t, " ".join(map(str, s))) for t, s in sets.items()], "tid binary, text string")
    one = crowds(spark, texts=lambda tids: texts.join(tids, "tid"))
    posted = spark.createDataFrame([(e, t, len(s), len(s), 1, True) for t, s in sets.items() for e in s], SCHEMA)
    roots = {bytes(r.node): bytes(r.root) for r in components(one.links(one.scratch.table(posted, "posted")), one.scratch).collect()}
    of = {t: t for t in sets}
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and 100 * len(x & y) >= 80 * len(x | y) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {t: low if r == high else r for t, r in of.items()}
    assert len(set(of.values())) > 20 and len({t for t, r in of.items() if t != r}) > 50
    assert {t: roots.get(t, t) for t in sets} == of
