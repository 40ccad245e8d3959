"""Buckets that hold the same members bring their pairs together once."""

import numpy as np

from docsift.llm.common import Scratch, prepare
from docsift.llm.crowds import GROUP, Crowds

SCHEMA = "key long, tid binary, n long, size long, pos long, away boolean"


def pairs(spark, rows, schema=SCHEMA, group=GROUP):
    crowds = Crowds(Scratch(prepare(spark), "test"), 80, lambda t: np.empty(0), lambda t: t)
    whole = crowds.filled(spark.createDataFrame(rows, schema), "whole")
    out = crowds.small_pairs(whole, group, "whole").collect()
    return sorted((bytes(r.x), bytes(r.y)) for r in out)


def test_equal_buckets_make_a_pair_once(spark):
    abc = [(k, t, 10, 10, 1, True) for k in range(20) for t in (b"a", b"b", b"c")]
    ab = [(k, t, 10, 10, 1, True) for k in range(100, 110) for t in (b"a", b"b")]
    # before: 20 times each pair of abc and 10 times more a, b
    assert pairs(spark, abc + ab) == [(b"a", b"b"), (b"a", b"b"), (b"a", b"c"), (b"b", b"c")]


def test_the_first_of_equal_buckets_stays(spark):
    # only where both stand at the first place can they share enough of ten elements
    rows = [(9 - p, t, 10, 10, p, True) for p in range(1, 9) for t in (b"a", b"b")]
    assert pairs(spark, rows) == [(b"a", b"b")]


def test_each_crowd_keeps_its_own_order(spark):
    # b is late in the order of the hub p, early in that of q
    rows = [(1, b"a", 10, 10, 1, True, b"p"), (1, b"b", 10, 10, 5, True, b"p"), (2, b"a", 10, 10, 2, True, b"q"), (2, b"b", 10, 10, 1, True, b"q")]
    assert pairs(spark, rows, SCHEMA + ", hub binary") == [(b"a", b"b")]


def test_equal_large_buckets_are_met_once(spark):
    ms = [b"m%02d" % i for i in range(GROUP + 4)]
    crowds = Crowds(Scratch(prepare(spark), "test"), 80, lambda t: np.empty(0), lambda t: t)
    whole = crowds.filled(spark.createDataFrame([(k, t, 10, 10, 1, True) for k in range(20) for t in ms], SCHEMA), "whole")
    sized = crowds.by_size(whole, "sized")  # all in one step of size: every bucket twice
    for shared in (False, True):
        out = crowds.hub_pairs(sized, GROUP, f"first{shared}", shared).collect()
        assert sorted((bytes(r.x), bytes(r.y)) for r in out) == [(t, ms[-1]) for t in ms[:-1]]
    met = spark.read.parquet(f"{crowds.scratch.base}/firstTrue_met")
    assert met.count() == len(ms)  # before: 40 times as many
