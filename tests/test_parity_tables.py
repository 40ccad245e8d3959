"""The full compare on the driver tables equals the brute-force loop."""

import pytest
from pyspark.sql import functions as F

from brute import brute_compare
from conftest import SF_MID
from docsift.operators.index import index_scope
from docsift.operators.matching import classify
from docsift.sources.tables import inventory


@pytest.mark.parametrize("scope", ["reference", "all"])
def test_compare_equals_brute_force(spark, scope):
    inv = inventory(spark, SF_MID)
    hist = inv.filter(~F.col("is_current"))
    if scope == "reference":
        hist = index_scope(hist)
    new = inv.filter(F.col("is_current"))
    got = {r.new_path: (r.status, r.canonical_path, r.char_diff, r.canonical_hash)
           for r in classify(new, hist, "small").collect()}
    expect = brute_compare([(r.path, r.text) for r in new.select("path", "text").collect()],
                           [(r.path, r.text, r.session_order, r.ctime)
                            for r in hist.select("path", "text", "session_order", "ctime").collect()])
    assert got == expect
    assert sum(v[0] == "near" for v in expect.values()) > 0
