"""The one-to-one assignment makes no pandas frame per window."""

from docsift.operators.coverage import assign


def test_assign_in_order(spark):
    rows = [(1, 0, 5), (1, 0, 3), (1, 1, 3), (1, 2, 3), (1, 2, 5), (2, 0, 3), (2, 4, 3), (3, None, 1), (3, 1, None), (3, 2, None)]
    rows += [(w, n, t) for w in range(10, 60) for n in range(3) for t in range(2)]
    out = assign(spark.createDataFrame(rows, "window_id long, name_idx long, text_idx long").repartition(5))
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    expect = {(1, 0, 3), (1, 2, 5), (2, 0, 3), (3, 1, None), (3, 2, None)}
    assert {tuple(r) for r in out.collect()} == expect | {(w, n, n) for w in range(10, 60) for n in range(2)}
