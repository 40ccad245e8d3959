"""The near matches of a compare are checked once, however often it is read."""

from docsift.operators.matching import classify


def test_reading_the_result_checks_no_pair(spark):
    new = spark.createDataFrame([("n/a.txt", "one line of a text\nand another"), ("n/b.txt", "nothing like it at all, really")], "path string, text string")
    old = spark.createDataFrame([("nc-2024-01-01__00-00-00/window01/t.txt", "one line of a text\nand an other", "s", 0, 1)],
                                "path string, text string, session_id string, session_order int, ctime long")
    out = classify(new, old, "small")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
    assert {(r.new_path, r.status, r.char_diff) for r in out.collect()} == {("n/a.txt", "near", 1), ("n/b.txt", "new", None)}
