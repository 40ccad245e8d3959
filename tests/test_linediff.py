"""The set-based unified diff equals difflib's, row by row."""

import difflib
import random

import pytest

from docsift.operators.linediff import split_lines, unified_diffs

KIND = "new_path string, canonical_path string, new_text string, canonical_text string"


def by_difflib(rows, n):
    out = {}
    for x, y, a, b in rows:
        lines = difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), x, y, n=n)
        for k, line in enumerate(lines):
            out[x, y, k] = line
    return out


def by_spark(spark, rows, n):
    got = unified_diffs(spark.createDataFrame(rows, KIND), n).collect()
    out = {(r.new_path, r.canonical_path, r.seq): r.line for r in got}
    assert len(out) == len(got)
    return out


def texts(rng, lines, words):
    base = [rng.choice(words) for _ in range(lines)]
    other = list(base)
    for _ in range(rng.randint(0, 1 + lines // 6)):
        at = rng.randrange(len(other) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            other[at:at] = [rng.choice(words)]
        elif kind == 1:
            del other[at:at + rng.randint(1, 3)]
        elif kind == 2:
            other[at:at + 1] = [rng.choice(words), "new"]
        else:
            k = rng.randrange(len(other) + 1)
            other[k:k] = other[at:at + 4]
    end = rng.choice(("", "\n"))
    return "\n".join(base) + end, "\n".join(other) + rng.choice(("", "\n"))


@pytest.mark.parametrize("n", [3, 1, 0])
def test_equals_difflib(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(40):
        words = [f"w{k}" for k in range(rng.choice((2, 5, 40, 400)))]
        a, b = texts(rng, rng.choice((0, 1, 3, 12, 60)), words)
        rows.append((f"n{i}", f"c{i}", a, b))
    rows += [("p", "q", None, "a\nb"), ("p", "r", "a\nb", ""), ("p", "s", None, None), ("p", "t", "x", "x"), ("t", "p", "x\r\ny\x0bz\x85 \n\n", "x\r\ny\rz\x1c\n"), ("u", "u", "a" * 50_000, "a" * 50_001)]
    want = by_difflib(rows, n)
    assert want and by_spark(spark, rows, n) == want


def test_popular_lines(spark):
    """Second texts of 200 lines or more, with lines that difflib calls popular."""
    rng = random.Random(9)
    rows = []
    for i in range(12):
        words = ["", "}", "  return"] * 40 + [f"w{k}" for k in range(150)]
        a, b = texts(rng, rng.choice((190, 205, 400, 900)), words)
        rows.append((f"n{i}", f"c{i}", a, b))
    rows.append(("only", "popular", "x\n" * 300, "x\n" * 310))
    assert by_spark(spark, rows, 3) == by_difflib(rows, 3)


def test_no_pairs_and_no_python(spark, capsys):
    none = unified_diffs(spark.createDataFrame([], KIND))
    assert none.count() == 0
    none.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan


def test_lines_are_those_of_splitlines(spark):
    rng = random.Random(1)
    cases = ["".join(rng.choices("ab \n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  ", k=rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.lines for r in df.select("i", split_lines(df.t).alias("lines")).collect()}
    assert got == {i: t.splitlines(True) for i, t in enumerate(cases)}
