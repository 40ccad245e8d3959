"""Unified line diff of pairs of texts (P20), set at a time.

Both texts are exploded into lines. Equal lines of a pair are joined, and runs
of them along a diagonal (i - j) are found as gaps and islands, once. Every open
range of a pair then takes its longest run, clipped to the range, the earliest
start in the first text winning, then the earliest in the second; what lies left
and right of it are the open ranges of the next round. That is the order in
which difflib picks its matching blocks, with its rule for popular lines: in a
second text of 200 lines or more, lines that make up over 1 % of it start no
block, but a block grows over them. Rounds are as many as the blocks are
nested, each over all pairs; a pair's work grows with its equal lines.

The script of a pair follows from the blocks: a line of the first text outside
all blocks goes, one of the second comes, the others stay. Lines within ``n`` of
a change are shown, and a run of shown lines is a hunk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, write_scratch

# Line ends of Python's str.splitlines, fixed values.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
POPULAR_FROM, POPULAR_SHARE = 200, 100

_PAIR = ["new_path", "canonical_path"]


def split_lines(text: Column) -> Column:
    """array<string>: the lines with their ends."""
    line = f"[^{LINE_ENDS}]*+(?:\r\n|[{LINE_ENDS}])|[^{LINE_ENDS}]++"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(line), F.lit(0))


def _lines(pairs: DataFrame, text: str, at: str) -> DataFrame:
    found = pairs.select("pid", F.posexplode(split_lines(F.col(text))).alias(at, "line"))
    return found.withColumn("h", F.xxhash64("line"))


def _runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pid, d, start, stop``: maximal runs of equal lines that are not
    popular, lines start..stop-1 of the first text, d further on in the second."""
    sizes = b.groupBy("pid").agg(F.count(F.lit(1)).alias("lines"))
    often = b.groupBy("pid", "h").agg(F.count(F.lit(1)).alias("times")).join(sizes, "pid")
    popular = often.filter((F.col("lines") >= POPULAR_FROM) & (F.col("times") > F.floor(F.col("lines") / POPULAR_SHARE) + 1))
    known = b.join(popular.select("pid", "h"), ["pid", "h"], "left_anti").withColumnRenamed("line", "other")
    met = a.join(known, ["pid", "h"]).filter("line = other").select("pid", "i", (F.col("j") - F.col("i")).alias("d"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("pid", "d").orderBy("i"))
    runs = met.withColumn("island", island).groupBy("pid", "d", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    return runs.drop("island")


def _grown(blocks: DataFrame, hashes: DataFrame) -> DataFrame:
    """Blocks extended to both sides, within their range, while lines are equal."""
    def equal(step: Column, side: int) -> Column:
        i = F.col("i") + step if side > 0 else F.col("i") - 1 - step
        j = F.col("j") + step if side > 0 else F.col("j") - 1 - step
        return F.element_at("ah", (i + 1).cast("int")) == F.element_at("bh", (j + 1).cast("int"))

    def reach(room: Column, first: Column, side: int) -> Column:
        steps = F.when(room > first, F.sequence(first, room - 1)).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.array_min(F.filter(steps, lambda s: ~equal(s, side))), F.greatest(room, first))

    left = reach(F.least(F.col("i") - F.col("alo"), F.col("j") - F.col("blo")), F.lit(0), -1)
    right = reach(F.least(F.col("ahi") - F.col("i"), F.col("bhi") - F.col("j")), F.col("k"), 1)
    out = blocks.join(hashes, "pid").withColumns({"left": left, "right": right})
    return out.select("pid", "alo", "ahi", "blo", "bhi", (F.col("i") - F.col("left")).alias("i"), (F.col("j") - F.col("left")).alias("j"), (F.col("left") + F.col("right")).alias("k"))


def matching_blocks(a: DataFrame, b: DataFrame, scratch: str) -> DataFrame:
    """``pid, i, j, k`` of lines ``a`` (pid, i, line, h) and ``b`` (pid, j,
    line, h): k lines from i on equal those from j on."""
    spark = a.sparkSession
    runs = write_scratch(_runs(a, b), f"{scratch}/runs")
    ordered = lambda side, at: side.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "h"))), lambda x: x["h"]).alias(f"{'a' if at == 'i' else 'b'}h"))
    hashes = write_scratch(ordered(a, "i").join(ordered(b, "j"), "pid"), f"{scratch}/hashes")  # of one text each
    whole = hashes.select("pid", F.lit(0).alias("alo"), F.size("ah").alias("ahi"), F.lit(0).alias("blo"), F.size("bh").alias("bhi"))
    ranges, step, found = whole, 0, []
    while True:
        start = F.greatest("start", "alo", F.col("blo") - F.col("d"))
        stop = F.least("stop", "ahi", F.col("bhi") - F.col("d"))
        first = F.max(F.when(F.col("d").isNotNull() & (stop > start), F.struct((stop - start).alias("k"), (-start).alias("i"), (-start - F.col("d")).alias("j")))).alias("best")
        best = ranges.join(runs, "pid", "left").groupBy("pid", "alo", "ahi", "blo", "bhi").agg(first)
        block = best.select("pid", "alo", "ahi", "blo", "bhi", F.coalesce(-F.col("best.i"), "alo").alias("i"), F.coalesce(-F.col("best.j"), "blo").alias("j"), F.coalesce("best.k", F.lit(0)).alias("k"))
        block = write_scratch(_grown(block, hashes).filter("k > 0"), f"{scratch}/blocks{step}")
        if not block.take(1):
            break
        found.append(block.select("pid", "i", "j", "k"))
        left = F.struct("alo", F.col("i").alias("ahi"), "blo", F.col("j").alias("bhi"))
        right = F.struct((F.col("i") + F.col("k")).alias("alo"), "ahi", (F.col("j") + F.col("k")).alias("blo"), "bhi")
        ranges = block.select("pid", F.explode(F.array(left, right)).alias("r")).select("pid", "r.*").filter("alo < ahi AND blo < bhi")
        step += 1
    out = spark.createDataFrame([], "pid long, i int, j int, k int")
    for f in found:
        out = out.unionByName(f)
    return out


def _script(a: DataFrame, b: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pid, i, j, op`` of every line: ' ' stays, '-' goes, '+' comes. i and j
    say how far the texts are when the line's turn comes."""
    stay = blocks.select("pid", "i", "j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s")).select("pid", (F.col("i") + F.col("s")).alias("i"), (F.col("j") + F.col("s")).alias("j"))
    gone = a.select("pid", "i").join(stay.select("pid", "i", "j"), ["pid", "i"], "left")
    before = Window.partitionBy("pid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    gone = gone.withColumn("here", F.coalesce(F.max("j").over(before) + 1, F.lit(0))).filter("j IS NULL").select("pid", "i", F.col("here").alias("j"), F.lit("-").alias("op"))
    sizes = a.groupBy("pid").agg(F.count(F.lit(1)).cast("int").alias("lines"))
    come = b.select("pid", "j").join(stay.select("pid", "j", "i"), ["pid", "j"], "left")
    after = Window.partitionBy("pid").orderBy("j").rowsBetween(1, Window.unboundedFollowing)
    come = come.withColumn("here", F.min("i").over(after)).filter("i IS NULL").join(sizes, "pid", "left")
    come = come.select("pid", F.coalesce("here", "lines", F.lit(0)).alias("i"), "j", F.lit("+").alias("op"))
    return stay.withColumn("op", F.lit(" ")).unionByName(gone).unionByName(come)


def _span(start: Column, size: Column) -> Column:
    return F.when(size == 1, (start + 1).cast("string")).otherwise(F.concat_ws(",", F.when(size == 0, start).otherwise(start + 1).cast("string"), size.cast("string")))


def unified_diffs(pairs: DataFrame, n_context: int = 3) -> DataFrame:
    """P20: unified line diff of every pair (new_path, canonical_path,
    new_text, canonical_text) as rows (new_path, canonical_path, seq, line).

    Equal texts have no rows. A null text has no lines. Lines keep their ends,
    as difflib's do."""
    scratch = scratch_path(pairs.sparkSession, f"linediff/{uuid.uuid4().hex[:12]}")
    pid = F.xxhash64(*_PAIR).alias("pid")
    given = write_scratch(pairs.select(pid, *_PAIR, "new_text", "canonical_text").dropDuplicates(["pid"]), f"{scratch}/pairs")
    a = write_scratch(_lines(given, "new_text", "i"), f"{scratch}/a")
    b = write_scratch(_lines(given, "canonical_text", "j"), f"{scratch}/b")
    script = _script(a, b, matching_blocks(a, b, scratch))
    turn = Window.partitionBy("pid").orderBy("r")
    script = script.withColumn("r", F.col("i") + F.col("j")).withColumn("nth", F.row_number().over(turn))
    change = F.when(F.col("op") != " ", F.col("nth"))
    last = F.max(change).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(change).over(turn.rowsBetween(0, Window.unboundedFollowing))
    shown = script.withColumns({"last": last, "following": following}).filter(
        (F.col("nth") - F.col("last") <= n_context) | (F.col("following") - F.col("nth") <= n_context))
    shown = shown.withColumn("hunk", F.col("nth") - F.row_number().over(turn))
    shown = write_scratch(shown.select("pid", "i", "j", "op", "r", "hunk"), f"{scratch}/shown")
    of = F.struct("r", "i", "j")
    hunks = shown.groupBy("pid", "hunk").agg(F.min(of).alias("at"), F.count_if(F.col("op") != "+").alias("na"), F.count_if(F.col("op") != "-").alias("nb"))
    head = F.concat(F.lit("@@ -"), _span(F.col("at.i"), F.col("na")), F.lit(" +"), _span(F.col("at.j"), F.col("nb")), F.lit(" @@\n"))
    kept = shown.filter("op != '+'").join(a.select("pid", "i", "line"), ["pid", "i"])
    come = shown.filter("op = '+'").join(b.select("pid", "j", "line"), ["pid", "j"])
    cols = ["pid", "r", "nth", "line"]
    rows = [x.select("pid", "r", F.lit(1).alias("nth"), F.concat("op", "line").alias("line")) for x in (kept, come)]
    rows.append(hunks.select("pid", F.col("at.r").alias("r"), F.lit(0).alias("nth"), head.alias("line")))
    names = given.select("pid", *_PAIR).join(hunks.select("pid").distinct(), "pid", "left_semi")
    for nth, mark, path in ((-2, "--- ", "new_path"), (-1, "+++ ", "canonical_path")):
        rows.append(names.select("pid", F.lit(-1).alias("r"), F.lit(nth).alias("nth"), F.concat(F.lit(mark), path, F.lit("\n")).alias("line")))
    out = rows[0].select(cols)
    for x in rows[1:]:
        out = out.unionByName(x.select(cols))
    seq = (F.row_number().over(Window.partitionBy("pid").orderBy("r", "nth")) - 1).alias("seq")
    return out.select("pid", seq, "line").join(given.select("pid", *_PAIR), "pid").select(*_PAIR, "seq", "line")
