"""Similar pairs among the members of overlapping buckets, without all pairs of
a bucket.

Members are sets (of shingle ids); two are similar when 100 |a & b| >= percent
|a | b|. Which members may be similar is given by buckets. Links between sets
that other links already connect are not needed, so a bucket is not expanded:

* in a bucket of up to ``GROUP`` members (later ``GROUP_LATER``, as few of them
  are similar) all pairs are candidates, less those that length and position
  rule out;
* a larger one is divided by size, so that its members differ by two steps of
  the similarity at most, and every member is compared with one hub, the member
  whose other buckets are fullest (the middle of a group of copies). Members near
  the hub are connected through it. Buckets overlap, so in the first round a
  bucket takes the first of the hubs that its members meet anywhere: most members
  then meet one hub, not one per bucket, and stand in one crowd.

Of buckets that hold the same members, small or large, only the first is used;
sizes within one step, for one, make every large bucket twice.

Members that are not near their hub may still be similar to others. What each
differs from the hub by is known from the comparison; elements that most of the
hub's crowd has there are flipped, which gives every member's difference A to
the crowd's majority set without another comparison. Differences to one set say
everything about two members: |a ^ b| = |A| + |B| - 2 |A & B|, and a and b are
similar when that is at most c (|a| + |b|), c = (100 - percent) / (100 +
percent). With slack(a) = c |a| - |A|:

* slack(a) + slack(b) >= 0 proves a and b similar, so all members whose slack
  is at least minus the crowd's largest one are linked to the member that has it;
* every other member shares -(slack(a) + slack(b)) / 2 > 0 elements of its
  difference with whatever it is similar to, b. Of b's difference only the
  elements that others in the crowd have, too, can be shared; the rest, own(b),
  is in a ^ b, so a shares at least -slack(a) - (c |b| - own(b)). A member that
  has too few such elements, even for the largest c |b| - own(b) of the crowd,
  is similar to nobody. For the others a prefix filter on the differences, rarest
  element within the crowd first, finds the pairs: the prefixes are the buckets
  of the next round.

No element is in the differences of more than half a crowd, so buckets halve
from round to round, and what a whole group has in common never brings it
together again. No pair is given up.

Pairs are compared in Python over their texts, once (again only when a pair from
a small bucket later is a member and its hub). A hub's text is sent in as many
copies as its members need tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

GROUP, GROUP_LATER = 8, 128
_PER_TASK = 256  # members that meet one copy of a hub's text
_CELLS = 64  # pieces of the suffix filter

COLUMNS = ["key", "tid", "n", "size", "pos", "away"]


class Member:
    """A text's sorted ids, and how many fall into each of 64 equal ranges."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.cells = np.bincount((ids >> np.uint64(58)).astype(np.int64), minlength=_CELLS)


def _compare(ids: Callable[[str], np.ndarray], percent: int):
    """Arrow function: pairs of texts -> near, and where ``full`` the ids that
    only one of the two has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Member] = {}

        def member(key: bytes, text: str) -> Member:
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                known[key] = Member(ids(text))
            return known[key]

        for b in batches:
            near, found = [], []
            for x, y, s, t, full in zip(*(b.column(c).to_pylist() for c in ("x", "y", "tx", "ty", "full")), strict=True):
                p = member(x, s)
                q = member(y, t)
                n = len(p.ids) + len(q.ids)
                # suffix filter: pieces cut by the same pivots differ at least as much as their sizes
                if not full and (100 + percent) * np.abs(p.cells - q.cells).sum() > (100 - percent) * n:
                    near.append(False)
                    found.append([])
                    continue
                common = np.intersect1d(p.ids, q.ids, assume_unique=True)
                near.append((100 + percent) * len(common) >= percent * n)
                found.append(np.setxor1d(p.ids, q.ids, assume_unique=True).view(np.int64) if full else [])
            cols = [*(b.column(c) for c in ("x", "y", "n", "m", "full")), pa.array(near, pa.bool_()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "n", "m", "full", "near", "d"])

    return run


class Crowds:
    """``ids``: text -> its sorted distinct ids (uint64). ``texts``: a table
    of ``tid`` -> ``tid, text`` of these."""

    def __init__(self, scratch: Scratch, percent: int, ids: Callable[[str], np.ndarray], texts: Callable[[DataFrame], DataFrame]):
        self.scratch, self.percent, self.ids, self.texts = scratch, percent, ids, texts
        self.more, self.less = 100 + percent, 100 - percent

    def needed(self, size_a: Column, size_b: Column, n: Column, m: Column) -> Column:
        """Elements of their differences that a similar pair shares at least."""
        return F.ceil(((size_a + size_b) * self.more - (n + m) * self.less) / (2 * self.more) - F.lit(1e-9))

    def filled(self, buckets: DataFrame, name: str) -> DataFrame:
        """The buckets in which pairs are left to compare, with ``members``."""
        size = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if("away").alias("away_n"))
        size = self.scratch.table(size.filter("members > 1 AND away_n > 0").select("key", "members"), f"{name}_sizes")
        return self.scratch.table(buckets.join(size, "key"), name)

    def by_size(self, buckets: DataFrame, name: str) -> DataFrame:
        step = math.log(100 / self.percent) * (1 + 1e-9)
        here = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
        cut = buckets.withColumn("bin", F.explode(F.array(here, here + 1)))
        return self.filled(cut.withColumn("key", F.xxhash64("key", "bin")).select(*self.columns(buckets)), name)

    def columns(self, buckets: DataFrame) -> list[str]:
        """Buckets of later rounds also have the ``hub`` whose crowd orders them."""
        return [*COLUMNS, "hub"] if "hub" in buckets.columns else COLUMNS

    def different(self, buckets: DataFrame, name: str) -> DataFrame:
        """Of buckets that hold the same members, in one order, the first: every
        pair of them passes there if it does anywhere."""
        order = [c for c in ("hub",) if c in buckets.columns]
        sets = buckets.groupBy("key", *order).agg(F.bit_xor(F.xxhash64("tid")).alias("s1"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("s2"), F.min("pos").alias("first"))
        one = sets.groupBy("s1", "s2", *order).agg(F.min(F.struct("first", "key")).alias("one")).select("one.key")
        return self.scratch.table(buckets.join(one.hint("merge"), "key", "left_semi"), f"{name}_different")

    def small_pairs(self, buckets: DataFrame, group: int, name: str) -> DataFrame:
        few = self.different(buckets.filter(F.col("members") <= group), name)
        a = few.select("key", F.col("tid").alias("x"), "n", F.col("size").alias("sa"), F.col("pos").alias("pa"), F.col("away").alias("wa"))
        b = few.select("key", F.col("tid").alias("y"), F.col("n").alias("m"), F.col("size").alias("sb"), F.col("pos").alias("pb"), F.col("away").alias("wb"))
        least = self.needed(F.col("sa"), F.col("sb"), F.col("n"), F.col("m"))
        length = (F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent) & (F.col("x") < F.col("y"))
        place = (F.col("sa") - F.col("pa") + 1 >= least) & (F.col("sb") - F.col("pb") + 1 >= least)
        pairs = a.join(b, "key").filter(length & place & (F.col("wa") | F.col("wb")))
        return pairs.select("x", "y", "n", "m", F.lit(False).alias("full"), F.lit(1).alias("copies"))

    def hub_pairs(self, buckets: DataFrame, group: int, name: str, shared: bool) -> DataFrame:
        many = self.different(buckets.filter(F.col("members") > group), f"{name}_large").select("key", "tid", "n", "away", "members")
        of_text = Window.partitionBy("tid")  # a row per bucket of one text
        hubs = many.withColumn("score", F.sum("members").over(of_text)).groupBy("key").agg(F.max(F.struct("away", "score", "tid", "n")).alias("top"))
        if shared:
            met = self.scratch.table(many.select("key", "tid").join(hubs, "key"), f"{name}_met")
            hubs = met.withColumn("best", F.max("top").over(of_text)).groupBy("key").agg(F.max("best").alias("top"))
        hubs = self.scratch.table(hubs.select("key", F.col("top.tid").alias("y"), F.col("top.n").alias("m")), f"{name}_hubs")
        pairs = many.select("key", F.col("tid").alias("x"), "n").join(hubs, "key").filter("x != y")
        pairs = self.scratch.table(pairs.groupBy("x", "y").agg(F.first("n").alias("n"), F.first("m").alias("m")), f"{name}_hub_pairs")
        copies = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / _PER_TASK).cast("int").alias("copies"))
        copies = self.scratch.table(copies, f"{name}_copies")  # a row per hub
        return pairs.join(copies, "y").select("x", "y", "n", "m", F.lit(True).alias("full"), "copies")

    def compared(self, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """``x, y, n, m, full, near, d`` of ``pairs``."""
        ys = pairs.groupBy("y").agg(F.max("copies").alias("copies")).join(texts.withColumnsRenamed({"tid": "y", "text": "ty"}), "y")
        ys = ys.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int"))
        both = dealt.join(texts.withColumnsRenamed({"tid": "x", "text": "tx"}), "x").join(ys, ["y", "copy"])
        schema = "x binary, y binary, n long, m long, full boolean, near boolean, d array<long>"
        return self.scratch.table(both.select("x", "y", "n", "m", "full", "tx", "ty").mapInArrow(_compare(self.ids, self.percent), schema), name)

    def differences(self, crowd: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(links, the buckets of the next round) of rows ``hub, hub_n, tid,
        n, near, d``."""
        open_hubs = crowd.filter("NOT near").select("hub", "hub_n").distinct()
        centre = open_hubs.select("hub", F.col("hub").alias("tid"), F.col("hub_n").alias("n"), F.lit(True).alias("near"), F.array().cast("array<long>").alias("d"))
        crowd = crowd.join(open_hubs.select("hub"), "hub", "left_semi").select("hub", "tid", "n", "near", "d").unionByName(centre)
        crowd = self.scratch.table(crowd, f"{name}_open")
        members = self.scratch.table(crowd.groupBy("hub").agg(F.count(F.lit(1)).alias("m")), f"{name}_sizes_of")  # a row per hub
        most = crowd.select("hub", F.explode("d").alias("e")).groupBy("hub", "e").agg(F.count(F.lit(1)).alias("f")).join(members, "hub").filter("2 * f > m")
        most = self.scratch.table(most.groupBy("hub").agg(F.collect_list("e").alias("most")), f"{name}_most")  # at most twice a mean difference
        flipped = F.when(F.col("most").isNull(), F.col("d")).otherwise(F.concat(F.array_except("d", "most"), F.array_except("most", "d")))
        moved = crowd.join(most, "hub", "left").select("hub", "tid", "n", "near", flipped.alias("d")).withColumn("size", F.size("d").cast("long"))
        moved = self.scratch.table(moved.withColumn("slack", F.col("n") * self.less - F.col("size") * self.more), f"{name}_moved")
        best = moved.groupBy("hub").agg(F.max(F.struct("slack", "tid")).alias("best"), F.max(F.when(F.col("hub") == F.col("tid"), F.col("slack"))).alias("hub_slack"))
        best = self.scratch.table(best.select("hub", "hub_slack", F.col("best.slack").alias("most_slack"), F.col("best.tid").alias("middle")), f"{name}_best")
        told = moved.join(best, "hub").withColumn("linked", F.expr("slack + most_slack >= 0"))
        # those near the hub are connected with the linked ones if the hub is
        away = ~F.col("linked") & ~(F.col("near") & (F.col("hub_slack") + F.col("most_slack") >= 0))
        told = self.scratch.table(told.withColumn("away", away), f"{name}_told")
        links = told.filter("linked AND tid != middle").select(F.col("tid").alias("u"), F.col("middle").alias("v"))
        outside = self.scratch.table(told.select("hub", "tid", "away", F.explode("d").alias("e")), f"{name}_outside")
        often = outside.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("f"), F.count_if("away").alias("far"))
        often = self.scratch.table(often.filter("f > 1 AND far > 0").select("hub", "e", "f"), f"{name}_often")
        shared = self.scratch.table(outside.join(often, ["hub", "e"]).select("hub", "tid", "e", "f"), f"{name}_shared")
        # of one text: elements that nobody shares stand before these in its order
        own = shared.groupBy("hub", "tid").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("es")).withColumn("many", F.size("es"))
        known = own.join(told.select("hub", "tid", "n", "size", "slack", "most_slack", "away"), ["hub", "tid"])
        known = self.scratch.table(known.withColumn("free", F.col("n") * self.less - (F.col("size") - F.col("many")) * self.more), f"{name}_known")
        most_free = self.scratch.table(known.groupBy("hub").agg(F.max("free").alias("most_free")), f"{name}_free")
        far = F.ceil((-F.col("slack") - F.col("most_slack")) / (2 * self.more) - F.lit(1e-9))
        close = F.floor((F.col("most_slack") - F.col("slack")) / (2 * self.more) + F.lit(1e-9)) + 1
        least = F.greatest(F.lit(1), F.when(F.col("away"), far).otherwise(close), F.ceil((-F.col("slack") - F.col("most_free")) / self.more - F.lit(1e-9)))
        able = self.scratch.table(known.join(most_free, "hub").withColumn("least", least.cast("int")).filter("many >= least"), f"{name}_able")
        first = F.slice("es", 1, F.col("many") - F.col("least") + 1)
        prefix = able.select("hub", "tid", "n", "size", "many", "away", F.posexplode(first).alias("at", "x"))
        prefix = prefix.select("hub", "tid", "n", "size", "away", (F.col("size") - F.col("many") + F.col("at") + 1).alias("pos"), F.col("x.e").alias("e"))
        return links, prefix.select(F.xxhash64("hub", "e").alias("key"), "hub", "tid", "n", "size", F.col("pos").cast("long").alias("pos"), "away")

    def links(self, buckets: DataFrame) -> DataFrame:
        """``u, v`` that connect the same members as all similar pairs do.

        ``buckets``: ``key``; ``tid`` (binary) and its ``n`` ids; ``size``, the
        ids that the filter counts, and ``pos``, the place from 1 of the one
        that leads here; ``away``, false for members that need no comparison
        with each other."""
        texts, tried, step = None, None, 0
        found = []
        while True:
            name = f"round{step}"
            whole = self.filled(buckets.select(*self.columns(buckets)), name)
            if not whole.take(1):
                break
            group = GROUP_LATER if step else GROUP
            pairs, hubs, large = self.small_pairs(whole, group, name), None, whole.filter(F.col("members") > group)
            if large.take(1):
                sized = self.by_size(large, f"{name}_sized")
                hubs = self.scratch.table(self.hub_pairs(sized, group, name, step == 0), f"{name}_members")
                pairs = pairs.unionByName(self.small_pairs(sized, group, f"{name}_sized")).unionByName(hubs)
            pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.struct("full", "copies", "x", "y", "n", "m")).alias("p")).select("a", "b", "p.*")
            if tried is not None:
                old = tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("full").alias("old_full"))
                pairs = pairs.join(old.groupBy("a", "b").agg(F.max("old_full").alias("old_full")), ["a", "b"], "left").filter("old_full IS NULL OR (full AND NOT old_full)").drop("old_full")
            pairs = self.scratch.table(pairs.drop("a", "b"), f"{name}_pairs")
            if texts is None:  # later rounds compare members of these pairs only
                texts = self.texts(pairs.select(F.col("x").alias("tid")).unionByName(pairs.select(F.col("y").alias("tid"))).distinct())
            now = self.compared(pairs, texts, f"{name}_compared")
            found.append(now.filter("near").select(F.col("x").alias("u"), F.col("y").alias("v")))
            tried = now if tried is None else tried.unionByName(now)
            if hubs is None or not hubs.take(1):
                break
            known = tried.filter("full").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "near", "d")
            crowd = hubs.select(F.col("y").alias("hub"), F.col("m").alias("hub_n"), F.col("x").alias("tid"), "n", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            crowd = self.scratch.table(crowd.join(known, ["a", "b"]).drop("a", "b"), f"{name}_crowd")
            more, buckets = self.differences(crowd, name)
            found.append(more)
            step += 1
        if not found:
            return self.scratch.spark.createDataFrame([], "u binary, v binary")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out
