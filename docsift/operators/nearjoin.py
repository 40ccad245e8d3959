"""Near-duplicate candidate generation (J2), verification (J3) and best match
(J4) as equi-joins.

A pair (new text x, candidate y) is a near match when

    max(|x|,|y|) <= 2 * min(|x|,|y|)                       (ratio gate)
    d(x, y) <= k,  k = min(T(|x|), T(max(|x|,|y|)))          (two thresholds)

with d = max length - matched characters of difflib's matching blocks. The
matching blocks are an order-preserving common subsequence, so x and y differ
by at most 2d - |Δ| <= 2k insertions and deletions. That gives one lossless
generator (``functions.chunks``): y is cut into pieces, and all but 2k - |Δ| of
them stand in x within k places, so one of y's 2k + 1 rarest does (prefix
filter; rarest by the number of candidates that have the piece). These meet x's
windows in an equi-join on their hash. Pieces are as long as 2k + 1 of them
allow, up to 16 characters, so texts that merely use the same words do not meet.
Candidates whose pieces of that length many others have are looked up by pieces
of half of it, of which there are more to choose from: a header that many texts
share is among the frequent ones and brings no pair together. Texts too short to
keep a piece whole (a handful of characters) are joined on their length.

'band' (equi-join on candidate length within the band) and 'ratio' (every pair
inside the 2x ratio, the unpruned plan) serve the bench and the tests.

How many candidates have a piece is read from a table of hashed cells
(``functions.cells``): pieces that share a cell look more frequent, which changes
the choice but loses no pair. Such tables also say which hashes the other side
may hold, so that of the windows, one per character, few are shuffled. What the
generator joins is written below ``spark.checkpoint.dir`` when it is called.
After the generator come the exact cheap predicates; only then the texts of the
remaining pairs are read and go to the exact bounded matcher (``functions.blocks``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import Cells, longs
from ..functions.chardiff import bounded_char_diff
from ..functions.chunks import decisive, double_windows, doubles, partner_plans, window_hashes
from ..functions.threshold import DEFAULT_CURVE, ThresholdCurve
from ..session import scratch_path, write_scratch


def _written(df: DataFrame, name: str) -> DataFrame:
    return write_scratch(df, scratch_path(df.sparkSession, f"near/{name}-{uuid.uuid4().hex[:12]}"))


# A candidate whose decisive doubles are had by more candidates than this, on
# average, may be looked up by its single chunks instead.
CROWDED = 8


def _new_windows(new: DataFrame, plans: DataFrame, double: bool) -> DataFrame:
    """``new`` (id, len, t, text) and ``plans`` (len, width, reach) → a row
    per text and width: id, len, hs, one at every place of a piece that a
    partner can have."""
    w = new.join(plans, "len")
    count = F.least(F.col("len"), F.col("reach") + F.col("t")) - F.col("width") + 1
    hashes = window_hashes(F.col("text"), F.col("width"), count.cast("int"))
    if double:
        hashes = double_windows(hashes, F.col("width"))
    return w.select("id", "len", hashes.alias("hs"))


_RARE = "id long, len int, single boolean, cost long, width int, decisive int, hs array<long>, places array<int>, chunks array<long>"


def _rarest(often, by_chunks: bool):
    """Arrow function: the ``decisive`` rarest pieces (``hs`` at ``places``) of
    every candidate, by ``often`` (``Cells.lookup``), and their cost. Crowded
    ones keep their chunks; ``by_chunks`` looks them up by these where that is cheaper."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = often(longs(b.column("chunks" if by_chunks else "hs")))
            rows, at = b.to_pylist(), 0
            for r in rows:
                pieces = r["chunks"] if by_chunks else r["hs"]
                n = len(pieces or ())
                f, at = many[at:at + n].astype(np.int64), at + n
                if by_chunks and not n:
                    continue
                order = np.argsort(f, kind="stable")[:r["decisive"]]
                cost = int(f[order].sum())
                if by_chunks:
                    r["chunks"] = None
                    if cost >= r["cost"]:
                        continue
                    r["single"] = True
                elif r["cost"] == 0 or cost <= len(order) * CROWDED:  # no doubles, or not crowded
                    r["chunks"] = None
                step = r["width"] * (1 if by_chunks or r["cost"] == 0 else 2)
                r["cost"], r["hs"], r["places"] = cost, [pieces[i] for i in order], [int(i) * step for i in order]
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return run


def rare_pieces(cand: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE) -> DataFrame:
    """``id, len, single, hs, places`` of every candidate's decisive pieces;
    ``single``: single chunks of a candidate that could have doubles. No piece
    is shuffled: how often it occurs is looked up in a table of cells."""
    few = decisive(F.col("len"), curve)
    doubled = F.size("chunks") >= few * 2
    rows = cand.filter(F.size("chunks") > 0).select(
        F.xxhash64("key").alias("id"), F.col("len").cast("int").alias("len"), F.lit(False).alias("single"),
        doubled.cast("long").alias("cost"), F.col("chunk_width").cast("int").alias("width"), few.cast("int").alias("decisive"),
        F.when(doubled, doubles(F.col("chunks"))).otherwise(F.col("chunks")).alias("hs"),
        F.lit(None).cast("array<int>").alias("places"), F.when(doubled, F.col("chunks")).alias("chunks"))
    rows = _written(rows.mapInArrow(_rarest(Cells(rows, present=False).lookup(), False), _RARE), "rare")
    crowded = Cells(rows.filter("chunks IS NOT NULL").select(F.col("chunks").alias("hs")), present=False)
    if crowded.entries:
        rows = _written(rows.mapInArrow(_rarest(crowded.lookup(), True), _RARE), "single")
    return rows.select("id", "len", "single", "hs", "places")


def _present(seen):
    """Arrow function: a row ``id, len, single, place, h`` per hash that
    ``seen`` has; the place is the hash's own where there are no ``places``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = longs(b.column("hs"))
            n = np.diff(b.column("hs").offsets.to_numpy())
            at = np.flatnonzero(seen(hs))
            row = np.repeat(np.arange(len(n)), n)[at]
            places = b.column("places").flatten().to_numpy(zero_copy_only=False) if b.column("places").null_count == 0 else np.arange(len(hs)) - np.repeat(np.cumsum(n) - n, n)
            of = [b.column(c).take(pa.array(row)) for c in ("id", "len", "single")]
            yield pa.RecordBatch.from_arrays([*of, pa.array(places[at].astype(np.int32)), pa.array(hs[at])], names=["id", "len", "single", "place", "h"])

    return run


def _kept(rows: DataFrame, seen: Cells) -> DataFrame:
    return rows.select("id", "len", "single", "hs", "places").mapInArrow(_present(seen.lookup()), "id long, len int, single boolean, place int, h long")


def chunk_pairs(new: DataFrame, cand: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE) -> DataFrame:
    """Pairs that share a decisive piece of the candidate, each once.

    Texts go by a hash of their key here; it leads back to every key that has
    it. Only windows that some candidate's decisive pieces may hold, and only
    pieces that some such window may hold, are shuffled."""
    keyed = new.select(F.col("key").alias("new_key"), F.xxhash64("key").alias("id"), F.col("len").cast("int").alias("len"), "text",
                       curve.column("len").alias("t"))
    keyed = _written(keyed, "new")
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plans = keyed.select(F.col("len").alias("n_len"), "t").distinct().repartition(parts, "n_len")  # a row per length
    plans = _written(plans.select("n_len", F.explode(partner_plans(F.col("n_len"), F.col("t"), curve)).alias("p")).select("n_len", "p.*"), "plans")
    rows = rare_pieces(cand, curve)

    def windows(of, double):
        of = of.filter("width > 0").groupBy(F.col("n_len").alias("len"), "width").agg(F.max("reach").alias("reach"))
        return _new_windows(keyed, of, double)

    lengths = rows.filter("single").select("len").distinct()
    wanted = windows(plans.filter("double"), True).unionByName(windows(plans.filter("NOT double"), False))
    wanted = wanted.withColumn("single", F.lit(False)).unionByName(
        windows(plans.filter("double").join(lengths, "len", "left_semi"), False).withColumn("single", F.lit(True)))
    wanted = wanted.withColumn("places", F.lit(None).cast("array<int>"))
    wanted = _written(_kept(wanted, Cells(rows, present=True)), "windows")
    rows = _kept(rows, Cells(wanted.select(F.array("h").alias("hs")), present=True))
    wanted = wanted.select("h", "single", F.col("id").alias("new_id"), F.col("len").alias("n_len"), F.col("place").alias("at"), curve.column("len").alias("t"))
    rows = rows.select("h", "single", F.col("id").alias("cand_id"), F.col("len").alias("c_len"), F.col("place").alias("start"))
    met = wanted.join(rows, ["h", "single"]).filter(
        (F.abs(F.col("at") - F.col("start")) <= F.col("t"))
        & (F.abs(F.col("n_len") - F.col("c_len")) <= F.col("t")))
    met = _written(met.select("new_id", "cand_id", "n_len", "c_len").distinct(), "met")
    c = cand.select(F.col("key").alias("cand_key"), F.xxhash64("key").alias("cand_id"), F.col("len").alias("c_len"), F.size("chunks").alias("pieces"))
    n = keyed.select("new_key", F.col("id").alias("new_id"), F.col("len").alias("n_len"))
    cols = ["new_key", "cand_key", "n_len", "c_len"]
    met = met.join(n, ["new_id", "n_len"]).join(c, ["cand_id", "c_len"]).select(cols)

    # candidates too short for a chunk: by their exact length
    short = n.select("new_key", "n_len").join(plans.filter("width = 0").select("n_len", F.col("len").alias("c_len")), "n_len")
    short = short.join(c.filter("pieces = 0").select("cand_key", "c_len"), "c_len")
    return met.unionByName(short.select(cols))


def band_pairs(new: DataFrame, cand: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE) -> DataFrame:
    """Every pair within the ratio gate and the length band |Δ| <= T(new),
    via an equi-join on candidate length (new texts fan out to 2T+1 lengths)."""
    t = curve.column("len")
    n = new.select(
        F.col("key").alias("new_key"), F.col("len").alias("n_len"), t.alias("n_t"),
        F.explode(F.sequence(F.greatest(F.col("len") - t, F.ceil(F.col("len") / 2).cast("int"), F.lit(1)),
                             F.least(F.col("len") + t, F.col("len") * 2))).alias("c_len"))
    c = cand.select(F.col("key").alias("cand_key"), F.col("len").alias("c_len"), t.alias("c_t"))
    # Few rows meet in many pairs: a numbered repartition is not coalesced by AQE.
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, c = n.repartition(parts, "c_len"), c.repartition(parts, "c_len")
    return n.join(c, "c_len").select("new_key", "cand_key", "n_len", "c_len", "n_t", "c_t")


def ratio_pairs(new: DataFrame, cand: DataFrame) -> DataFrame:
    """Every pair within the 2x length ratio (the unpruned plan), via an
    equi-join on the power-of-two length bucket (new texts fan out to 3)."""
    bucket = lambda c: F.floor(F.log2(c.cast("double"))).cast("int")
    n = new.select(F.col("key").alias("new_key"), F.col("len").alias("n_len"),
                   F.explode(F.sequence(bucket(F.col("len")) - 1, bucket(F.col("len")) + 1)).alias("b"))
    c = cand.select(F.col("key").alias("cand_key"), F.col("len").alias("c_len"),
                    bucket(F.col("len")).alias("b"))
    return n.join(c, "b").select("new_key", "cand_key", "n_len", "c_len")


def pair_filter(pairs: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE) -> DataFrame:
    """Exact cheap predicates: ratio gate, effective threshold k, band. Pairs
    that bring the curve at both lengths (``n_t``, ``c_t``) need it no more."""
    hi = F.greatest("n_len", "c_len")
    lo = F.least("n_len", "c_len")
    if "n_t" in pairs.columns:
        k = F.least("n_t", F.when(F.col("n_len") >= F.col("c_len"), F.col("n_t")).otherwise(F.col("c_t")))
    else:
        k = F.least(curve.column("n_len"), curve.column(hi))
    return (
        pairs.filter(hi <= lo * 2)
        .withColumn("k", k)
        .filter(F.abs(F.col("n_len") - F.col("c_len")) <= F.col("k"))
        .drop("n_t", "c_t")
    )


def raw_pairs(new: DataFrame, cand: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE,
              method: str = "chunk") -> DataFrame:
    """Generator output before the exact predicates, each pair once."""
    if method == "chunk":
        return chunk_pairs(new, cand, curve)
    if method == "band":
        return band_pairs(new, cand, curve)
    if method == "ratio":
        return ratio_pairs(new, cand)
    raise ValueError(f"unknown candidate method {method!r}")


def candidate_pairs(new: DataFrame, cand: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE,
                    method: str = "chunk") -> DataFrame:
    """Candidate pairs (new_key, cand_key, n_len, c_len, k), each once.

    ``new`` has columns key, text (normalised), len; ``cand`` has key, len,
    chunk_width and chunks (see ``index.with_fingerprint``). Every method is
    exact after verification; they differ in how many pairs reach it."""
    return pair_filter(raw_pairs(new, cand, curve, method), curve)


def verified_pairs(pairs: DataFrame, new: DataFrame, cand: DataFrame,
                   cand_source: DataFrame | None = None) -> DataFrame:
    """The bounded difflib check; keep diff <= k.

    Candidate texts come from ``cand`` when it has them. Otherwise the pairs
    are written out with the path of each candidate and the texts are read
    from ``cand_source`` (path, text): the planner then knows the bytes of the
    pairs and broadcasts their paths only where these are small.

    Output: new_key, cand_key, char_diff."""
    spark = pairs.sparkSession
    if "text" in cand.columns:
        ct = cand.select(F.col("key").alias("cand_key"), F.col("text").alias("c_text"))
    else:
        from ..functions.text import normalize_text

        pairs = _written(pairs.join(cand.select(F.col("key").alias("cand_key"), F.col("first_path").alias("path")), "cand_key"), "pairs")
        needed = pairs.select("cand_key", "path").distinct()
        texts = cand_source.select("path", "text").join(needed, "path").select(
            "cand_key", normalize_text("text").alias("c_text"))
        # a path can stand in the history in several versions: the key is the
        # hash of the one that was meant
        ct = texts.filter(F.sha2("c_text", 256) == F.col("cand_key")).dropDuplicates(["cand_key"])
    nt = new.select(F.col("key").alias("new_key"), F.col("text").alias("n_text"))
    with_text = pairs.select("new_key", "cand_key", "k").join(nt, "new_key").join(ct, "cand_key")
    # The pairs are few but each check is costly: spread them over
    # shuffle-partitions tasks (a numbered repartition is not coalesced by AQE).
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_text = with_text.repartition(n, "new_key", "cand_key")
    scored = with_text.select(
        "new_key", "cand_key",
        bounded_char_diff(F.col("n_text"), F.col("c_text"), F.col("k")).alias("char_diff"))
    return scored.filter(F.col("char_diff") >= 0)


def best_match(verified: DataFrame, cand_order: DataFrame) -> DataFrame:
    """Per new text the smallest diff, ties to the first candidate in
    index order. ``cand_order``: cand_key, first_pos. Partial-aggregated
    (min over a struct), no window."""
    v = verified.join(cand_order, "cand_key")
    best = v.groupBy("new_key").agg(
        F.min(F.struct("char_diff", "first_pos", "cand_key")).alias("_b"))
    return best.select("new_key", F.col("_b.cand_key").alias("cand_key"),
                       F.col("_b.char_diff").alias("char_diff"))


FUNNEL = ("candidates", "verified")


def funnel_observations() -> dict:
    """One ``Observation`` per pruning stage (the batch equivalent of the
    progress callbacks: pairs reaching each check). Read them with
    ``obs[name].get`` after the result has been computed."""
    from pyspark.sql import Observation

    return {name: Observation(f"near_{name}") for name in FUNNEL}


def _observe(df: DataFrame, observations: dict | None, name: str) -> DataFrame:
    if not observations:
        return df
    return df.observe(observations[name], F.count(F.lit(1)).alias("pairs"))


def near_matches(new: DataFrame, cand: DataFrame, cand_order: DataFrame,
                 curve: ThresholdCurve = DEFAULT_CURVE, method: str = "chunk",
                 observations: dict | None = None, cand_source: DataFrame | None = None) -> DataFrame:
    """J2 → J3 → J4, optionally counting the pairs at every stage."""
    pairs = _observe(candidate_pairs(new, cand, curve, method), observations, "candidates")
    verified = verified_pairs(pairs, new, cand, cand_source)
    return best_match(_observe(verified, observations, "verified"), cand_order)
