"""A header that all texts share brings no pairs of the near join together."""

import random

from pyspark.sql import functions as F

from docsift.functions.threshold import DEFAULT_CURVE
from docsift.operators.index import with_fingerprint
from docsift.operators.nearjoin import candidate_pairs, verified_pairs


def sides(spark, texts, at):
    """As the compare does: fingerprints are written, then joined."""
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{at}/texts")
    fp = with_fingerprint(spark.read.parquet(f"{at}/texts"), chunks=DEFAULT_CURVE)
    fp.select(F.col("content_hash").alias("key"), F.col("norm").alias("text"), F.col("n_len").alias("len"), "chunk_width", "chunks").write.parquet(f"{at}/prints")
    return spark.read.parquet(f"{at}/prints")


def test_common_header(spark, tmp_path):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)).strip()
    header = some(420)
    new = [header + "\n" + some(630) for _ in range(400)]
    old = [header + "\n" + some(630) for _ in range(400)]
    near = [t[:700] + "QZX" + t[703:] for t in new[:20]]
    x, y = sides(spark, new, tmp_path / "new"), sides(spark, old + near, tmp_path / "old")
    pairs = candidate_pairs(x, y)
    assert 20 <= pairs.count() < 1000
    found = verified_pairs(pairs, x, y).collect()
    assert len(found) == 20 and {r.char_diff for r in found} <= {1, 2, 3}
