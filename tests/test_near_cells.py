"""The near join looks frequencies up in tables of cells and shuffles few rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from docsift.functions.cells import Cells
from docsift.operators import nearjoin
from test_common_header import sides


def test_cells_never_err_low(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows = [(hashes[i:i + 30] + hashes[:3],) for i in range(0, 3000, 30)] + [([],), (None,)]
    df = spark.createDataFrame(rows, "hs array<long>").repartition(5)
    given = np.array(hashes, np.int64)
    for bits in (None, 16):
        often = Cells(df, present=False, most_bits=bits).lookup()(given)
        assert (often >= 1).all() and (often[:3] >= 101).all()
        seen = Cells(df, present=True, most_bits=bits).lookup()
        assert seen(given).all()
        assert seen(given ^ np.int64(0x5A5A5A5A5A5A5A5A)).mean() < 0.2
    assert not Cells(df.limit(0), present=True).lookup()(given).any()


def test_only_windows_that_may_meet_are_kept(spark, tmp_path, monkeypatch):
    """Before, every place of every new text was a row of the join."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)).strip()
    old = [some(900) for _ in range(60)]
    new = [some(900) for _ in range(60)] + [old[0][:500] + "QZX" + old[0][503:]]
    x, y = sides(spark, new, tmp_path / "new"), sides(spark, old, tmp_path / "old")
    tables, write = {}, nearjoin._written

    def written(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(nearjoin, "_written", written)
    pairs = nearjoin.candidate_pairs(x, y)
    found = nearjoin.verified_pairs(pairs, x, y).collect()
    assert len(found) == 1 and found[0].char_diff <= 3
    places = x.agg(F.sum("len")).first()[0]
    assert tables["windows"].count() < places / 4
