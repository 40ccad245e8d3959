"""Tables of hashed cells that every worker holds: how often a hash occurs, and
whether it occurs at all.

Both have a fixed size whatever the input, and both err to one side only: hashes
that share a cell look more frequent, or present, never less. They are made
where the hashes are: a task packs its cells by block, two bytes each, a block's
rows meet in one task, and the driver receives the finished blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16  # bits of a place within a block: two bytes
MOST_COUNT_BITS, MOST_PRESENT_BITS = 24, 28  # 32 MB each
_HELD = 4_000_000  # cells a task holds before it packs them


def longs(column) -> np.ndarray:
    """The entries of an array<long> column, row after row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of every hash: its topmost ``bits``."""
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _packer(bits: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed():
            cells = np.sort(np.concatenate(held))
            blocks, first = np.unique(cells >> BLOCK, return_index=True)
            places = np.split((cells & ((1 << BLOCK) - 1)).astype(np.uint16), first[1:])
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([p.tobytes() for p in places], pa.binary())], names=["block", "places"])

        for b in batches:
            held.append(cells_of(longs(b.column("hs")), bits))
            size += len(held[-1])
            if size >= _HELD:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return pack


def _counter(present: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for block, places in zip(b.column("block").to_pylist(), b.column("places").to_pylist(), strict=True):
                n = np.bincount(np.frombuffer(places, np.uint16), minlength=1 << BLOCK)
                blocks[block] = blocks[block] + n if block in blocks else n
        pack = (lambda n: np.packbits(n > 0)) if present else (lambda n: np.minimum(n, 65535).astype(np.uint16))
        for block, n in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(n).tobytes()], pa.binary())], names=["block", "cells"])

    return count


class Cells:
    """``counts`` (how often) or ``present`` (whether) of the hashes in the
    array column ``hs`` of a table."""

    def __init__(self, hashes: DataFrame, present: bool, most_bits: int | None = None):
        spark = hashes.sparkSession
        entries = hashes.agg(F.sum(F.size("hs").cast("long"))).first()[0] or 0
        most = most_bits or (MOST_PRESENT_BITS if present else MOST_COUNT_BITS)
        self.entries, self.is_present = entries, present
        self.bits = min(most, max(BLOCK, int(entries * (16 if present else 4)).bit_length()))
        packed = hashes.select("hs").mapInArrow(_packer(self.bits), "block int, places binary")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = packed.repartition(n, "block").mapInArrow(_counter(present), "block int, cells binary").collect() if entries else []
        width = (1 << BLOCK) // 8 if present else 1 << BLOCK
        table = np.zeros((1 << self.bits - BLOCK, width), np.uint8 if present else np.uint16)
        for row in found:
            table[row.block] = np.frombuffer(row.cells, table.dtype)
        try:
            shared = spark.sparkContext.broadcast(table.ravel())
            self._table = lambda: shared.value
        except Exception:  # noqa: BLE001 - Spark Connect: goes with the function
            self._table = table.ravel

    def lookup(self):
        """A function for workers: hashes -> how often, or whether they occur."""
        bits, table, present = self.bits, self._table, self.is_present

        def of(hashes: np.ndarray) -> np.ndarray:
            cells = cells_of(hashes, bits)
            if not present:
                return table()[cells]
            return (table()[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0

        return of
