"""Helpers shared by the operators of this subpackage.

Rows of ``documents`` carry no reliable key: ids can be null or repeated. The
operators therefore identify a row by ``(k1, k2)``: the id (null mapped to the
smallest long) and a 64-bit hash of id and text. Rows that agree in both are
the same document stated twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import configure, scratch_path

NO_ID = -(2**63)


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults of the subpackage: small Arrow batches, because a
    single text can be very long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """``(k1, k2)``, never null."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID)), F.xxhash64(doc_id, text)


def keyed(docs: DataFrame) -> DataFrame:
    """``k1, k2, text`` of every row, and nothing else of the input, so extra
    columns of any name are harmless."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """``k1, k2`` and the whole input row as one struct column ``row``."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def id_of(k1: Column) -> Column:
    """The document id back from ``k1``."""
    return F.when(k1 != F.lit(NO_ID), k1)


def gram_hashes(hashes: Column, n: int) -> Column:
    """One hash per run of ``n`` consecutive entries of an array of longs.

    The array is zipped with itself, shifted; a lambda that looked up its
    neighbours by index would compute the whole array once per entry wherever
    the optimizer substitutes its definition."""
    size = F.size(hashes)
    rows = F.arrays_zip(hashes, *(F.slice(hashes, j + 1, F.greatest(size, F.lit(1))) for j in range(1, n)))
    return F.transform(F.slice(rows, 1, F.greatest(size - (n - 1), F.lit(0))), lambda r: F.xxhash64(r))


class Scratch:
    """Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors; every
    instance owns one fresh subfolder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


_RESIDENT: dict = {}


def resident(key, make):
    """What ``make`` gives, kept by a worker until it asks for another key: the
    tables and caches of one operator do not outlive it in a reused worker."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]
