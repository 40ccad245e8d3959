"""Structured Streaming twins of the batch operators (ST1–ST3).

* ST1 ``first_seen``: drop arriving documents whose capture key was already
  seen. All keys are kept, as in the batch twin W2, so no first arrival is
  lost in whatever order documents come. With a ``delay`` the state is bounded
  by a watermark (``dropDuplicatesWithinWatermark``): documents that come later
  than the delay allows are dropped, first arrivals too.
* ST2 ``compare_exact``: classify arriving documents against the stored hash
  index with a stream–static join (the index is the one the query was started with).
  ``compare_latest`` reads the index anew for every micro-batch, in the version
  that is published then, and says in its rows which one that was. A batch whose
  result stands is not classified again when it is replayed.
* ST3 ``index_upsert``: every micro-batch writes its rows as one delta named
  by its batch id (``foreachBatch``); a replayed batch overwrites its own delta,
  and no batch touches what is stored already. ``merge_upserted`` folds the
  deltas into a new base version, published in one step, and removes them; a
  merge that was cut short is simply repeated, and a batch that is replayed after
  its merge changes nothing. ``load_upserted`` gives the newest row of every path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import capture_hash, content_hash, is_blank, normalize_text
from ..sources.results import _fs, _set_latest, latest_version, read_latest


def first_seen(stream: DataFrame, text_col: str = "text", event_time: str = "ts",
               delay: str | None = None) -> DataFrame:
    """ST1: keep the first arrival of every capture key of a session (empty
    texts skipped). ``delay`` bounds the state and gives up what comes later."""
    keyed = stream.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).withColumn(
        "key", capture_hash(text_col))
    if delay is None:
        return keyed.dropDuplicates(["session_id", "key"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["session_id", "key"])


def compare_exact(stream: DataFrame, canonical_index: DataFrame) -> DataFrame:
    """ST2: stream (path, text) ⟕ static index (content_hash, canonical_path,
    canonical_session) → path, status, canonical_path, new_hash."""
    s = stream.select("path", normalize_text("text").alias("norm"))
    s = s.select("path", F.sha2("norm", 256).alias("content_hash"), is_blank("norm").alias("blank"))
    j = s.join(canonical_index.select("content_hash", "canonical_path", "canonical_session"),
               "content_hash", "left")
    status = (F.when(F.col("blank"), F.lit("skipped"))
              .when(F.col("canonical_path").isNotNull(), F.lit("exact")).otherwise(F.lit("new")))
    return j.select("path", status.alias("status"),
                    F.when(~F.col("blank"), F.col("canonical_path")).alias("canonical_path"),
                    F.when(~F.col("blank"), F.col("content_hash")).alias("new_hash"))


def _newest(rows: DataFrame, *order: str) -> DataFrame:
    fields = [*order, "size", "sha256"]
    return rows.groupBy("path").agg(F.max(F.struct(*fields)).alias("n")).select("path", "n.sha256", "n.mtime", "n.size")


_COLUMNS = ["path", "sha256", "mtime", "size", "batch"]


def _base(root: str) -> str:
    return f"{root.rstrip('/')}-base"


def merged_upto(spark: SparkSession, root: str) -> int:
    """The last batch that the published base holds, -1 without a base: the
    version is the number of batches in it."""
    return (latest_version(spark, _base(root)) or 0) - 1


def upsert_batch(batch: DataFrame, root: str, batch_id: int) -> None:
    """Write one batch of (path, text, mtime, size) as the delta ``batch_id``:
    the newest version of each of its paths. Nothing if it is merged already."""
    if batch_id <= merged_upto(batch.sparkSession, root):
        return
    rows = batch.select("path", content_hash("text").alias("sha256"), F.col("mtime").cast("double"),
                        F.col("size").cast("long"))
    _newest(rows, "mtime").write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the base and of the deltas that it does not hold."""
    kind = "path string, sha256 string, mtime double, size long, batch int"
    fs, at, _ = _fs(spark, root)
    parts = []
    if fs.exists(at) and any(x.getPath().getName().startswith("batch=") for x in fs.listStatus(at)):
        deltas = spark.read.schema(kind).parquet(root)
        parts.append(deltas.filter(F.col("batch") > merged_upto(spark, root)))
    base = read_latest(spark, _base(root))
    if base is not None:
        parts.append(base.select(*_COLUMNS))
    out = parts[0] if parts else spark.createDataFrame([], kind)
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def load_upserted(spark: SparkSession, root: str) -> DataFrame:
    """The newest row (by mtime, then batch) of every path over base and deltas."""
    return _newest(_stored(spark, root), "mtime", "batch")


def merge_upserted(spark: SparkSession, root: str) -> int:
    """Fold all deltas into a new base version; gives the last batch in it.
    Its files are as many as the shuffle partitions, however many batches came."""
    stored = _stored(spark, root)
    last = stored.agg(F.max("batch")).first()[0]
    before = merged_upto(spark, root)
    if last is None or last <= before:
        return before
    fields = ["mtime", "batch", "size", "sha256"]
    newest = stored.groupBy("path").agg(F.max(F.struct(*fields)).alias("n")).select("path", *(f"n.{c}" for c in _COLUMNS[1:]))
    newest.write.mode("overwrite").parquet(f"{_base(root)}/v={last + 1}")
    _set_latest(spark, _base(root), last + 1)
    fs, at, jvm = _fs(spark, root)
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) <= last:
            fs.delete(x.getPath(), True)
    return last


def index_upsert(stream: DataFrame, root: str, checkpoint: str, merge_every: int | None = None):
    """ST3: start the upsert query (caller chooses the trigger via the
    returned writer). ``merge_every`` batches, the deltas are merged."""
    def run(df, batch_id):
        upsert_batch(df, root, batch_id)
        if merge_every and (batch_id + 1) % merge_every == 0:
            merge_upserted(df.sparkSession, root)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def compare_latest(stream: DataFrame, index_root: str, out: str, checkpoint: str):
    """ST2 against an index that changes: ``index_root`` holds its versions
    (``sources.results.write_version``). Results go to ``out`` by batch, with
    ``index_version``; without a published version everything is new."""
    def run(df, batch_id):
        spark, at = df.sparkSession, f"{out.rstrip('/')}/batch={batch_id}"
        fs, done, _ = _fs(spark, f"{at}/_SUCCESS")
        if fs.exists(done):
            return
        version = latest_version(spark, index_root)
        empty = spark.createDataFrame([], "content_hash string, canonical_path string, canonical_session string")
        index = empty if version is None else spark.read.parquet(f"{index_root.rstrip('/')}/v={version}")
        found = compare_exact(df, index).withColumn("index_version", F.lit(version).cast("int"))
        found.write.mode("overwrite").parquet(at)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """A parquet file source with an explicit schema."""
    r = spark.readStream.schema(schema).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(directory)
