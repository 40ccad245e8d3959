"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint dir, executor memory) belong
to whoever launches the job; these helpers only fill in what is unset so the
library also runs in local tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library relies on; applied only when the session has no value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "docsift", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in library defaults that the session does not set itself."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(side: DataFrame) -> DataFrame:
    """``side`` marked for broadcast when its measured bytes allow it, else as
    it is (a shuffle join). The measuring reads ``side`` once."""
    row_bytes = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in side.schema), F.lit(0))
    size = side.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Arrow UDFs are pickled by reference, so every executor must be able to
    import the package. A zip of its sources is added to the application
    (Spark serves it to the executors); nothing needs to be installed there.
    """
    try:
        app, add = spark.sparkContext.applicationId, spark.sparkContext.addPyFile
    except Exception:  # noqa: BLE001 - Spark Connect
        app, add = spark.session_id, lambda path: spark.addArtifacts(path, pyfile=True)
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docsift-ship-")) / f"{package.name}-sources.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    add(str(target))
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the launcher to shared storage and is used
    as is. Only with a local master (tests), when it is unset, a scratch folder
    is created; elsewhere a folder of this machine would be of no use.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="docsift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_scratch(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``. The shuffle files of the write go when it
    ends, not when the driver's memory happens to be collected: nothing runs the
    written plan again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if before is None:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
