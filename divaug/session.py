"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Session defaults that matter for the jobs in this package.  Anything the
# cluster already configured wins: ``builder.config`` is only applied to keys
# that are not set yet (see ``get_session``).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "divaug", driver_memory: str | None = None) -> SparkSession:
    """``driver_memory`` matters only for local mode (the driver JVM is the
    whole engine there); on a cluster it is spark-submit's business."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``divaug`` importable in every Python worker (pandas UDFs,
    grouped-map kernels and state functions are pickled by reference to this
    package).  The package is zipped once per application and registered
    with ``addPyFile``, the way ``--py-files`` distributes code on a cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="divaug-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, files in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


BATCH_BYTES = "4m"   # of rows that a Python worker gets at once


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers Arrow batches of a few MB instead of Spark's 64 MB:
    a worker holds a batch while it reads the next one, so its memory would grow
    with the input until the batches are full.  A value that the session or the
    cluster already has wins."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


_LOCAL_CKPT: dict = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is.  Only
    when it is unset (local tests) a scratch folder is created and handed to
    ``SparkContext.setCheckpointDir`` (the key itself is a static config)."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = _LOCAL_CKPT.get(sc.applicationId)
        if d is None:
            d = tempfile.mkdtemp(prefix="divaug-ckpt-")
            _LOCAL_CKPT[sc.applicationId] = d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for materialised tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def stored(df, tag: str):
    """``df`` written once below the shared folder and read back: cuts lineage
    and survives lost executors."""
    path = shared_path(df.sparkSession, "divaug-runs", f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TRACKED: list = []


def track(df):
    """Remember a persisted intermediate so a long-lived session can release
    it (``release_cached``) once the result that needed it has been used."""
    _TRACKED.append(df)
    return df


def release_cached() -> int:
    n = 0
    while _TRACKED:
        try:
            _TRACKED.pop().unpersist(blocking=False)
            n += 1
        except Exception:  # noqa: BLE001 - session already stopped
            pass
    return n
