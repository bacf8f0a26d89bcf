"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# All clocks are UTC; AQE re-plans joins and splits skewed partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "ticketspark", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the defaults above. ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there every task runs on the same machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="ticketspark-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def _store(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path in its own type."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any store that Spark reaches."""
    store, place = _store(spark, path)
    store.delete(place, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place) and store.getFileStatus(place).isDirectory()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; none where there is no such folder."""
    store, place = _store(spark, path)
    if not store.exists(place):
        return []
    return sorted(status.getPath().getName() for status in store.listStatus(place) if status.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def _clear(spark: SparkSession, root: str) -> None:
    # A session that has ended takes its intermediates' readers with it; nothing is left to reach the store by.
    if spark.sparkContext._jsc is not None:
        remove(spark, root)


_ROOTS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses. All paths of one process lie in one folder,
    which goes when the process ends."""
    shared = shared_dir(spark)
    if shared not in _ROOTS:
        _ROOTS[shared] = f"{shared}/ticketspark/{uuid.uuid4().hex}"
        atexit.register(_clear, spark, _ROOTS[shared])
    return f"{_ROOTS[shared]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage, and later stages that read it more
    than once, or lose an executor, do not compute it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """For costly work per row: rows are dealt out by ``key``, so that all cores take part however few
    splits the files have."""
    return scan.repartition(partitions(scan.sparkSession), key)
