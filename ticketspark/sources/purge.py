"""Owners' rows taken out of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.session import exists, folders, remove, written
from ticketspark.sources.tables import RUN

#: Where the rows that stay wait until all of them are written.
STAGED = "_purge"


def _run_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), f"/{RUN}=([^/]*)/[^/]*$", 1)


def _finish(spark: SparkSession, path: str) -> None:
    """Put what an earlier try has written completely into place; drop what it has not."""
    for run in folders(spark, f"{path}/{STAGED}"):
        staged, target = f"{path}/{STAGED}/{run}", f"{path}/{run}"
        if exists(spark, f"{path}/{STAGED}/_READY"):
            remove(spark, target)
            _move(spark, staged, target)
    remove(spark, f"{path}/{STAGED}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(source)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).rename(place, jvm.Path(target))


def _mark(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, key: str) -> list[str]:
    """Rewrite the run folders of ``path`` that hold a key of ``gone``, without those rows; returns their names.

    All other folders stay as they are, files, names and times. The rows that stay are written aside first; only
    when all are there do they take the folders' places, one rename each, so a try that fails leaves either the old
    rows or a complete set that the next try puts into place. A folder of which nothing stays is left without rows.
    """
    _finish(spark, path)
    runs = [name for name in folders(spark, path) if name.startswith(f"{RUN}=")]
    if not runs:
        return []
    keys = gone.select(F.col(key).alias("_gone")).where("_gone is not null").distinct()
    table = spark.read.option("basePath", path).parquet(*[f"{path}/{run}" for run in runs])
    # Who goes is found once for all folders, on the key alone; a folder then meets its own keys only.
    places = table.select(key, _run_of_file().alias("_run")).join(keys, F.col(key) == F.col("_gone"), "left_semi")
    held = written(places.select(F.col(key).alias("_gone"), "_run").distinct(), "purge-keys")
    # One row per folder that changes.
    hit = sorted(r["_run"] for r in held.select("_run").distinct().collect())
    for run in hit:
        rows = spark.read.parquet(f"{path}/{RUN}={run}")
        theirs = held.where(F.col("_run") == run).select("_gone")
        rows.join(theirs, F.col(key) == F.col("_gone"), "left_anti").write.parquet(f"{path}/{STAGED}/{RUN}={run}")
    if hit:
        _mark(spark, f"{path}/{STAGED}/_READY")
        _finish(spark, path)
    return hit


def purge_stored(spark: SparkSession, users: DataFrame, tickets: str, predictions: str, feedback: str, counters: str) -> dict[str, list[str]]:
    """J10. Remove these owners from the four stored tables; returns the run folders that were rewritten.

    Feedback goes before predictions and those before tickets, so that a purge that fails half-way still finds the
    owners' tickets, and is repeated as a whole. Later runs of the caller read the tables as they are then.
    """
    owners = users.select("user_id").distinct()

    def table(path: str, *columns: str) -> DataFrame:
        return spark.read.parquet(path).select(*columns)

    def ids() -> tuple[DataFrame, DataFrame]:
        theirs = table(tickets, "ticket_id", "user_id").join(owners, "user_id", "left_semi").select("ticket_id")
        made = table(predictions, "prediction_id", "ticket_id").join(theirs, "ticket_id", "left_semi").select("prediction_id")
        return theirs, made

    rewritten = {"feedback": delete_rows(spark, feedback, ids()[1], "prediction_id")}
    rewritten["predictions"] = delete_rows(spark, predictions, ids()[0], "ticket_id")
    rewritten["tickets"] = delete_rows(spark, tickets, owners, "user_id")
    rewritten["rate_limit_counters"] = delete_rows(spark, counters, owners, "user_id")
    return rewritten
