"""Event records laid out by event and day, so that the newest are found from the last day backward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.operators.events import newest_events
from ticketspark.session import folders

EVENT, DAY = "event", "day"
#: Spark's folder name for rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def store_events(records: DataFrame, path: str, run_id: str) -> None:
    """S12. Append ``records`` (event, ts and further fields) below ``path/run_id``; a repeated run replaces its own.

    Rows are dealt to the writers by (event, day) and a hash of the row's time, so a busy day is written by several tasks
    and a quiet one by few.
    """
    dated = records.withColumn(DAY, F.to_date("ts"))
    dated.repartition(EVENT, DAY, F.hour("ts")).write.mode("overwrite").partitionBy(EVENT, DAY).parquet(f"{path}/run={run_id}")


def _days(spark: SparkSession, path: str, events: Sequence[str] | None) -> dict[str, list[str]]:
    """Folders per day, from the names alone."""
    found: dict[str, list[str]] = {}
    for run in folders(spark, path):
        for event in folders(spark, f"{path}/{run}"):
            name = event.removeprefix(f"{EVENT}=")
            if event.startswith(f"{EVENT}=") and (events is None or name in events):
                for day in folders(spark, f"{path}/{run}/{event}"):
                    found.setdefault(day.removeprefix(f"{DAY}="), []).append(f"{path}/{run}/{event}/{day}")
    return found


def newest_stored(
    spark: SparkSession,
    path: str,
    schema: str,
    events: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    limit: int = 50,
    order: Sequence[Column] = (),
) -> DataFrame:
    """S11. The newest ``limit`` records. ``order`` must begin with the newest time; ``schema`` names the stored fields.

    Days are taken from the last one backward, twice as many each time, until they hold enough rows; records of earlier days
    are not read. Rows without a time are older than all others.
    """
    days = _days(spark, path, events)
    names = sorted((d for d in days if d != NO_DAY), reverse=True) + [d for d in days if d == NO_DAY]
    taken, some = 0, spark.createDataFrame([], f"{schema}, {EVENT} string, {DAY} date")
    while taken < len(names):
        taken = min(len(names), 2 * taken + 1)
        parts = [
            spark.read.schema(f"{schema}, {EVENT} string, {DAY} date").option("basePath", f"{path}/{run}").parquet(*places)
            for run, places in _by_run(path, [p for d in names[:taken] for p in days[d]]).items()
        ]
        some = parts[0]
        for part in parts[1:]:
            some = some.unionByName(part)
        matching = some if severities is None else some.where(F.col("severity").isin(list(severities)))
        # Enough rows are counted, not all of them.
        if matching.limit(limit).count() >= limit:
            break
    return newest_events(some, events, severities, limit, order).drop(DAY)


def _by_run(path: str, places: list[str]) -> dict[str, list[str]]:
    runs: dict[str, list[str]] = {}
    for place in places:
        runs.setdefault(place.removeprefix(f"{path}/").split("/")[0], []).append(place)
    return runs
