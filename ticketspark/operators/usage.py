"""Request counting and limits (A10, A11, W3, T5, F7, R2 batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.ids import window_start
from ticketspark.operators.ranking import numbered_in_groups


def in_windows(requests: DataFrame, window: str = "minute", ts: str = "ts") -> DataFrame:
    """F7. Requests with the start of their window, in the type of ``ts``."""
    kind = requests.schema[ts].dataType
    return requests.withColumn("window_start", window_start(F.col(ts), window).cast(kind))


def request_counts(requests: DataFrame, window: str = "minute") -> DataFrame:
    """A10. Requests per user and window, refused ones included; combined on the map side."""
    return (
        in_windows(requests, window)
        .groupBy("user_id", "window_start")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def request_decisions(
    requests: DataFrame, limit: int = S.REQUESTS_PER_MINUTE, window: str = "minute", parts: int | None = None
) -> DataFrame:
    """W3. Running number of each request in its window; the limit-th is the last one allowed."""
    numbered = numbered_in_groups(
        in_windows(requests, window), ["user_id", "window_start"], [F.col("ts"), F.col("event_id")], "request_number", parts
    )
    return numbered.withColumn("allowed", F.col("request_number") <= limit)


def limit_breaches(
    counts: DataFrame, limit: int = S.REQUESTS_PER_MINUTE, top: int = S.TOP_BREACHES
) -> DataFrame:
    """A11, T5. The windows furthest over the limit."""
    return (
        counts.where(F.col("count") > limit)
        .orderBy(F.desc("count"), "user_id", "window_start")
        .limit(top)
    )


def sweep(counts: DataFrame, cutoff: Column) -> DataFrame:
    """R2. Counters whose window has not passed the cutoff."""
    return counts.where(F.col("window_start") >= cutoff)
