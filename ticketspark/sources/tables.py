"""Ticket tables on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark import schemas as S
from ticketspark.functions.ids import row_id

RUN = "batch_run_id"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S5. Column-pruned scan; a table that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "ticket_id") -> DataFrame:
    """Catalog table bucketed and sorted by ticket.

    With tickets and predictions in the same number of buckets, the newest prediction per ticket,
    its join and the unscored selection all run without a shuffle. About 200 MB per bucket is a
    good size. Rows are placed before the write, so each bucket is one file.
    """
    (
        df.repartition(buckets, key).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def append_run(rows: DataFrame, path: str, run_id: str) -> int:
    """U1, S6, S7. Add one run's rows to a table and return how many were written.

    The run has its own partition folder, so repeating a failed run replaces its rows instead of
    doubling them; other runs are never touched.
    """
    folder = f"{path}/{RUN}={run_id}"
    rows.write.mode("overwrite").parquet(folder)
    # The footers alone answer the count.
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).count()


def append_predictions(rows: DataFrame, path: str, run_id: str, overwrite: bool = False) -> int:
    """S6. ``overwrite`` changes nothing: history is kept and the newest row wins on read."""
    return append_run(rows.select(*S.PREDICTIONS.fieldNames()), path, run_id)


def ticket_and_prediction(
    scored: DataFrame, user_id: Column, run_ts: Column, source: str = "paste"
) -> tuple[DataFrame, DataFrame]:
    """S8. Ticket rows and their first predictions from one scored frame.

    ``scored`` has text, predicted_priority, confidence, all_scores, model_version, model_run_id,
    latency_ms and a unique request_id. Both id columns follow from it, so the two tables agree
    even when they are written one after the other.
    """
    ticket_id = row_id("request_id", user_id, run_ts)
    tickets = scored.select(
        ticket_id.alias("ticket_id"), "text", F.lit(source).alias("source"), user_id.alias("user_id"),
        run_ts.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    predictions = scored.select(
        row_id(ticket_id, "model_version", run_ts).alias("prediction_id"), ticket_id.alias("ticket_id"),
        "predicted_priority", "confidence", "all_scores", "model_version", "model_run_id",
        F.col("latency_ms").cast("int").alias("latency_ms"), run_ts.alias("created_at"),
    )
    return tickets, predictions


def feedback_rows(accepted: DataFrame, run_ts: Column) -> DataFrame:
    """S9. Accepted feedback as table rows; a prediction may have many of them.

    ``accepted`` has a unique request_id next to prediction_id, verdict and note.
    """
    return accepted.select(
        row_id("request_id", "prediction_id", run_ts).alias("feedback_id"),
        F.col("prediction_id").cast("string").alias("prediction_id"), "verdict", "note",
        run_ts.alias("created_at"),
    )
