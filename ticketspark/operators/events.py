"""Event records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.functions.text import log_preview

# The fields of each event, in the order they are written.
EVENT_FIELDS = {
    "ticket_created": [
        "ticket_id", "prediction_id", "predicted_priority", "confidence", "input_preview",
        "input_length_chars", "model_version", "model_run_id", "latency_ms",
    ],
    "feedback_recorded": [
        "feedback_id", "prediction_id", "verdict", "ticket_id", "predicted_priority", "confidence",
    ],
    "ticket_resolved": ["ticket_id", "user_id"],
    "ticket_unresolved": ["ticket_id", "user_id"],
    "model_endpoint_error": ["status_code", "error", "endpoint"],
    "prediction": [
        "run_id", "model_version", "model_run_id", "ticket_id", "input_preview", "input_length_chars",
        "predicted_priority", "confidence", "latency_ms",
    ],
    "batch_run_summary": [
        "run_id", "model_version", "model_run_id", "selection_mode", "row_count", "row_count_scored",
        "row_count_skipped", "class_distribution", "avg_confidence", "runtime_sec", "started_at",
        "finished_at",
    ],
    "online_prediction": [
        "model_version", "model_run_id", "input_preview", "input_length_chars", "predicted_priority",
        "confidence", "latency_ms",
    ],
    "batch_predict.error": ["error", "traceback"],
    "csv_upload": ["user_id", "accepted", "skipped"],
}
ERROR_EVENTS = ["model_endpoint_error", "batch_predict.error"]


def event_lines(df: DataFrame, event: str, text: str | None = None) -> DataFrame:
    """S12. One JSON line per row: severity, event, then all fields of the event; NULL where ``df`` has none.

    With ``text`` the preview and length of that column are filled in; the text itself never is.
    """
    if text is not None:
        df = df.withColumns({"input_preview": log_preview(text), "input_length_chars": F.length(text)})
    severity = "ERROR" if event in ERROR_EVENTS else "INFO"
    fields: list[Column] = [F.lit(severity).alias("severity"), F.lit(event).alias("event")]
    fields += [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in EVENT_FIELDS[event]]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def message_lines(df: DataFrame, message: str, severity: str = "INFO") -> DataFrame:
    """S12. A record without an event carries its message instead."""
    record = F.struct(F.lit(severity).alias("severity"), F.col(message).alias("message"))
    return df.select(F.to_json(record).alias("value"))


def parse_lines(lines: DataFrame, schema: str = "severity string, event string, message string") -> DataFrame:
    """S11. Fields of JSON lines next to the raw line; a broken line gives NULL fields."""
    return lines.withColumn("_record", F.from_json("value", schema)).select("*", "_record.*").drop("_record")


def newest_events(
    records: DataFrame,
    events: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    limit: int = 50,
    order: Sequence[Column] = (),
) -> DataFrame:
    """S11. Newest ``limit`` records of the given names or severities; a top-k plan."""
    if events is not None:
        records = records.where(F.col("event").isin(list(events)))
    if severities is not None:
        records = records.where(F.col("severity").isin(list(severities)))
    return records.orderBy(*(order or [F.desc("ts"), F.desc("value")])).limit(limit)
