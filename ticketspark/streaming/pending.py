"""Incremental scoring of pending tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ticketspark import schemas as S
from ticketspark.operators.selection import select_for_scoring
from ticketspark.plans.scoring import Scorer, prediction_rows, score
from ticketspark.sources.maintained import Maintained, unscored
from ticketspark.sources.tables import RUN, append_run, read_table

HISTORY = T.StructType([*S.PREDICTIONS.fields, T.StructField(RUN, T.StringType())])


def score_pending_stream(
    tickets: DataFrame,
    predictions_path: str,
    checkpoint: str,
    scorer: Scorer,
    model_version: str,
    model_run_id: str | None,
    run_ts: Column,
    scored: Maintained | None = None,
) -> StreamingQuery:
    """R3. Score arriving tickets that this version has not scored yet, then stop.

    Each micro-batch is one run of the predictions table. Ids follow from ticket, version and
    batch, and a repeated batch ignores and then replaces what its first try wrote. The history is
    cut down to the tickets of the batch while it is scanned, so a small batch does not shuffle it. With ``scored``, the
    index of this model version, the history is not read at all, and each micro-batch adds its tickets.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        run_id = f"stream-{batch_id:012d}"
        batch.persist()
        try:
            if scored is None:
                history = read_table(batch.sparkSession, predictions_path, HISTORY)
                # Both conditions reach the scan: other versions' row groups and this run's own folder are not read.
                history = history.where((F.col(RUN) != run_id) & (F.col("model_version") == model_version))
                arrived = batch.select("ticket_id").distinct()
                known = history.select("ticket_id", "model_version").join(arrived, "ticket_id", "left_semi")
                selected = select_for_scoring(batch, known, model_version)
            else:
                selected = unscored(batch, scored, but=run_id).select("ticket_id", F.col("text").alias("ticket_text"))
            rows = prediction_rows(score(selected, scorer), model_version, model_run_id, run_id, run_ts)
            append_run(rows, predictions_path, run_id)
            if scored is not None:
                done = batch.sparkSession.read.schema(S.PREDICTIONS).parquet(f"{predictions_path}/{RUN}={run_id}")
                scored.add(done.select("ticket_id"), run_id)
        finally:
            batch.unpersist()

    return (
        tickets.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
