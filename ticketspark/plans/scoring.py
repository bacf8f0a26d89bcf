"""Batch scoring."""

from __future__ import annotations

import logging
import sys
import traceback
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark import schemas as S
from ticketspark.functions.ids import iso_utc, row_id
from ticketspark.functions.labels import decode
from ticketspark.functions.scores import argmax, score_map, softmax
from ticketspark.functions.text import is_blank, log_preview
from ticketspark.operators.events import event_lines
from ticketspark.operators.selection import select_for_scoring, selection_mode
from ticketspark.session import written
from ticketspark.sources.artifacts import write_lines
from ticketspark.sources.maintained import Maintained, unscored
from ticketspark.sources.tables import RUN, append_predictions

log = logging.getLogger(__name__)

# A scorer adds ``probabilities`` (label order) to (ticket_id, ticket_text); NULL for blank texts.
Scorer = Callable[[DataFrame], DataFrame]


def column_scorer(features: Callable[[Column], dict[str, Column]], logits: Callable[[], list[Column]]) -> Scorer:
    """X1 as expressions: features of the text, then one logit per label from those features.

    Features are columns of their own, so each is computed once however often it is used.
    """

    def score(tickets: DataFrame) -> DataFrame:
        described = tickets.withColumns(features(F.col("ticket_text")))
        logged = F.when(~is_blank("ticket_text"), F.array(*logits()))
        return described.withColumn("_logits", logged).select(
            *tickets.columns, softmax(F.col("_logits")).alias("probabilities")
        )

    return score


def _kept(key: str, load: Callable[[], object]):
    """One model per Python worker process, shared by all of its tasks. Code that travels by value has no
    module of its own on a worker, so models hang in a module made for them."""
    models = sys.modules.setdefault("_ticketspark_models", types.ModuleType("_ticketspark_models")).__dict__
    if key not in models:
        models[key] = load()
    return models[key]


def batch_scorer(
    load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = S.SCORING_BATCH, model_id: str | None = None
) -> Scorer:
    """X1 for a Python model: ``load()`` returns a function from texts to a (texts, 4) logit array.

    The model is loaded once per worker process and ``model_id`` (by default, per scorer), and only if there is a text
    to score. Only texts travel to Python and only probabilities come back.
    """
    if batch_size <= 0:
        raise ValueError(f"batch size must be positive, got {batch_size}")
    n_labels, key, kept = len(S.LABELS), model_id or uuid.uuid4().hex, _kept

    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.empty(len(texts), object)
            todo = np.flatnonzero(texts.notna().to_numpy())
            for start in range(0, len(todo), batch_size):
                at = todo[start:start + batch_size]
                logits = np.asarray(kept(key, load)(list(texts.iloc[at])), dtype=float)
                if logits.shape != (len(at), n_labels):
                    raise ValueError(f"expected {(len(at), n_labels)} logits, got {logits.shape}")
                weights = np.exp(logits - logits.max(axis=1, keepdims=True))
                out[at] = list(weights / weights.sum(axis=1, keepdims=True))
            yield pd.Series(out)

    scored = F.pandas_udf(probabilities, T.ArrayType(T.DoubleType()))

    def score(tickets: DataFrame) -> DataFrame:
        todo = F.when(~is_blank("ticket_text"), F.col("ticket_text"))
        return tickets.withColumn("probabilities", scored(todo))

    return score


def score(selected: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per selected ticket; ``skipped`` ones carry no prediction.

    Keeps a preview and the length in place of the text, so what is staged stays small.
    """
    best = scorer(selected).withColumn("_best", argmax(F.col("probabilities")))
    return best.select(
        "ticket_id",
        is_blank("ticket_text").alias("skipped"),
        decode(F.col("_best")).alias("predicted_priority"),
        F.get("probabilities", F.col("_best")).alias("confidence"),
        score_map(F.col("probabilities")).alias("all_scores"),
        log_preview("ticket_text").alias("input_preview"),
        F.length("ticket_text").alias("input_length_chars"),
    )


def prediction_rows(scored: DataFrame, model_version: str, model_run_id: str | None, run_id: str, run_ts: Column) -> DataFrame:
    """Rows for the predictions table; ids follow from ticket, version and run."""
    return scored.where("not skipped").select(
        row_id("ticket_id", F.lit(model_version), F.lit(run_id)).alias("prediction_id"),
        F.col("ticket_id").cast("string").alias("ticket_id"),
        "predicted_priority",
        "confidence",
        "all_scores",
        F.lit(model_version).alias("model_version"),
        F.lit(model_run_id).cast("string").alias("model_run_id"),
        F.lit(None).cast("int").alias("latency_ms"),
        run_ts.alias("created_at"),
    )


def summarise(scored: DataFrame) -> DataFrame:
    """A1, A2. Counts, average confidence (0.0 when nothing was scored) and the label mix."""
    mix = F.create_map(*[
        part
        for label in S.LABELS
        for part in (F.lit(label), F.count_if(F.col("predicted_priority") == label))
    ])
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~F.col("skipped")).alias("row_count_scored"),
        F.count_if("skipped").alias("row_count_skipped"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        mix.alias("class_distribution"),
    )


def run_batch(
    tickets: DataFrame,
    predictions: DataFrame,
    predictions_path: str,
    scorer: Scorer,
    model_version: str,
    model_run_id: str | None,
    run_id: str,
    run_ts: Column,
    since=None,
    ticket_ids=None,
    dry_run: bool = False,
    on_summary: Callable[[str], None] = log.info,
    events_path: str | None = None,
    on_error: Callable[[str], None] = log.error,
    scored: Maintained | None = None,
    newest: Maintained | None = None,
) -> DataFrame:
    """M5. Select, score, append and summarise; returns the one-row summary.

    Every text is scored once: the scored rows go to the shared folder, and the append, the count
    and the summary all read them from there. With ``events_path`` one prediction line per scored ticket goes to
    the run's own folder there, dry runs included; a repeated run replaces its lines. The summary line is emitted for
    empty and for failed runs too, after the error line of the latter; a failed run has written no prediction, and
    repeating it with the same id is safe.

    With ``scored``, the index of this model version, the selection reads neither predictions nor their folders, and the
    run adds its tickets to it; with ``newest`` its predictions join the newest ones. Both are written after the predictions.
    """
    spark = tickets.sparkSession
    mode = selection_mode(since, ticket_ids, dry_run)
    started = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
    staged = None
    try:
        if scored is None or ticket_ids is not None:
            selected = select_for_scoring(tickets, predictions, model_version, since, ticket_ids)
        else:
            selected = unscored(tickets, scored, since, run_id).select("ticket_id", F.col("text").alias("ticket_text"))
        staged = written(score(selected, scorer), f"scored-{run_id}")
        if events_path is not None:
            named = staged.where("not skipped").withColumns({
                "run_id": F.lit(run_id), "model_version": F.lit(model_version), "model_run_id": F.lit(model_run_id).cast("string"),
                "latency_ms": F.lit(0.0),
            })
            write_lines(event_lines(named, "prediction"), f"{events_path}/{RUN}={run_id}", "overwrite")
        if not dry_run:
            rows = prediction_rows(staged, model_version, model_run_id, run_id, run_ts)
            append_predictions(rows, predictions_path, run_id)
            if scored is not None:
                scored.add(staged.where("not skipped").select("ticket_id"), run_id)
            if newest is not None:
                newest.add(rows, run_id)
    except BaseException as error:
        record = spark.createDataFrame([(repr(error), traceback.format_exc())], "error string, traceback string")
        on_error(event_lines(record, "batch_predict.error").first()["value"])
        raise
    finally:
        if staged is None:
            staged = spark.createDataFrame([], "predicted_priority string, confidence double, skipped boolean")
        counts = summarise(staged)
        summary = counts.select(
            F.lit(run_id).alias("run_id"), F.lit(model_version).alias("model_version"),
            F.lit(model_run_id).cast("string").alias("model_run_id"), F.lit(mode).alias("selection_mode"),
            "row_count", "row_count_scored", "row_count_skipped", "class_distribution", "avg_confidence",
            F.round((F.unix_millis(F.current_timestamp()) - F.unix_millis(F.lit(started))) / 1000, 3).alias("runtime_sec"),
            iso_utc(F.lit(started)).alias("started_at"), iso_utc(F.current_timestamp()).alias("finished_at"),
        )
        on_summary(event_lines(summary, "batch_run_summary").first()["value"])
    return summary
