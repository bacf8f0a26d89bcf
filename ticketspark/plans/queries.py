"""Every operator as a query over the given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions import ids, labels, replies, scores, text
from ticketspark.operators import (
    baseline,
    cleaning,
    contracts,
    dataset,
    distribution,
    evaluation,
    events,
    feedback,
    generation,
    queue,
    ranking,
    selection,
    usage,
)
from ticketspark.plans import bindings as B
from ticketspark.plans import scoring
from ticketspark.session import partitions, scratch_path, spread, written
from ticketspark.sources import artifacts, datasets, event_store, maintained, purge, tables, uploads
from ticketspark.streaming import limits, pending, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The given requests stay far below 50 a minute, so limits are shown per day.
WINDOW, LIMIT = "day", 3
VERSION = "N"
SINCE = "1998-01-01"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(*names: str) -> dict[str, Column]:
    return {name: F.round(name, 6) for name in names}


# --- Queue ---------------------------------------------------------------------------------------


@query
def triage_queue(spark, sf_dir):
    head = queue.triage_queue(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), limit=500)
    return head.drop("text", "source", "resolved_at")


@query
def triage_queue_user(spark, sf_dir):
    queues = queue.queue_per_user(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), limit=5)
    return queues.select("user_id", "position", "ticket_id", "prediction_id", "predicted_priority", "created_at")


@query
def ticket_lookup(spark, sf_dir):
    found = queue.lookup_many(B.lookups(spark, sf_dir), B.tickets(spark, sf_dir), B.predictions(spark, sf_dir))
    return found.select("ticket_id", "user_id", "found", "prediction_id", "predicted_priority", "confidence", "resolved_at")


@query
def user_history(spark, sf_dir):
    return queue.user_history(B.tickets(spark, sf_dir))


@query
def latest_prediction(spark, sf_dir):
    return queue.newest_prediction(B.predictions(spark, sf_dir))


def _records(spark, sf_dir):
    return queue.with_newest_prediction(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir))


@query
def pending_split(spark, sf_dir):
    classified, waiting = queue.split_pending(_records(spark, sf_dir))
    parts = {"classified": classified, "pending": waiting}
    rows = [df.select("ticket_id", "predicted_priority", F.lit(name).alias("state")) for name, df in parts.items()]
    return rows[0].unionByName(rows[1])


@query
def queue_counts(spark, sf_dir):
    return queue.queue_counts(_records(spark, sf_dir))


@query
def status_counts_by_user(spark, sf_dir):
    return queue.status_counts(B.tickets(spark, sf_dir))


@query
def resolve_apply(spark, sf_dir):
    after = queue.apply_resolutions(B.tickets(spark, sf_dir), B.resolutions(spark, sf_dir))
    return after.select("ticket_id", "user_id", "resolved_at")


@query
def resolve_rejects(spark, sf_dir):
    return queue.rejected_resolutions(B.tickets(spark, sf_dir), B.resolutions(spark, sf_dir))


@query
def purge_user_preview(spark, sf_dir):
    """Owners whose balance is negative leave."""
    customer = B.table(spark, sf_dir, "customer")
    users = customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))
    before = {
        "tickets": B.tickets(spark, sf_dir),
        "predictions": B.predictions(spark, sf_dir),
        "feedback": B.predictions(spark, sf_dir).select("prediction_id", F.lit("thumbs_up").alias("verdict")),
        "rate_limit_counters": usage.request_counts(B.requests(spark, sf_dir), WINDOW),
    }
    after = queue.purge_users(users, *before.values())
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(step).alias("step"), "n")
        for step, frames in (("before", before), ("after", after))
        for name, df in frames.items()
    ]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total


@query
def purge_stored(spark, sf_dir):
    """The same owners, taken out of tables that several runs have written."""
    path = scratch_path(spark, "purge")
    customer = B.table(spark, sf_dir, "customer")
    users = customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))
    predictions = B.predictions(spark, sf_dir)
    stored = {
        "tickets": (B.tickets(spark, sf_dir), F.year("created_at")),
        "predictions": (predictions, F.year("created_at")),
        "feedback": (predictions.select("prediction_id", F.lit("thumbs_up").alias("verdict")), F.pmod(F.xxhash64("prediction_id"), F.lit(3))),
        "rate_limit_counters": (usage.request_counts(B.requests(spark, sf_dir), WINDOW), F.month("window_start")),
    }
    for name, (rows, run) in stored.items():
        rows.withColumn(tables.RUN, run.cast("string")).write.partitionBy(tables.RUN).parquet(f"{path}/{name}")
    purge.purge_stored(spark, users, *[f"{path}/{name}" for name in stored])
    counts = [
        spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name in stored
    ]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total


def _newest_maintained(spark, sf_dir):
    """Seven runs, the latest lines first; some are folded into the base, and one comes twice."""
    rows = B.predictions(spark, sf_dir)
    newest = maintained.newest_predictions(spark, scratch_path(spark, "newest"), partitions(spark), rows.schema)
    for run in (7, 6, 5, 4, 4, 3, 2, 1):
        newest.add(rows.where(F.col("latency_ms") == run), f"line-{run}")
        if run in (6, 3):
            newest.compact()
    newest.compact()
    return newest.rows()


@query
def newest_maintained(spark, sf_dir):
    """The newest prediction per ticket, kept up by every run."""
    return _newest_maintained(spark, sf_dir)


@query
def triage_queue_maintained(spark, sf_dir):
    """The queue from one stored row per ticket."""
    head = queue.triage_queue(B.tickets(spark, sf_dir), _newest_maintained(spark, sf_dir), limit=500)
    return head.drop("text", "source", "resolved_at")


# --- Selection and models ------------------------------------------------------------------------


@query
def unscored_default(spark, sf_dir):
    return selection.select_for_scoring(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), VERSION)


@query
def scored_index(spark, sf_dir):
    """What is left to score, from the index of scored ids that every run of the version keeps up."""
    scored = B.predictions(spark, sf_dir).where(F.col("model_version") == VERSION)
    index = maintained.scored_ids(spark, scratch_path(spark, "scored"), VERSION, partitions(spark), "long")
    for run in (1, 2, 3):
        index.add(scored.where(F.col("latency_ms") % 3 == run - 1), f"run-{run}")
        if run == 2:
            index.compact()
    return maintained.unscored(B.tickets(spark, sf_dir), index).select("ticket_id", F.col("text").alias("ticket_text"))


@query
def unscored_since(spark, sf_dir):
    return selection.select_for_scoring(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), VERSION, since=SINCE)


@query
def rescore_ids(spark, sf_dir):
    """The id list is the labelled documents."""
    wanted = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ticket_id"))
    return selection.select_for_scoring(
        B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), VERSION, ticket_ids=wanted
    )


def _model_runs(spark, sf_dir):
    """One training run per model (line status) and flag, judged on the known labels."""
    lines = B.predictions(spark, sf_dir)
    judged = B.labelled_tickets(spark, sf_dir).join(lines, "ticket_id")
    return judged.groupBy(F.col("model_run_id").alias("display_name"), F.col("model_version").alias("flag")).agg(
        F.avg((F.col("priority") == F.col("predicted_priority")).cast("double")).alias("accuracy"),
        F.avg("confidence").alias("macro_f1"),
        F.max("created_at").alias("create_time"),
    ).select(
        "display_name",
        F.concat(F.lit("Run."), "flag").alias("run_id"),
        F.concat_ws("/", F.lit("models"), "display_name", F.lit("runs"), F.concat(F.lit("Run."), "flag"), F.lit("model/")).alias("artifact_uri"),
        F.lit("v1").alias("data_version"),
        "accuracy", "macro_f1", "create_time",
    )


@query
def model_versions(spark, sf_dir):
    versions = selection.register_models(_model_runs(spark, sf_dir))
    names = {name: F.col("labels")[name].alias(name.replace("-", "_") + "_label") for name in ("run-id", "data-version", "accuracy", "macro-f1")}
    return versions.select(
        "display_name", "version", "run_id", "artifact_uri", "description", "is_default", "create_time", *names.values()
    )


@query
def promote_version(spark, sf_dir):
    runs = _model_runs(spark, sf_dir)
    old = selection.register_models(runs.where(F.col("run_id") != "Run.R"))
    return selection.promote(old, runs.where(F.col("run_id") == "Run.R")).select(
        "display_name", "version", "run_id", "is_default"
    )


@query
def resolve_version(spark, sf_dir):
    versions = selection.register_models(_model_runs(spark, sf_dir))
    newest = selection.resolve_version(versions)
    pinned = selection.resolve_version(versions, display_name="O", pinned=1)
    rows = [
        df.select(F.lit(how).alias("how"), "display_name", "version", "model_run_id")
        for how, df in (("default", newest), ("pinned", pinned))
    ]
    return rows[0].unionByName(rows[1])


# --- Requests ------------------------------------------------------------------------------------


@query
def request_windows(spark, sf_dir):
    return usage.request_counts(B.requests(spark, sf_dir))


@query
def request_decisions(spark, sf_dir):
    return usage.request_decisions(B.requests(spark, sf_dir), LIMIT, WINDOW)


@query
def request_decisions_hot(spark, sf_dir):
    """The same over many ranges, so that most windows lie in several of them."""
    return usage.request_decisions(B.requests(spark, sf_dir), LIMIT, WINDOW, parts=200)


@query
def limit_breaches(spark, sf_dir):
    return usage.limit_breaches(usage.request_counts(B.requests(spark, sf_dir), WINDOW), LIMIT)


@query
def counter_sweep(spark, sf_dir):
    requests = B.requests(spark, sf_dir)
    newest = usage.in_windows(requests).agg(F.max("window_start")).scalar()
    return usage.sweep(usage.request_counts(requests), newest - F.expr("interval 7 days"))


# --- Feedback and contracts ----------------------------------------------------------------------


@query
def feedback_checked(spark, sf_dir):
    return feedback.check_feedback(
        B.feedback(spark, sf_dir), B.document_predictions(spark, sf_dir), B.documents(spark, sf_dir)
    )


@query
def feedback_enriched(spark, sf_dir):
    enriched = feedback.enrich_feedback(B.feedback(spark, sf_dir), B.document_predictions(spark, sf_dir))
    return enriched.withColumns(rounded("confidence"))


@query
def contract_report(spark, sf_dir):
    frames = {
        "tickets": B.tickets(spark, sf_dir),
        "predictions": B.predictions(spark, sf_dir),
        "feedback": B.feedback(spark, sf_dir).withColumn("prediction_id", F.col("prediction_id").cast("string")),
        "rate_limit_counters": usage.request_counts(B.requests(spark, sf_dir)),
    }
    return contracts.contract_report(frames)


@query
def label_domain(spark, sf_dir):
    """Labels outside the vocabulary among all tickets, normalised the way datasets are."""
    named = B.tickets(spark, sf_dir).select(text.normalise_label(F.expr("substring(text, 3)")).alias("label"))
    return contracts.unknown_labels(named, "label")


# --- Texts ---------------------------------------------------------------------------------------


@query
def clean_texts(spark, sf_dir):
    return cleaning.clean(B.documents(spark, sf_dir)).select("ticket_id", "ticket_text")


@query
def dedup_texts(spark, sf_dir):
    return cleaning.drop_duplicate_texts(B.documents(spark, sf_dir)).select("ticket_id", "user_id")


@query
def clean_counters(spark, sf_dir):
    return cleaning.clean_counters(B.documents(spark, sf_dir))


@query
def word_counts(spark, sf_dir):
    return spread(B.documents(spark, sf_dir), "ticket_id").select(
        "ticket_id",
        text.word_count("ticket_text").alias("words"),
        F.length(text.strip("ticket_text")).alias("stripped_chars"),
        text.has_words("ticket_text", S.MIN_WORDS).alias("long_enough"),
    )


def _all_texts(spark, sf_dir):
    docs = B.documents(spark, sf_dir).select(F.concat(F.lit("d"), "ticket_id").alias("ticket_id"), "ticket_text")
    messages = B.user_messages(spark, sf_dir).select(
        F.concat_ws("-", F.lit("c"), "ticket_id", "position").alias("ticket_id"), "ticket_text"
    )
    return docs.unionByName(messages)


@query
def text_validity(spark, sf_dir):
    return cleaning.validity(_all_texts(spark, sf_dir)).select(
        "ticket_id", "reason", text.long_enough("ticket_text").alias("uploadable"), text.is_blank("ticket_text").alias("blank")
    )


@query
def text_preview(spark, sf_dir):
    return _all_texts(spark, sf_dir).select(
        "ticket_id",
        text.log_preview("ticket_text").alias("input_preview"),
        F.length("ticket_text").alias("input_length_chars"),
        text.list_preview("ticket_text").alias("display_text"),
    )


@query
def scalar_labels(spark, sf_dir):
    """F3, F5, F12, F18 on every prediction."""
    priority = F.col("predicted_priority")
    return B.predictions(spark, sf_dir).select(
        "prediction_id",
        labels.queue_rank(priority).alias("queue_rank"),
        labels.encode(priority).alias("label_id"),
        labels.decode(labels.encode(priority)).alias("label"),
        labels.shift(priority, F.lit(1)).alias("raised"),
        labels.shift(priority, F.lit(-1)).alias("lowered"),
        labels.percent(F.col("confidence")).alias("percent"),
    )


@query
def scalar_ids(spark, sf_dir):
    """F7, F8, F17 on every request."""
    return B.requests(spark, sf_dir).select(
        "event_id",
        ids.window_start(F.col("ts")).cast("timestamp_ntz").alias("minute"),
        ids.run_id("pred", F.col("ts")).alias("run_id"),
        ids.iso_utc(F.col("ts")).alias("iso"),
        ids.row_id("event_id", "user_id").alias("row_id"),
    )


@query
def scalar_paths(spark, sf_dir):
    """F13, F14 on every page address."""
    return B.table(spark, sf_dir, "pages").select(
        "page_id",
        ids.safe_label(F.col("url")).alias("label"),
        ids.run_of_artifact(F.concat("url", F.lit("/model/"))).alias("run_id"),
        ids.run_of_artifact(F.concat("url", F.lit("//"))).alias("last_part"),
    )


@query
def scalar_lists(spark, sf_dir):
    """F9 on every user message: its comma-separated parts."""
    return B.user_messages(spark, sf_dir).select(
        "ticket_id", "position", F.array_join(text.comma_list("ticket_text"), "|").alias("parts")
    )


@query
def scalar_scores(spark, sf_dir):
    """F10, F11 on every prediction: softmax, argmax, and a JSON round trip of the score map."""
    c = F.col("confidence")
    logits = F.array(c, c * c, 1 - c, F.col("latency_ms") / 7)
    probabilities = scores.softmax(logits)
    back = scores.scores_from_json(scores.scores_to_json(scores.score_map(probabilities)))
    return B.predictions(spark, sf_dir).select(
        "prediction_id",
        scores.top_label(probabilities).alias("label"),
        F.round(F.array_max(probabilities), 6).alias("confidence"),
        *[F.round(back[name], 6).alias(f"score_{name}") for name in S.LABELS],
    )


# --- Distribution, grid, noise, split ------------------------------------------------------------


def _priorities(spark, sf_dir):
    return B.labelled_tickets(spark, sf_dir)


@query
def label_distribution(spark, sf_dir):
    return distribution.label_counts(_priorities(spark, sf_dir), "priority")


@query
def distribution_check(spark, sf_dir):
    return distribution.mix_check(_priorities(spark, sf_dir)).withColumns(rounded("share", "signed_diff"))


@query
def distribution_warnings(spark, sf_dir):
    return distribution.mix_warnings(_priorities(spark, sf_dir))


@query
def rule_lookup(spark, sf_dir):
    return B.grid_rows(spark, sf_dir).groupBy("customer_sentiment", "issue_complexity", "priority").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def grid_labels(spark, sf_dir):
    return B.grid_rows(spark, sf_dir)


def _noisy(spark, sf_dir):
    clean = B.grid_rows(spark, sf_dir).select("ticket_id", "priority")
    return dataset.apply_noise(clean.withColumn("was", F.col("priority")), "priority", "ticket_id")


@query
def noise_labels(spark, sf_dir):
    return _noisy(spark, sf_dir)


@query
def noise_counts(spark, sf_dir):
    return _noisy(spark, sf_dir).groupBy("was", "priority").agg(F.count(F.lit(1)).alias("n"))


def _split(spark, sf_dir):
    return dataset.stratified_split(B.grid_rows(spark, sf_dir).select("ticket_id", "priority"), "priority", "ticket_id")


@query
def split_rows(spark, sf_dir):
    return _split(spark, sf_dir)


@query
def split_counts(spark, sf_dir):
    return dataset.split_sizes(_split(spark, sf_dir))


@query
def split_quotas(spark, sf_dir):
    return dataset.split_quotas(B.grid_rows(spark, sf_dir), "priority")


@query
def first_rows(spark, sf_dir):
    """The first 1,000 orders by id."""
    return ranking.first_rows(B.grid_rows(spark, sf_dir).select("ticket_id", "priority"), "ticket_id", 1000)


# --- Evaluation ----------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    return B.judged(spark, sf_dir, queue.newest_prediction(B.predictions(spark, sf_dir)))


@query
def confusion(spark, sf_dir):
    return evaluation.confusion(_judged(spark, sf_dir))


@query
def metrics(spark, sf_dir):
    per_class = evaluation.class_metrics(evaluation.confusion(_judged(spark, sf_dir)))
    return per_class.withColumns(rounded("precision", "recall", "f1"))


@query
def metrics_flat(spark, sf_dir):
    return evaluation.flat_metrics(evaluation.confusion(_judged(spark, sf_dir))).withColumns(rounded("value"))


@query
def metric_callback(spark, sf_dir):
    """Logits from line values, true ids from the order's label."""
    truth = _priorities(spark, sf_dir).where(F.col("priority") != S.UNKNOWN_LABEL)
    lines = B.predictions(spark, sf_dir).join(truth, "ticket_id")
    c = F.col("confidence")
    logits = F.array(c, 2 * c - 1, F.lit(0.9), F.col("latency_ms") / 7)
    judged = lines.select(logits.alias("logits"), labels.encode(F.col("priority")).alias("label_id"))
    return evaluation.logit_metrics(judged).withColumns(rounded("value"))


@query
def error_sample(spark, sf_dir):
    return evaluation.error_sample(_judged(spark, sf_dir), "ticket_id")


@query
def eval_artifacts(spark, sf_dir):
    """Metrics written and read back."""
    folder = scratch_path(spark, "artifacts")
    matrix = evaluation.confusion(_judged(spark, sf_dir))
    artifacts.write_artifacts(folder, metrics=evaluation.flat_metrics(matrix), confusion_matrix=matrix)
    back = spark.read.schema("metric string, value double").json(f"{folder}/metrics")
    return back.withColumns(rounded("value"))


# --- Scoring -------------------------------------------------------------------------------------


def _scored(spark, sf_dir, scorer=None):
    selected = spread(B.documents(spark, sf_dir).select("ticket_id", "ticket_text"), "ticket_id")
    return scoring.score(selected, scorer or scoring.column_scorer(B.text_features, B.text_logits))


def _score_columns(scored):
    return scored.select(
        "ticket_id", "skipped", "predicted_priority", F.round("confidence", 6).alias("confidence"),
        *[F.round(F.col("all_scores")[name], 6).alias(f"score_{name}") for name in S.LABELS],
    )


@query
def score_batch(spark, sf_dir):
    return _score_columns(_scored(spark, sf_dir))


def _model_loader():
    """The linear scorer of the documents as a Python model. Inner functions travel to the workers
    by value, so these need not have this package installed."""
    spaces = text.SPACES

    def load():
        word, mark = re.compile(f"[^{spaces}]+"), re.compile("[!?]")

        def model(texts):
            words = np.array([len(word.findall(t)) for t in texts]) + 1.0
            marks = np.array([len(mark.findall(t)) for t in texts]) / words
            size = np.log(words)
            return np.stack([4 - size, 1.2 + 0.2 * size, 0.6 * size - 0.8 + 2 * marks, size - 4 + 8 * marks], axis=1)

        return model

    return load


@query
def score_batch_python(spark, sf_dir):
    return _score_columns(_scored(spark, sf_dir, scoring.batch_scorer(_model_loader())))


@query
def run_summary(spark, sf_dir):
    mix = F.col("class_distribution")
    return scoring.summarise(_scored(spark, sf_dir)).select(
        "row_count", "row_count_scored", "row_count_skipped", F.round("avg_confidence", 6).alias("avg_confidence"),
        *[mix[name].alias(f"n_{name}") for name in S.LABELS],
    )


def _run_ts():
    return F.lit("2026-04-19 02:00:00").cast("timestamp")


@query
def scoring_job(spark, sf_dir):
    """Two runs over the documents; the second finds nothing left to score."""
    path = scratch_path(spark, "predictions")
    docs = spread(B.documents(spark, sf_dir), "ticket_id").select(
        F.col("ticket_id").cast("string").alias("ticket_id"), F.col("ticket_text").alias("text")
    )
    scorer = scoring.column_scorer(B.text_features, B.text_logits)
    for run in ("first", "second"):
        history = tables.read_table(spark, path, S.PREDICTIONS)
        scoring.run_batch(docs, history, path, scorer, "1", "run-1", run, _run_ts())
    return tables.read_table(spark, path, S.PREDICTIONS).select(
        "ticket_id", "predicted_priority", F.round("confidence", 6).alias("confidence"), "model_version", "model_run_id",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query
def scoring_events(spark, sf_dir):
    """The prediction lines that a dry run writes, read back."""
    path = scratch_path(spark, "scoring-events")
    docs = spread(B.documents(spark, sf_dir), "ticket_id").select("ticket_id", F.col("ticket_text").alias("text"))
    history = tables.read_table(spark, f"{path}/predictions", S.PREDICTIONS).withColumn("ticket_id", F.col("ticket_id").cast("long"))
    scorer = scoring.column_scorer(B.text_features, B.text_logits)
    scoring.run_batch(docs, history, f"{path}/predictions", scorer, "1", "run-1", "events", _run_ts(), dry_run=True, events_path=f"{path}/lines")
    schema = "severity string, event string, run_id string, ticket_id long, input_length_chars long, predicted_priority string, confidence double, input_preview string"
    lines = events.parse_lines(artifacts.read_lines(spark, f"{path}/lines"), schema)
    return lines.select(
        "severity", "event", "run_id", "ticket_id", "input_length_chars", "predicted_priority", F.round("confidence", 6).alias("confidence"),
        F.sha2("input_preview", 256).alias("preview_hash"),
    )


@query
def scoring_modes(spark, sf_dir):
    """M5: what the three other modes select and score, over the orders."""
    path = scratch_path(spark, "scoring-modes")
    tickets = B.tickets(spark, sf_dir)
    history = tables.read_table(spark, path, S.PREDICTIONS).withColumn("ticket_id", F.col("ticket_id").cast("long"))
    scorer = scoring.column_scorer(B.text_features, B.text_logits)
    ids = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ticket_id"))
    parts = []
    for run, options in {"d": {"dry_run": True}, "s": {"since": SINCE}, "i": {"ticket_ids": ids}}.items():
        summary = scoring.run_batch(tickets, history, path, scorer, "1", "run-1", run, _run_ts(), **options)
        stored = tables.read_table(spark, path, pending.HISTORY).where(F.col(tables.RUN) == run)
        parts.append(summary.select(
            "selection_mode", "row_count", "row_count_scored", stored.agg(F.count(F.lit(1))).scalar().alias("stored")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def paste_tickets(spark, sf_dir):
    """Each scored document as a ticket with its first prediction, joined by the id they share."""
    docs = B.documents(spark, sf_dir)
    scored = _scored(spark, sf_dir).where("not skipped").join(docs, "ticket_id").select(
        F.col("ticket_id").alias("request_id"), F.col("ticket_text").alias("text"), "predicted_priority", "confidence", "all_scores",
        F.lit("1").alias("model_version"), F.lit("run-1").alias("model_run_id"), F.lit(7).alias("latency_ms"),
    )
    ticket, prediction = tables.ticket_and_prediction(scored, F.lit("u1"), _run_ts())
    return ticket.join(prediction.drop("created_at"), "ticket_id").select(
        F.sha2("text", 256).alias("text_hash"), "source", "user_id", "predicted_priority", F.round("confidence", 6).alias("confidence"), "latency_ms",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query
def feedback_stored(spark, sf_dir):
    """Every verdict as a row of the feedback table."""
    accepted = B.feedback(spark, sf_dir).withColumns({"request_id": F.col("prediction_id"), "note": F.col("user_id")})
    rows = tables.feedback_rows(accepted, _run_ts())
    ids = F.count(F.lit(1)).over(Window.partitionBy("feedback_id"))
    return rows.select("prediction_id", "verdict", "note", ids.alias("rows_of_id"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


# --- Terms and baseline model --------------------------------------------------------------------


@query
def tfidf_terms(spark, sf_dir):
    return baseline.tfidf(B.documents(spark, sf_dir)).withColumns(rounded("idf", "weight"))


@query
def baseline_model(spark, sf_dir):
    """M6: fitted on the documents' own priorities, then applied to them. One row per term; the model must end
    below the loss it starts from, and be right more often than the most frequent label."""
    documents = B.documents(spark, sf_dir)
    n_blocks = baseline.block_count(documents)
    # Dealt out as the blocks are, so that texts move once.
    labelled = documents.repartition(n_blocks, "ticket_id").join(
        B.document_predictions(spark, sf_dir).select("ticket_id", F.col("predicted_priority").alias("priority")), "ticket_id"
    )
    # Read by the counts, the fit and the prediction.
    blocks = baseline.count_blocks(labelled, label="priority", n_blocks=n_blocks)
    model = baseline.fit_baseline(labelled, blocks=blocks)
    right = baseline.predict_baseline(model, labelled, blocks=blocks).agg(F.avg((F.col("pred_label") == F.col("priority")).cast("double"))).scalar()
    constant = labelled.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    return model.terms.select(
        "term", "df", F.round("idf", 6).alias("idf"), F.lit(model.n_documents).cast("long").alias("n_rows"),
        F.lit(model.last_loss < model.first_loss).alias("lower_loss"), (right > constant).alias("better_than_constant"),
    )


# --- Prompts and replies -------------------------------------------------------------------------


def _existing(spark, sf_dir):
    return generation.existing_texts(B.user_messages(spark, sf_dir), "position")


def _todo(spark, sf_dir):
    """Numbering reads its input more than once, so the rows to do are written first."""
    return written(generation.still_to_do(B.grid_rows(spark, sf_dir), _existing(spark, sf_dir)), "todo")


@query
def existing_texts(spark, sf_dir):
    return _existing(spark, sf_dir)


@query
def generation_todo(spark, sf_dir):
    return generation.chunked(_todo(spark, sf_dir).select("ticket_id"))


@query
def prompt_batches(spark, sf_dir):
    return generation.prompt_batches(_todo(spark, sf_dir))


def _replies(spark, sf_dir):
    """Replies to every batch, one array element per row. By batch number in turn: valid at once;
    too short, then fenced; prose, numbers, then an array in prose; never valid."""
    todo = written(generation.chunked(_todo(spark, sf_dir)), "chunks")
    said = F.concat_ws(" ", F.lit("My"), "product_sub_category", F.lit("left me"), "customer_sentiment", F.lit('\n"really"'), "ticket_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))), lambda r: r["said"])
    batches = todo.groupBy("batch_id").agg(ordered.alias("texts"))
    good = F.to_json("texts")
    short = F.to_json(F.slice("texts", 1, F.size("texts") - 1))
    kind = F.col("batch_id") % 4
    attempts = F.when(kind == 0, F.array(good)).when(
        kind == 1, F.array(short, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    ).when(
        kind == 2,
        F.array(F.lit("no list here"), F.lit("[1, 2, 3]"), F.concat(F.lit("Here it is:\n"), good, F.lit("\nDone."))),
    ).otherwise(F.array(F.lit('{"a": 1}'), F.lit('["a", null]'), short))
    raw = batches.select("batch_id", F.posexplode(attempts).alias("at", "raw"))
    return todo, raw.select("batch_id", (F.col("at") + 1).alias("attempt"), "raw"), batches.select("batch_id", F.size("texts").alias("n_rows"))


@query
def reply_parse(spark, sf_dir):
    _, raw, _ = _replies(spark, sf_dir)
    return raw.select("batch_id", "attempt", F.size(replies.reply_strings(F.col("raw"))).alias("n_strings"))


@query
def reply_accept(spark, sf_dir):
    _, raw, expected = _replies(spark, sf_dir)
    return generation.accepted_replies(raw, expected).select("batch_id", "attempt")


def _merged(spark, sf_dir):
    todo, raw, expected = _replies(spark, sf_dir)
    return generation.merge_replies(todo, generation.accepted_replies(raw, expected))


@query
def reply_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("ticket_id", "batch_id", "pos", "ticket_text")


@query
def generation_summary(spark, sf_dir):
    grid = B.grid_rows(spark, sf_dir).select("ticket_id")
    filled = generation.resume(grid, _existing(spark, sf_dir), _merged(spark, sf_dir))
    return generation.completion(filled).withColumns(rounded("share"))


# --- Event logs ----------------------------------------------------------------------------------


def _prediction_lines(spark, sf_dir):
    texts = B.tickets(spark, sf_dir).select("ticket_id", "text")
    return events.event_lines(B.predictions(spark, sf_dir).join(texts, "ticket_id"), "prediction", text="text")


@query
def event_log_render(spark, sf_dir):
    return _prediction_lines(spark, sf_dir)


@query
def event_log_filter(spark, sf_dir):
    """Events of the given types, parsed back from their JSON lines; newest 50."""
    names = F.when(F.col("event_type") == "error", "model_endpoint_error").when(
        F.col("event_type") == "signup", "ticket_created"
    ).otherwise("prediction")
    severity = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    record = F.struct(severity.alias("severity"), names.alias("event"), F.get_json_object("props", "$.k").alias("message"))
    lines = B.table(spark, sf_dir, "events").select("ts", "event_id", F.to_json(record).alias("value"))
    parsed = events.parse_lines(lines)
    newest = events.newest_events(
        parsed, events=["model_endpoint_error", "ticket_created"], severities=["ERROR"],
        order=[F.desc("ts"), F.desc("event_id")],
    )
    return newest.select("ts", "event_id", "severity", "event", "message")


@query
def event_store_newest(spark, sf_dir):
    """The same from records stored by event and day; the last days are read backward."""
    path = scratch_path(spark, "event-store")
    names = F.when(F.col("event_type") == "error", "model_endpoint_error").when(
        F.col("event_type") == "signup", "ticket_created"
    ).otherwise("prediction")
    severity = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    records = B.table(spark, sf_dir, "events").select(
        "ts", "event_id", severity.alias("severity"), F.get_json_object("props", "$.k").alias("message"), names.alias("event"))
    for run in (0, 1):
        event_store.store_events(records.where(F.col("event_id") % 2 == run), path, str(run))
    newest = event_store.newest_stored(
        spark, path, "ts timestamp_ntz, event_id long, severity string, message string", ["model_endpoint_error", "ticket_created"],
        ["ERROR"], 50, [F.desc("ts"), F.desc("event_id")])
    return newest.select("ts", "event_id", "severity", "event", "message")


# --- Files ---------------------------------------------------------------------------------------


def _uploaded(spark, sf_dir):
    """Documents written out as uploads of up to 600 rows, then read back as uploads."""
    folder = scratch_path(spark, "uploads")
    docs = B.documents(spark, sf_dir).select(
        F.floor(F.col("ticket_id") / 600).alias("upload"), F.col("ticket_id").alias("id"),
        F.col("ticket_text").alias("Message"),
    )
    # One file per upload, in id order.
    docs.repartition("upload").sortWithinPartitions("upload", "id").write.partitionBy("upload").options(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
    return uploads.read_uploads(spark, f"{folder}/upload=*")


def _upload(file: str) -> Column:
    return F.regexp_extract(file, "upload=([^/]*)/", 1).cast("long").alias("upload")


@query
def csv_ingest(spark, sf_dir):
    capped = uploads.cap_uploads(_uploaded(spark, sf_dir))
    return capped.select(_upload("file"), "position", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("chars"))


@query
def csv_cap(spark, sf_dir):
    return uploads.upload_counts(_uploaded(spark, sf_dir)).select(_upload("file"), "accepted", "skipped")


@query
def dataset_roundtrip(spark, sf_dir):
    """The labelled orders as a CSV dataset, loaded back with all checks."""
    path = scratch_path(spark, "dataset")
    rows = B.grid_rows(spark, sf_dir).select(
        "ticket_id", F.col("issue_sub_category").alias("ticket_text"), F.upper("priority").alias("priority")
    )
    datasets.write_dataset(rows, path, "csv")
    back = datasets.load_labelled(spark, path)
    return back.select(F.col("ticket_id").cast("long").alias("ticket_id"), "ticket_text", "priority")


@query
def upload_tickets(spark, sf_dir):
    """Uploads as pending tickets of the user who sent them."""
    rows = uploads.pending_tickets(uploads.cap_uploads(_uploaded(spark, sf_dir)), _upload("file").cast("string"), _run_ts())
    return rows.groupBy("user_id", "source").agg(
        F.count(F.lit(1)).alias("n_tickets"), F.countDistinct("ticket_id").alias("n_ids"), F.sum(F.length("text")).alias("chars"),
        F.count("resolved_at").alias("n_resolved"),
    )


def _in_files(rows, key, path):
    """CSV part files in the order of ``key``, of at most some 100,000 rows each."""
    parts = max(4, -(-rows.count() // 100_000))
    datasets.write_dataset(rows.repartitionByRange(parts, key).sortWithinPartitions(key), path, "csv")


@query
def dataset_cap(spark, sf_dir):
    """Exactly the first 1,000 rows in the order of the files."""
    path = scratch_path(spark, "dataset-cap")
    _in_files(B.grid_rows(spark, sf_dir).select("ticket_id", F.col("issue_sub_category").alias("ticket_text"), "priority"), "ticket_id", path)
    back = datasets.load_labelled(spark, path, max_rows=1000)
    return back.select(F.col("ticket_id").cast("long").alias("ticket_id"), "priority")


@query
def saved_texts(spark, sf_dir):
    """User messages saved over several files; the last text of a conversation wins."""
    path = scratch_path(spark, "saved")
    _in_files(B.user_messages(spark, sf_dir).select("position", "ticket_id", "ticket_text"), "position", path)
    return generation.existing_texts(datasets.saved_texts(spark, path), "position")


# --- Streams -------------------------------------------------------------------------------------


def _request_stream(spark, sf_dir):
    stream = windows.table_stream(spark, sf_dir, "events.parquet")
    return stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query
def stream_request_windows(spark, sf_dir):
    """The windows that the watermark has closed."""
    path = scratch_path(spark, "stream-windows")
    windows.to_table(windows.request_windows(_request_stream(spark, sf_dir)), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_request_decisions(spark, sf_dir):
    """Equal to the batch decisions when requests arrive in order, here in four micro-batches."""
    path = scratch_path(spark, "stream-decisions")
    requests = B.requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    quarters = F.ntile(4).over(Window.orderBy("day"))
    days = requests.groupBy(F.to_date("ts").alias("day")).count().withColumn("quarter", quarters)
    edges = [r["noon"] for r in days.groupBy("quarter").agg((F.max("day").cast("timestamp") + F.expr("interval 12 hours")).alias("noon")).orderBy("quarter").collect()]
    low = None
    for high in [*edges[:-1], None]:
        # Cut at noon, so that windows go on in the next micro-batch.
        part = requests if low is None else requests.where(F.col("ts") >= low)
        part = part if high is None else part.where(F.col("ts") < high)
        part.write.mode("append").parquet(f"{path}/arriving")
        low = high
        arriving = windows.read_stream(spark, f"{path}/arriving")
        limits.decide_stream(arriving, f"{path}/rows", f"{path}/checkpoint", limit=LIMIT, window=WINDOW).awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select(
        "event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "request_number", "allowed",
    )


@query
def stream_pending_scoring(spark, sf_dir):
    """Documents arriving as a stream; the same rows as the batch job."""
    path = scratch_path(spark, "stream-pending")
    arriving = windows.table_stream(spark, sf_dir, "documents.parquet").select(
        F.col("doc_id").cast("string").alias("ticket_id"), "text"
    )
    pending.score_pending_stream(
        arriving, f"{path}/rows", f"{path}/checkpoint", scoring.column_scorer(B.text_features, B.text_logits), "1", "run-1", _run_ts()
    ).awaitTermination()
    return tables.read_table(spark, f"{path}/rows", S.PREDICTIONS).select(
        "ticket_id", "predicted_priority", F.round("confidence", 6).alias("confidence"), "model_version", "model_run_id",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )
