"""The ticket queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.labels import queue_rank
from ticketspark.operators.ranking import first_in_group, latest_per_key

# What a queue row takes from its newest prediction.
PREDICTION_COLUMNS = [
    "prediction_id", "predicted_priority", "confidence", "all_scores", "model_version",
    "model_run_id", "latency_ms",
]


def newest_prediction(predictions: DataFrame) -> DataFrame:
    """W1. The newest prediction of each ticket; equal times go to the larger id."""
    return latest_per_key(predictions, ["ticket_id"], [F.desc("created_at"), F.desc("prediction_id")])


def visible(tickets: DataFrame, user_id=None, include_resolved: bool = False) -> DataFrame:
    """P2. Owner scope and open filter. Both reach the scan."""
    if user_id is not None:
        tickets = tickets.where(F.col("user_id") == F.lit(user_id))
    return tickets if include_resolved else tickets.where(F.col("resolved_at").isNull())


def with_newest_prediction(
    tickets: DataFrame, predictions: DataFrame, only_these_tickets: bool = False
) -> DataFrame:
    """J1, P8. Every ticket with its newest prediction; pending tickets read as unknown.

    ``only_these_tickets`` drops the predictions of other tickets before they are ranked, which
    pays when the tickets were cut down to one owner.
    """
    present = [c for c in PREDICTION_COLUMNS if c in predictions.columns]
    history = predictions.select("ticket_id", "created_at", *present)
    if only_these_tickets:
        history = history.join(tickets.select("ticket_id"), "ticket_id", "left_semi")
    joined = tickets.join(newest_prediction(history).drop("created_at"), "ticket_id", "left")
    defaults = {
        "predicted_priority": F.coalesce(F.nullif("predicted_priority", F.lit("")), F.lit(S.UNKNOWN_LABEL))
    }
    if "all_scores" in present:
        defaults["all_scores"] = F.coalesce("all_scores", F.create_map().cast(S.SCORES))
    return joined.withColumns(defaults)


def queue_order() -> list[Column]:
    """T1. Rank of the label, then newest first, then the id."""
    return [queue_rank(F.col("predicted_priority")), F.desc("created_at"), F.col("ticket_id")]


def check_limit(limit: int) -> int:
    if not 1 <= limit <= S.QUEUE_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {S.QUEUE_LIMIT_MAX}, got {limit}")
    return limit


def triage_queue(
    tickets: DataFrame,
    predictions: DataFrame,
    user_id=None,
    include_resolved: bool = False,
    limit: int = S.QUEUE_LIMIT_DEFAULT,
) -> DataFrame:
    """T1. The head of the queue; plans as a top-k without a full sort."""
    check_limit(limit)
    scope = visible(tickets, user_id, include_resolved)
    records = with_newest_prediction(scope, predictions, only_these_tickets=user_id is not None)
    return records.orderBy(*queue_order()).limit(limit)


def queue_per_user(
    tickets: DataFrame,
    predictions: DataFrame,
    include_resolved: bool = False,
    limit: int = S.QUEUE_LIMIT_DEFAULT,
) -> DataFrame:
    """P2, T1. Every owner's own queue in one job, ``position`` counting from 1."""
    check_limit(limit)
    records = with_newest_prediction(visible(tickets, None, include_resolved), predictions)
    return first_in_group(records, ["user_id"], queue_order(), limit)


def ticket_lookup(tickets: DataFrame, predictions: DataFrame, ticket_id, user_id) -> DataFrame:
    """J2. One ticket of one owner; empty when it is unknown or not theirs."""
    owned = tickets.where((F.col("ticket_id") == F.lit(ticket_id)) & (F.col("user_id") == F.lit(user_id)))
    history = predictions.where(F.col("ticket_id") == F.lit(ticket_id))
    return with_newest_prediction(owned, history)


def lookup_many(requests: DataFrame, tickets: DataFrame, predictions: DataFrame) -> DataFrame:
    """J2 for a table of (ticket_id, user_id) requests; ``found`` is false for unknown or foreign."""
    asked = requests.select("ticket_id", "user_id")
    owned = tickets.join(asked.distinct(), ["ticket_id", "user_id"], "left_semi")
    records = with_newest_prediction(owned, predictions, only_these_tickets=True)
    return asked.join(records.withColumn("found", F.lit(True)), ["ticket_id", "user_id"], "left").fillna(
        False, ["found"]
    )


def user_history(tickets: DataFrame, user_id=None) -> DataFrame:
    """T2. Tickets newest first; all owners one after the other when none is given.

    The sort key ends in the unique id, so range partitions stay even for a busy owner.
    """
    rows = visible(tickets, user_id, include_resolved=True)
    return rows.select("user_id", "ticket_id", "resolved_at", "created_at").orderBy(
        "user_id", F.desc("created_at"), "ticket_id"
    )


def split_pending(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10. (classified, pending)."""
    pending = F.col("prediction_id").isNull()
    return records.where(~pending), records.where(pending)


def queue_counts(records: DataFrame) -> DataFrame:
    """A14. Headline counts; the total always includes pending tickets."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prediction_id").isNotNull()).alias("classified"),
        F.count_if(F.col("prediction_id").isNull()).alias("pending"),
    )


def status_counts(tickets: DataFrame) -> DataFrame:
    """A3. Open and resolved tickets per owner, most open first."""
    return (
        tickets.groupBy("user_id")
        .agg(
            F.count_if(F.col("resolved_at").isNull()).alias("open_tickets"),
            F.count_if(F.col("resolved_at").isNotNull()).alias("resolved_tickets"),
        )
        .orderBy(F.desc("open_tickets"), "user_id")
    )


def _owned_changes(changes: DataFrame, tickets: DataFrame) -> DataFrame:
    owners = tickets.select("ticket_id", F.col("user_id").alias("_owner"))
    return changes.join(owners, "ticket_id", "left").withColumn(
        "_owned", F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    )


def apply_resolutions(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """P14. Tickets after a batch of changes (change_id, ticket_id, user_id, action, changed_at).

    The last change by the owner wins; ``resolve`` stamps its time, ``reopen`` clears the stamp.
    """
    owned = _owned_changes(changes, tickets).where("_owned")
    last = latest_per_key(
        owned.select("ticket_id", "action", "changed_at", "change_id"),
        ["ticket_id"],
        [F.desc("changed_at"), F.desc("change_id")],
    ).drop("change_id")
    stamped = (
        F.when(F.col("action") == "resolve", F.col("changed_at"))
        .when(F.col("action").isNull(), F.col("resolved_at"))
    )
    return (
        tickets.join(last, "ticket_id", "left").withColumn("resolved_at", stamped).select(*tickets.columns)
    )


def rejected_resolutions(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """P14. Changes to tickets that are unknown or not the caller's; the two look the same."""
    return _owned_changes(changes, tickets).where("not _owned").select(*changes.columns)


def purge_users(
    users: DataFrame, tickets: DataFrame, predictions: DataFrame, feedback: DataFrame, counters: DataFrame
) -> dict[str, DataFrame]:
    """J10. What is left of each table once the given owners are gone.

    Predictions and feedback go with their tickets. Each list of removed keys is distinct before
    its join, so only the kept side can be skewed, and that side AQE may split.
    """
    gone = users.select("user_id").distinct()
    gone_tickets = tickets.join(gone, "user_id", "left_semi").select("ticket_id")
    gone_predictions = predictions.join(gone_tickets, "ticket_id", "left_semi").select("prediction_id")
    return {
        "tickets": tickets.join(gone, "user_id", "left_anti"),
        "predictions": predictions.join(gone_tickets, "ticket_id", "left_anti"),
        "feedback": feedback.join(gone_predictions, "prediction_id", "left_anti"),
        "rate_limit_counters": counters.join(gone, "user_id", "left_anti"),
    }
