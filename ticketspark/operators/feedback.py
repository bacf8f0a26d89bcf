"""Reviewer feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark import schemas as S


def check_feedback(feedback: DataFrame, predictions: DataFrame, tickets: DataFrame) -> DataFrame:
    """P13, J4. Feedback with ``reason``, NULL when accepted.

    A prediction of somebody else's ticket gives the same reason as one that does not exist.
    ``feedback`` has prediction_id, user_id and verdict.
    """
    owners = (
        predictions.select("prediction_id", "ticket_id")
        .join(tickets.select("ticket_id", F.col("user_id").alias("_owner")), "ticket_id")
        .select("prediction_id", "_owner")
    )
    mine = F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    valid = F.coalesce(F.col("verdict").isin(S.VERDICTS), F.lit(False))
    return (
        feedback.join(owners, "prediction_id", "left")
        .withColumn("reason", F.when(~valid, "bad_verdict").when(~mine, "unknown_prediction"))
        .drop("_owner")
    )


def accept_feedback(feedback: DataFrame, predictions: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    checked = check_feedback(feedback, predictions, tickets)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def enrich_feedback(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """J11. Feedback with ticket, priority and confidence; NULL where the prediction is gone."""
    context = predictions.select("prediction_id", "ticket_id", "predicted_priority", "confidence")
    return feedback.join(context, "prediction_id", "left")
