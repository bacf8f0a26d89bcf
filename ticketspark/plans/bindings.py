"""The ticket tables, derived from the given Parquet tables.

Time stamps keep the zone-less type they are stored in, so results do not depend on the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.text import display_label, word_count
from ticketspark.operators.dataset import grid_cells, grid_size
from ticketspark.operators.distribution import apply_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Tickets from orders, predictions from lineitem ----------------------------------------------


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per order; orders with status F are resolved."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ticket_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("text"),
        F.lit("api").alias("source"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("resolved_at"),
    )


def labelled_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with the label their order priority names; 'NOT SPECIFIED' is unknown."""
    return tickets(spark, sf_dir).select(
        "ticket_id", display_label(F.expr("substring(text, 3)")).alias("priority")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per order line; many per ticket, some at the same time."""
    quantity = F.col("l_quantity")
    priority = (
        F.when(quantity < 13, "low").when(quantity < 26, "medium").when(quantity < 39, "high").otherwise("urgent")
    )
    return table(spark, sf_dir, "lineitem").select(
        # (order, line) repeats; with part and supplier it is unique.
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("prediction_id"),
        F.col("l_orderkey").alias("ticket_id"),
        priority.alias("predicted_priority"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_returnflag").alias("model_version"),
        F.col("l_linestatus").alias("model_run_id"),
        F.col("l_linenumber").alias("latency_ms"),
        F.col("l_shipdate").alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log from events: four changes per ticket, some by somebody else."""
    owners = tickets(spark, sf_dir).select("ticket_id", F.col("user_id").alias("owner"))
    changes = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("change_id"),
        F.floor(F.col("event_id") / 4).alias("ticket_id"),
        F.when(F.col("event_type") == "signup", "reopen").otherwise("resolve").alias("action"),
        (F.col("event_type") == "error").alias("foreign"),
        F.col("ts").alias("changed_at"),
    )
    user = F.when(F.col("foreign"), F.col("owner") + 1).otherwise(F.col("owner"))
    return changes.join(owners, "ticket_id").select(
        "change_id", "ticket_id", user.alias("user_id"), "action", "changed_at"
    )


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for single tickets: by the owner for finished orders, by a stranger for the rest."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ticket_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("user_id"),
    )


def judged(spark: SparkSession, sf_dir: str, newest: DataFrame) -> DataFrame:
    """Known label of each ticket next to that of its newest prediction."""
    truth = labelled_tickets(spark, sf_dir).where(F.col("priority") != S.UNKNOWN_LABEL)
    return truth.join(newest, "ticket_id").select(
        "ticket_id", F.col("priority").alias("true_label"), F.col("predicted_priority").alias("pred_label")
    )


# --- Tickets and predictions from documents ------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ticket_id"), F.col("source").alias("user_id"), F.col("text").alias("ticket_text")
    )


def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars")
    priority = F.when(size < 500, "low").when(size < 1500, "medium").when(size < 5000, "high").otherwise("urgent")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("prediction_id"),
        F.col("doc_id").alias("ticket_id"),
        priority.alias("predicted_priority"),
        (size / (size + 1000)).alias("confidence"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per labelled document; toxic ones carry a verdict that is not allowed, and
    documents that are not English were judged by a guest."""
    owners = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    verdict = (
        F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "thumbs_up").otherwise("thumbs_down")
    )
    user = F.when(F.col("lang") == "en", F.col("source")).otherwise("guest")
    return table(spark, sf_dir, "labels").join(owners, "doc_id").select(
        F.col("doc_id").alias("prediction_id"), user.alias("user_id"), verdict.alias("verdict")
    )


def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        F.col("conv_id").alias("ticket_id"), F.col("turn").alias("position"), F.col("text").alias("ticket_text")
    )


def text_features(text: Column) -> dict[str, Column]:
    return {"_words": word_count(text) + F.lit(1.0), "_marks": F.regexp_count(text, F.lit("[!?]"))}


def text_logits() -> list[Column]:
    """A small linear scorer: longer texts rank higher, question and exclamation marks push up."""
    size, marks = F.log("_words"), F.col("_marks") / F.col("_words")
    return [
        F.lit(4.0) - size,
        F.lit(1.2) + F.lit(0.2) * size,
        F.lit(0.6) * size - F.lit(0.8) + F.lit(2.0) * marks,
        size - F.lit(4.0) + F.lit(8.0) * marks,
    ]


# --- Training rows: every order takes a cell of the grid -----------------------------------------


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as training tickets; they walk through the cells of the grid over and over."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"))
    cells = grid_cells(orders, F.col("ticket_id") % grid_size())
    return apply_rules(cells).select(*S.GRID_COLUMNS)

