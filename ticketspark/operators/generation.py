"""Prompt batches and the merge of their replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.prompts import batch_prompt, scenario_text
from ticketspark.functions.replies import reply_strings
from ticketspark.functions.text import is_blank
from ticketspark.operators.ranking import dense_index, last_value


def existing_texts(saved: DataFrame, position: str) -> DataFrame:
    """S4, W6. Texts already there, one per ticket; the last non-blank one wins."""
    return last_value(saved.where(~is_blank("ticket_text")), "ticket_id", "ticket_text", position)


def still_to_do(grid: DataFrame, existing: DataFrame) -> DataFrame:
    """J7. Rows without a text yet."""
    return grid.join(existing.select("ticket_id"), "ticket_id", "left_anti")


def chunked(df: DataFrame, key: str = "ticket_id", size: int = S.PROMPT_BATCH) -> DataFrame:
    """W5. ``batch_id`` from 1 and ``pos`` from 0 in key order; the last batch may be short."""
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    return (
        dense_index(df, key, into="_index")
        .withColumn("batch_id", F.floor(F.col("_index") / size) + 1)
        .withColumn("pos", (F.col("_index") % size).cast("int"))
        .drop("_index")
    )


def prompt_batches(todo: DataFrame, size: int = S.PROMPT_BATCH) -> DataFrame:
    """F15. One prompt per chunk of grid rows; a group never holds more than ``size`` rows."""
    rows = chunked(todo, "ticket_id", size).select("batch_id", "pos", scenario_text().alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda row: row["text"])
    grouped = rows.groupBy("batch_id").agg(ordered.alias("scenarios"))
    return grouped.select("batch_id", F.size("scenarios").alias("n_rows"), batch_prompt(F.col("scenarios")).alias("prompt"))


def accepted_replies(replies: DataFrame, expected: DataFrame, attempts: int = S.REPLY_ATTEMPTS) -> DataFrame:
    """M9. First attempt per batch that parses to exactly ``n_rows`` strings.

    ``replies`` has batch_id, attempt (from 1) and raw; ``expected`` has batch_id and n_rows.
    """
    parsed = replies.where(F.col("attempt").between(1, attempts)).select(
        "batch_id", "attempt", reply_strings(F.col("raw")).alias("texts")
    )
    right_size = parsed.join(expected.select("batch_id", "n_rows"), "batch_id").where(
        F.size("texts") == F.col("n_rows")
    )
    return right_size.groupBy("batch_id").agg(F.min_by("texts", "attempt").alias("texts"), F.min("attempt").alias("attempt"))


def merge_replies(todo: DataFrame, accepted: DataFrame) -> DataFrame:
    """J8. Write accepted texts back by position; a batch without a valid reply stays NULL.

    ``todo`` has ticket_id, batch_id and pos.
    """
    texts = accepted.select("batch_id", F.posexplode("texts").alias("pos", "_new"))
    merged = todo.join(texts, ["batch_id", "pos"], "left")
    old = F.col("ticket_text") if "ticket_text" in todo.columns else F.lit(None).cast("string")
    return merged.withColumn("ticket_text", F.coalesce("_new", old)).drop("_new")


def resume(grid: DataFrame, existing: DataFrame, merged: DataFrame) -> DataFrame:
    """Whole grid with the texts known after this run; new ones come first."""
    known = merged.select("ticket_id", F.col("ticket_text").alias("_new"))
    return (
        grid.join(existing.select("ticket_id", "ticket_text"), "ticket_id", "left")
        .join(known, "ticket_id", "left")
        .withColumn("ticket_text", F.coalesce("_new", "ticket_text"))
        .drop("_new")
    )


def completion(rows: DataFrame, text: str = "ticket_text") -> DataFrame:
    """A12. How much of the grid has a text; the share is NULL for an empty grid."""
    filled = F.count_if(~is_blank(text))
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("total"),
        filled.alias("filled"),
        (total - filled).alias("missing"),
        F.try_divide(filled, total).alias("share"),
    )
