"""Dataset cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.text import has_words, is_blank, reject_reason
from ticketspark.session import written


def _digested(df: DataFrame, text: str, key: str) -> DataFrame:
    """Key, text digest and flags: all that counting and de-duplication need to shuffle."""
    return df.select(
        F.col(key).alias("_key"),
        F.when(~is_blank(text), F.sha2(F.col(text), 256)).alias("_digest"),
        has_words(text, S.MIN_WORDS).alias("_long"),
    )


def _copy_marks(df: DataFrame, text: str, key: str) -> DataFrame:
    """Per key and text that more rows have: the smallest key of that text, and how often this key has it."""
    rows = df.select(F.col(key).alias("_key"), F.sha2(F.col(text), 256).alias("_digest")).where("_digest is not null")
    repeated = (
        rows.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1").drop("_rows")
    )
    hits = rows.join(repeated, "_digest")
    return hits.groupBy("_key", "_digest").agg(F.first("_first").alias("_first"), F.count(F.lit(1)).alias("_times"))


def _one_of_each(rows: DataFrame, *same: str) -> DataFrame:
    """One row of each group; cut before the shuffle, where there is one."""
    number = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
    return rows.withColumn("_copy", number).where("_copy = 1").drop("_copy")


def drop_duplicate_texts(df: DataFrame, text: str = "ticket_text", key: str = "ticket_id") -> DataFrame:
    """W2. Keep one row of each exact text, that with the smallest key; NULL texts all stay.

    Texts stay where they are. Only (key, digest) rows are grouped and joined; what comes out is written, one row per key
    with the digests it loses, and meets the rows by the key alone: a table that is bucketed by key is not moved. Copies
    under one key, and rows without a key, take a scan of their own, which is planned only where there are such copies.
    A NULL key is larger than any other. Which of the rows that repeat both key and text stays is open.
    """
    marks = written(_copy_marks(df, text, key), "copies")
    again = F.col("_key").isNotNull() & (F.col("_key") == F.col("_first")) & (F.col("_times") > 1)
    # Two flags.
    some = marks.agg(F.bool_or(again).alias("again"), F.bool_or(F.col("_key").isNull()).alias("keyless")).first()
    lost = marks.where(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.collect_set(F.when(F.col("_key") != F.col("_first"), F.col("_digest"))).alias("_lost"),
        F.collect_set(F.when(again, F.col("_digest"))).alias("_again"),
    ).where("size(_lost) + size(_again) > 0")
    digest = F.sha2(F.col(text), 256)

    def has(digests: str):
        return F.when(F.col(digests).isNotNull(), F.coalesce(F.array_contains(digests, digest), F.lit(False))).otherwise(False)

    left = df.join(lost, F.col(key) == F.col("_key"), "left").where(~has("_lost"))
    if not some["again"]:
        kept = left.select(*df.columns)
    else:
        copies = left.where(has("_again")).withColumn("_digest", digest)
        kept = left.where(~has("_again")).select(*df.columns).unionByName(_one_of_each(copies, key, "_digest").select(*df.columns))
    if not some["keyless"]:
        return kept
    known = marks.where(F.col("_key").isNull()).select(F.col("_digest").alias("_of"), "_first")
    # At most one row per text of the keyless rows, on both sides of the join.
    keyless = df.where(F.col(key).isNull()).withColumn("_digest", digest)
    unique = keyless.join(known, F.col("_digest") == F.col("_of"), "left_anti")
    no_key = _one_of_each(keyless.join(known.where("_first is null"), F.col("_digest") == F.col("_of"), "left_semi"), "_digest")
    return kept.where(F.col(key).isNotNull()).unionByName(unique.select(*df.columns)).unionByName(no_key.select(*df.columns))


def clean(df: DataFrame, text: str = "ticket_text", key: str = "ticket_id") -> DataFrame:
    """M8. Drop blank texts, then repeated ones, then those with fewer than ten words."""
    # Copies share their word count, so dropping short texts early keeps the same rows and lets
    # the de-duplication see less.
    return drop_duplicate_texts(df.where(~is_blank(text) & has_words(text, S.MIN_WORDS)), text, key)


def clean_counters(df: DataFrame, text: str = "ticket_text", key: str = "ticket_id") -> DataFrame:
    """A6. How many rows each cleaning stage drops; a row counts at the first stage it fails."""
    per_text = (
        _digested(df, text, key)
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("rows"), F.bool_or("_long").alias("long"))
    )
    blank = F.col("_digest").isNull()
    kept = F.count_if(~blank & F.col("long"))
    seen = F.coalesce(F.sum("rows"), F.lit(0))
    return per_text.agg(
        seen.alias("seen"),
        F.coalesce(F.sum(F.when(blank, F.col("rows"))), F.lit(0)).alias("dropped_blank"),
        F.coalesce(F.sum(F.when(~blank, F.col("rows") - 1)), F.lit(0)).alias("dropped_duplicate"),
        F.count_if(~blank & ~F.col("long")).alias("dropped_short"),
        (seen - kept).alias("dropped_total"),
        kept.alias("kept"),
    )


def validity(df: DataFrame, text: str = "ticket_text") -> DataFrame:
    """P7. Every row with ``reason``: NULL when accepted."""
    return df.withColumn("reason", reject_reason(text))


def split_valid(df: DataFrame, text: str = "ticket_text") -> tuple[DataFrame, DataFrame]:
    """P7. (accepted, rejected with reason)."""
    checked = validity(df, text)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")
