"""Label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketspark import schemas as S


def _labels() -> Column:
    return F.array(*[F.lit(label) for label in S.LABELS])


def queue_rank(priority: Column) -> Column:
    """F3. 0 for the most pressing label; NULL and unknown labels come last."""
    position = F.array_position(F.array(*[F.lit(x) for x in S.QUEUE_ORDER]), priority)
    return F.when(position > 0, (position - 1).cast("int")).otherwise(F.lit(len(S.QUEUE_ORDER)))


def encode(label: Column) -> Column:
    """F12. Label to id; NULL for a label outside the vocabulary."""
    position = F.array_position(_labels(), label)
    return F.when(position > 0, (position - 1).cast("int"))


def decode(label_id: Column) -> Column:
    """F12. Id to label; NULL outside the vocabulary."""
    return F.when(label_id.between(0, len(S.LABELS) - 1), F.get(_labels(), label_id))


def shift(label: Column, by: Column) -> Column:
    """F5. Move along the ordinal scale and stop at its ends; NULL outside the vocabulary."""
    moved = F.greatest(F.lit(0), F.least(F.lit(len(S.LABELS) - 1), encode(label) + by))
    return F.when(label.isin(S.LABELS), decode(moved))


def percent(share: Column) -> Column:
    """F18. Whole percent, halves up; a missing value shows ``--``."""
    whole = F.floor(share * 100 + F.lit(0.5)).cast("string")
    return F.coalesce(F.concat(whole, F.lit("%")), F.lit("--"))
