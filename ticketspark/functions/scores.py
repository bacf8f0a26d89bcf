"""Score expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.labels import decode


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(logits: Column) -> Column:
    """F11. Probabilities of an ``array<double>``; the maximum is subtracted first.

    Each intermediate is bound once: spelled out per label the formula repeats itself until the
    generated method is too long for the JVM to compile, and everything in its stage slows down.
    """
    def weights(x: Column) -> Column:
        return F.transform(x, lambda one: F.exp(one - F.array_max(x)))

    def shares(w: Column) -> Column:
        return F.transform(w, lambda one: one / F.aggregate(w, F.lit(0.0), lambda total, each: total + each))

    return _let(_let(logits, weights), shares)


def argmax(values: Column) -> Column:
    """F11. Zero-based position of the maximum; a tie takes the lowest position."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def score_map(probabilities: Column) -> Column:
    """Probabilities in label order as a map that names every label."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in S.LABELS]), probabilities)


def top_label(probabilities: Column) -> Column:
    return decode(argmax(probabilities))


def scores_to_json(scores: Column) -> Column:
    """F10."""
    return F.to_json(scores)


def scores_from_json(text: Column) -> Column:
    """F10."""
    return F.from_json(text, "map<string,double>")
