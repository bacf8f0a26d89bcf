"""Identifier and clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_start(ts: Column, unit: str = "minute") -> Column:
    """F7. Start of the calendar unit that holds ``ts``."""
    return F.date_trunc(unit, ts)


def run_id(prefix: str, ts: Column) -> Column:
    """F8. For example ``pred-20260419-020000``."""
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyyMMdd-HHmmss"))


def iso_utc(ts: Column) -> Column:
    """F8. ISO stamp with a trailing Z; the session zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_label(value: Column) -> Column:
    """F13. Lowercase; anything but letters, digits, dash, underscore becomes a dash; 63 at most."""
    return F.substring(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_-]", "-"), 1, 63)


def run_of_artifact(uri: Column) -> Column:
    """F14. The path part before a final ``model``, else the last part; end slashes are ignored."""
    parts = F.split(F.regexp_replace(uri, "/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when((last == "model") & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def row_id(*parts: Column | str) -> Column:
    """F17. Same parts, same id: a retried task writes the same row again."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *texts), 256)


def seeded_hash(seed: int, *key: Column | str) -> Column:
    """Reproducible pseudo-random order: 32 hex digits of md5 over seed and key."""
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))
