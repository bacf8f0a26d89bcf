"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketspark import schemas as S

# First and last code point of every run of white space. ``trim()`` knows only the blank.
SPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
SPACES = "".join(chr(code) for first, last in SPACE_RANGES for code in range(first, last + 1))
# The same set as the body of a Java regex class: one table look-up per character.
SPACE_CLASS = r"\s\x1c-\x1f"
UNICODE = "(?U)"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """F1. Unicode strip: touches only the two ends, so long texts stay cheap."""
    return F.btrim(_col(column), F.lit(SPACES))


def is_blank(column: Column | str) -> Column:
    """P5. Null, empty, or only white space."""
    return _col(column).isNull() | (strip(column) == "")


def normalise_label(column: Column | str) -> Column:
    """F2. Stored form: stripped and lowercase."""
    return F.lower(strip(column))


def display_label(column: Column | str) -> Column:
    """F2. Display form: lowercase, first ``_priority`` removed, non-members become unknown."""
    lowered = F.lower(F.coalesce(_col(column), F.lit(S.UNKNOWN_LABEL)))
    clean = F.regexp_replace(lowered, "(?s)^(.*?)_priority", "$1")
    return F.when(clean.isin(S.LABELS), clean).otherwise(S.UNKNOWN_LABEL)


def word_count(column: Column | str) -> Column:
    """F6. Number of runs without white space."""
    return F.regexp_count(_col(column), F.lit(f"{UNICODE}[^{SPACE_CLASS}]+"))


def has_words(column: Column | str, at_least: int) -> Column:
    """``word_count >= at_least``, decided as soon as enough words were seen.

    Anchored and possessive, so the scan is linear also for texts that are one long word.
    """
    if at_least <= 0:
        return _col(column).isNotNull()
    more = f"(?:[^{SPACE_CLASS}]++[{SPACE_CLASS}]++){{{at_least - 1}}}" if at_least > 1 else ""
    return _col(column).rlike(rf"{UNICODE}\A[{SPACE_CLASS}]*+{more}[^{SPACE_CLASS}]")


def comma_list(column: Column | str) -> Column:
    """F9. Comma list to array; entries stripped, empty ones dropped, NULL stays NULL."""
    parts = F.transform(F.split(_col(column), ","), strip)
    return F.filter(parts, lambda part: part != "")


def long_enough(column: Column | str, at_least: int = S.MIN_UPLOAD_CHARS) -> Column:
    """P6. Length after the strip; the bound itself is kept."""
    return F.coalesce(F.length(strip(column)) >= at_least, F.lit(False))


def reject_reason(column: Column | str, max_chars: int = S.MAX_TEXT_CHARS) -> Column:
    """P7. NULL for a valid text, else why it is refused. Length is taken before the strip."""
    return (
        F.when(_col(column).isNull(), F.lit("missing"))
        .when(F.length(_col(column)) > max_chars, F.lit("too_long"))
        .when(strip(column) == "", F.lit("blank"))
    )


def log_preview(column: Column | str, chars: int = S.LOG_PREVIEW_CHARS) -> Column:
    """P9. First characters, as event records carry them."""
    return F.substring(_col(column), 1, chars)


def list_preview(column: Column | str, chars: int = S.LIST_PREVIEW_CHARS) -> Column:
    """P9. Display form: an ellipsis marks a shortened text."""
    text = F.coalesce(_col(column), F.lit(""))
    cut = F.concat(strip(F.substring(text, 1, chars)), F.lit("..."))
    return F.when(F.length(text) > chars, cut).otherwise(text)
