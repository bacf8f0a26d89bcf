"""Free-text replies to arrays of strings (F16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketspark.functions.text import strip

# The patterns that open and close a code fence, and the widest bracket pair.
FENCE_OPEN = r"(?i)\A```(?:json)?\s*"
FENCE_CLOSE = r"\s*```\z"
WIDEST_ARRAY = r"(?s)\[.*\]"

# A JSON array of strings and nothing else. JSON parsers stop after the first value and turn
# numbers into strings, so the shape is decided here. All loops are possessive: one pass, no stack.
_CHARS = r'[^"\\\x00-\x1f]*+'
_STRING = rf'"{_CHARS}(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}){_CHARS})*+"'
_GAP = r"[ \t\n\r]*+"
STRING_ARRAY = rf"\A{_GAP}\[{_GAP}(?:{_STRING}{_GAP}(?:,{_GAP}{_STRING}{_GAP})*+)?+\]{_GAP}\z"


def _strings(text: Column) -> Column:
    """``array<string>`` if ``text`` is a JSON array holding only strings, else NULL."""
    return F.when(text.rlike(STRING_ARRAY), F.from_json(text, "array<string>"))


def reply_strings(raw: Column) -> Column:
    """F16. The whole reply without its code fence, else the widest ``[...]`` inside it."""
    unfenced = strip(F.regexp_replace(strip(raw), FENCE_OPEN, ""))
    whole = _strings(strip(F.regexp_replace(unfenced, FENCE_CLOSE, "")))
    found = F.nullif(F.regexp_extract(raw, WIDEST_ARRAY, 0), F.lit(""))
    return F.coalesce(whole, _strings(found))
