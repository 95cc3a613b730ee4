"""Rendering of rows to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an aligned row shows for a missing value, and the longest value shown in full.
NULL_SLOT, MAX_CHARS = "-", 196


def trim_zeros(number: Column) -> Column:
    """Drop the zeros that end a decimal number's text."""
    return F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)


def clean_value(value: Column, limit: int = MAX_CHARS) -> Column:
    """Text of a string value: set separators as '; ', white space squeezed, 't' and 'f' as booleans, long values cut
    with an ellipsis; null, empty and the empty set are null."""
    text = F.trim(F.regexp_replace(F.replace(value.cast("string"), F.lit("~"), F.lit("; ")), r"\s+", " "))
    text = F.when(text == "t", "true").when(text == "f", "false").otherwise(text)
    text = F.when((text == "") | (text == "{}"), F.lit(None)).otherwise(text)
    return ellipsis(text, limit)


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def key_value(fields: dict[str, Column]) -> Column:
    """'name: value' parts joined by ' | '; missing values leave no part."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{n}: "), c) for n, c in fields.items()))


def aligned(fields: dict[str, Column]) -> Column:
    """Values alone, one slot for each column, for rows below a header."""
    return F.concat_ws(" | ", *(F.coalesce(c, F.lit(NULL_SLOT)) for c in fields.values()))


def header(fields: dict[str, Column]) -> Column:
    return F.lit(" | ".join(fields))


def relative_days(ts: Column, seed_ts: Column) -> Column:
    """'Nd before' a seed's time, or 'FUTURE+Nd' (whole days, rounded down)."""
    days = F.floor((seed_ts - ts) / 86400)
    return F.when(days >= 0, F.concat(days.cast("string"), F.lit("d before"))).otherwise(F.concat(F.lit("FUTURE+"), (-days).cast("string"), F.lit("d")))
