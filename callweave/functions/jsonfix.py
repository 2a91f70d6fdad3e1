"""Reading model answers that are almost JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.text import strip

FENCE = "```"


def unfence(raw: Column) -> Column:
    """Drop a leading fence line and everything from the last fence on."""
    text = strip(raw)
    newline = F.instr(text, "\n")
    body = F.when(newline > 0, F.substring(text, newline + 1, F.length(text))).otherwise(text)
    tail = F.substring_index(body, FENCE, -1)
    cut = F.when(body.contains(FENCE), F.left(body, F.length(body) - F.length(tail) - 3)).otherwise(body)
    return F.when(text.startswith(FENCE), strip(cut)).otherwise(text)


def close_array(text: Column) -> Column:
    """Cut a truncated array after its last closed object and close it; null without one."""
    tail = F.substring_index(text, "}", -1)
    return F.when(
        text.contains("}"), F.concat(F.left(text, F.length(text) - F.length(tail)), F.lit("]"))
    )


def parse_rows(raw: Column, row_schema: str) -> Column:
    """Array of rows from a JSON array that may be fenced or cut off; null if beyond repair."""
    schema = f"array<struct<{row_schema}>>"
    text = unfence(raw)
    whole = F.when(is_json(text) & text.startswith("["), F.from_json(text, schema))
    fixed = close_array(text)
    repaired = F.when(is_json(fixed) & fixed.startswith("["), F.from_json(fixed, schema))
    return F.when(is_json(text), whole).otherwise(repaired)


def is_json(text: Column) -> Column:
    """True when the whole string parses; ``schema_of_json`` style parsing of a variant is strict."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
