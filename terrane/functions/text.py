"""Text of report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(name: Column) -> Column:
    """Underscores to blanks, and a capital after everything that is no letter."""
    spaced = F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    marked = F.regexp_replace(spaced, r"([^\p{L}])", "$1\u0001")
    words = F.split(marked, "\u0001", -1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def thousands(n: Column) -> Column:
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))


def fixed(x: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", x)
