"""Numbers in texts, compared by value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal, an integer, or a bare fraction that does not continue a word or number. Works without lookbehind.
NUMBER = r"(\d+\.\d+|\d+|(?:^|[^\p{L}\p{N}_.])\.\d+)"


def canonical(x: Column) -> Column:
    """One spelling for each value: no leading zeros, no trailing zeros of a fraction, 0 before a bare fraction."""
    y = F.regexp_extract(x, r"(\.?\d.*)$", 1)
    y = F.when(y.startswith("."), F.concat(F.lit("0"), y)).otherwise(F.regexp_replace(y, "^0+([0-9])", "$1"))
    return F.when(y.contains("."), F.regexp_replace(y, r"\.?0+$", "")).otherwise(y)


def number_keys(text: Column) -> Column:
    """Distinct values in a text, in order of appearance; none for null."""
    return F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), canonical)), F.array().cast("array<string>"))


def missing_numbers(claim: Column, sources: Column) -> Column:
    """Values of the claim that the sources lack, sorted as strings."""
    return F.array_sort(F.array_except(number_keys(claim), number_keys(sources)))
