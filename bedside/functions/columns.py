"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_distinct(column: Column | str, value: Any) -> Column:
    """Null-safe inequality: NULL is distinct from every value."""
    return ~_col(column).eqNullSafe(value)


def nan_to_null(column: Column | str) -> Column:
    """Missing is NULL everywhere; Spark orders NaN above every number, so it must go first."""
    return F.nanvl(_col(column), F.lit(None).cast("double"))


def to_double(column: Column | str) -> Column:
    """Text measurement to number; text that is not a number becomes NULL instead of an ANSI error."""
    return _col(column).try_cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL for a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def round_half_even(column: Column | str, digits: int) -> Column:
    """Round like numerical libraries do: scale, take the nearest even integer on ties, scale back."""
    scale = float(10**digits)
    return F.rint(_col(column) * scale) / scale


def code_category(column: Column | str, mapping: Mapping[str, Iterable[int]]) -> Column:
    """Label of the code set a code belongs to, NULL outside of all of them."""
    column = _col(column)
    label = F.lit(None).cast("string")
    for name, codes in reversed(list(mapping.items())):
        label = F.when(column.isin(list(codes)), F.lit(name)).otherwise(label)
    return label


def parse_float_array(column: Column | str) -> Column:
    """``'[0.1 0.2]'`` (bracketed text, blanks or commas between numbers) to ``array<double>``."""
    bare = F.trim(F.regexp_replace(_col(column), r"[\[\],\s]+", " "))
    parts = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))
    return F.transform(parts, lambda x: x.try_cast("double"))


def linspace(n: int = 100) -> Column:
    """``n`` equally spaced points from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(n - 1)))
