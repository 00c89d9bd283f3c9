"""Scalar expressions on ratings, ranks and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(p: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(as_col(low), F.least(as_col(high), p))


def prob_by_rank(rank: Column, n: Column) -> Column:
    """1 for the first of n, 0 for the last; 1 for an only one."""
    return F.when(n == 1, F.lit(1.0)).otherwise(F.try_divide((n - rank).cast("double"), (n - 1).cast("double")))


def rating_to_interaction(r: Column, least: float = 3.0) -> Column:
    return F.when(r < least, F.lit(-1.0)).otherwise(F.lit(1.0))


def sign_interaction(r: Column) -> Column:
    return F.when(r > 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def ceiling(count: Column, most: int = 5) -> Column:
    return F.least(count, F.lit(most)).cast("double")


def log2_floored(p: Column, least: float = 1e-100) -> Column:
    return F.log2(F.greatest(p, F.lit(least)))


def rescale(x: Column, low: Column, high: Column, to_low: Column, to_high: Column) -> Column:
    """x from low..high to to_low..to_high; to_low where the first range is a point."""
    return F.when(high == low, to_low).otherwise((x - low) * F.try_divide(to_high - to_low, high - low) + to_low)


def half_even(x: Column) -> Column:
    return F.rint(x)


def number(text: Column, kind: str = "double") -> Column:
    return text.try_cast(kind)


def whole_number(text: Column) -> Column:
    """A whole number out of text such as '12' or '12.0'."""
    return text.try_cast("double").try_cast("long")


def one_decimal(x: Column) -> Column:
    """A number as text with one digit after the point, as ids are stored in one data set."""
    return F.format_string("%.1f", x.cast("double"))


def truth(text: Column) -> Column:
    return F.lower(text).isin("yes", "true", "t", "1")


def iso_time(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'")
