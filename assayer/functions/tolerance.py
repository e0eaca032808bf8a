"""Numeric comparison with a tolerance: rounding to a scale (bags) and an exact band (keyed rows)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, NumericType, StructType

WORK = "decimal(38,18)"


def scale_of(tolerance: float) -> int:
    """Decimal places that a tolerance stands for: 1e-9 is 9, and 1 or more is 0."""
    return max(0, round(-math.log10(tolerance)))


def numeric(schema: StructType | None, names: list[str]) -> list[str]:
    return [n for n in names if schema is not None and isinstance(schema[n].dataType, NumericType)]


def rounded(column: Column, kind: DataType, scale: int) -> Column:
    """Rounded to the scale if the value fits the work type; whole numbers need none.

    Doubles beyond the work type (and NaN and infinities) keep their value: those that fit stand in one field of a
    struct and those that do not in the other.
    """
    if isinstance(kind, DecimalType):
        return F.round(column.try_cast(WORK), scale)
    if isinstance(kind, (FloatType, DoubleType)):
        fits = column.try_cast(WORK)
        return F.struct(F.round(fits, scale).alias("v"), F.when(fits.isNull(), column.cast("double")).alias("raw"))
    return column


def within(left: Column, right: Column, tolerance: float) -> Column:
    """|left - right| <= tolerance on exact decimals; values that do not fit them are compared as doubles. Null if either is."""
    a, b = left.try_cast(WORK), right.try_cast(WORK)
    exact = F.abs(a - b) <= F.lit(f"{tolerance:.18f}").cast(WORK)
    return F.coalesce(exact, left.cast("double") == right.cast("double"))
