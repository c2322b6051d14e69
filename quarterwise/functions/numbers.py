"""Number expressions that keep bad or missing input as NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text that stands for a missing entry in record files.
NOT_AVAILABLE = "N/A"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(NOT_AVAILABLE))


def null_to_blank(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(NOT_AVAILABLE))


def lenient_double(col: Column) -> Column:
    """Text or number to double; anything else, NaN included, becomes NULL.

    The JVM also reads Java literals such as '1.5d' as numbers; those are text here.
    """
    text = col.cast("string")
    value = F.when(~text.rlike("[0-9.][dDfF]\\s*$"), text.try_cast("double"))
    return F.nullif(value, F.lit(float("nan")))


def growth(value: Column, base: Column) -> Column:
    """value / base - 1, NULL where base is zero."""
    return F.try_divide(value, base) - F.lit(1)


def rmse(squared_error: Column) -> Column:
    return F.sqrt(F.avg(squared_error))
