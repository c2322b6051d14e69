"""Calendar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a period label such as 2023Q1, 2023-Q1 or "fy 2023 q4" is read.
PERIOD_PATTERN = r"(?i)(20\d{2})\s*[- ]?\s*Q([1-4])"


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2))


def period_year(period: Column) -> Column:
    return F.nullif(F.regexp_extract(period, PERIOD_PATTERN, 1), F.lit("")).cast("int")


def period_quarter(period: Column) -> Column:
    return F.nullif(F.regexp_extract(period, PERIOD_PATTERN, 2), F.lit("")).cast("int")


def strict_date(col: Column) -> Column:
    """Text to date; text that is no date stops the job, under any ANSI setting."""
    found = col.try_cast("date")
    bad = F.raise_error(F.concat(F.lit("not a date: "), col.cast("string"))).cast("date")
    return F.when(col.isNotNull() & found.isNull(), bad).otherwise(found)


# Common ways to write a date, tried in this order after ISO dates and timestamps.
DATE_FORMATS = (
    "M/d/yyyy", "M/d/yy", "yyyy/M/d", "yyyyMMdd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy",
    "M-d-yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm",
)


def lenient_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to date, by the first form that reads it; text that is no date becomes NULL.

    ISO dates and timestamps come first, then `formats`, then milliseconds since 1970 (12 or 13
    digits). Month names are English. Columns that hold dates already are only cast.
    """
    text = F.trim(col.cast("string"))
    iso = col.try_cast("date")
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    millis = F.when(text.rlike(r"^-?\d{12,13}$"), F.timestamp_millis(text.try_cast("bigint")).cast("date"))
    return F.coalesce(iso, millis, *tried)


def unreadable_dates(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """How many entries hold something that is no date in any of the forms; an aggregate."""
    return F.count_if(col.isNotNull() & lenient_date(col, formats).isNull())
