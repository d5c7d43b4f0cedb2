"""Text to number conversions as column expressions; bad text gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.schema import U32_MAX

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
DIGITS = r"^\+?[0-9]+$"


def u32_or_null(text: Column) -> Column:
    """An unsigned 32-bit number, or NULL."""
    n = F.when(text.rlike(DIGITS), text.try_cast("decimal(38,0)"))
    return F.when(n <= U32_MAX, n.cast("long"))


def f32_or_null(text: Column) -> Column:
    """An IEEE single, or NULL."""
    return F.when(text.rlike(FLOAT), text.try_cast("float"))


def date_or_null(text: Column) -> Column:
    """ISO date or timestamp text to the integer YYYYMMDD of the date as written, or NULL."""
    return F.when(text.rlike(ISO), F.date_format(F.substring(text, 1, 10).try_cast("date"), "yyyyMMdd").cast("long"))


def epoch_or_null(text: Column) -> Column:
    """ISO text to epoch seconds rounded half to even, or NULL. Text without an offset is in the session's zone."""
    return F.when(text.rlike(ISO), F.bround(text.try_cast("timestamp").cast("decimal(20,6)"), 0).cast("long"))


def calendar_date(date: Column) -> Column:
    """The integer YYYYMMDD as a DATE; NULL if no such day exists."""
    return F.try_to_date(date.cast("string"), "yyyyMMdd")
