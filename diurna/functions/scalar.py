"""Scalar column helpers (P5-P16). All are JVM-side expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in calendar order, Monday = 0.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Column by exact name, even when it contains dots (``weather_code_26.0``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def sentinel_to_null(c, sentinel) -> Column:
    """P5: a sentinel value means missing."""
    c = col_(c)
    return F.when(c == F.lit(sentinel), F.lit(None)).otherwise(c)


def round_half_even(c, digits: int) -> Column:
    """Half-even rounding (``round`` would be half-up)."""
    return F.bround(col_(c), digits)


def round_to_long(c) -> Column:
    """Round a prediction half-even to an integer count."""
    return F.bround(col_(c), 0).cast("long")


def weekday_name(d) -> Column:
    """P10: full English day name (``dayname`` only gives the short form)."""
    return F.date_format(col_(d), "EEEE")


def weekday_ordinal(d) -> Column:
    """Calendar ordinal with Monday = 0 from a date."""
    return F.weekday(col_(d))


def weekday_name_to_ordinal(name) -> Column:
    """Weekday name -> Monday = 0 ordinal."""
    m = F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(WEEKDAY_NAMES)))
    return m[col_(name)]


def working_flag(holiday, weekend) -> Column:
    """1 iff neither holiday nor weekend."""
    return ((col_(holiday) == 0) & (col_(weekend) == 0)).cast("int")


def label_of(code, labels: dict) -> Column:
    """Code -> label; an unknown code falls back to its own text."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    c = col_(code)
    return F.coalesce(m[c], c.cast("string"))


def iso_date(year, month, day) -> Column:
    """Zero-padded ISO date text from parts."""
    return F.date_format(F.make_date(col_(year), col_(month), col_(day)), "yyyy-MM-dd")


def abs_error(actual, predicted) -> Column:
    """P15."""
    return F.abs(col_(actual) - col_(predicted))


def share_percent(flag) -> Column:
    """Aggregate, percent of rows where ``flag`` holds."""
    return F.count_if(col_(flag)) * 100.0 / F.count(F.lit(1))
