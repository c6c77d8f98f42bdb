"""Column builders that carry the numeric rules: quanta, half-up and half-even
rounding, guarded ratios, elapsed-time windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The moment that queries over the fixture tables look from.
AS_OF = datetime(1998, 6, 1)


def moment(at: datetime | Column) -> Column:
    """A moment as a column; one that each row has of its own stays as it is."""
    if isinstance(at, Column):
        return at
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def ago(at: datetime, days: int) -> Column:
    return moment(at) - F.expr(f"INTERVAL '{days}' DAY")


def within(column: Column, at: datetime, days: int) -> Column:
    """Elapsed time is at most ``days``, both ends included; never in the future."""
    return (column <= moment(at)) & (column >= ago(at, days))


def between_ages(column: Column, at: datetime, young: int, old: int) -> Column:
    """young < age <= old, in days of elapsed time."""
    return (column < ago(at, young)) & (column >= ago(at, old))


def exact(value: Column) -> Column:
    return value.cast("decimal(24,8)")


def half_up(value: Column, places: int) -> Column:
    return F.round(exact(value), places)


def half_even(value: Column, places: int) -> Column:
    return F.bround(exact(value), places)


def ratio(part: Column, whole: Column) -> Column:
    """Null instead of a division by zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """Six places, half up."""
    return half_up(ratio(part, whole), 6)


def quantile(value: Column, q: float = 0.5, places: int = 2) -> Column:
    """Exact, linearly interpolated, half up."""
    return half_up(F.percentile(value.cast("double"), F.lit(q)), places)


def elapsed_days(start: Column, end: Column) -> Column:
    """Fractional days, 0 at least."""
    return F.greatest(F.timestamp_diff("SECOND", start, end) / F.lit(86400.0), F.lit(0.0))


def month_of(column: Column) -> Column:
    return F.trunc(column.cast("date"), "MM")


def only(condition: Column, value: Column) -> Column:
    return F.when(condition, value)
