"""Calendar features (F1-F15, F20) as Column expressions of the local
timestamp. All are JVM built-ins and stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .nulls import flag

TWO_PI = 2 * math.pi


def ts() -> Column:
    return F.col(C.TIME)


def hour() -> Column:
    return F.hour(ts())


def dayofweek() -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``; ``dayofweek`` is Sunday = 1)."""
    return F.weekday(ts())


def month() -> Column:
    return F.month(ts())


def dayofyear() -> Column:
    return F.dayofyear(ts())


def quarter() -> Column:
    return F.quarter(ts())


def is_weekend() -> Column:
    return flag(dayofweek() >= 5)


def weekday_and(cond: Column) -> Column:
    return flag(cond & (dayofweek() < 5))


def cyclic(value: Column, period: float, fn=F.sin) -> Column:
    return fn(F.lit(TWO_PI) * value / F.lit(float(period)))


def time_of_day_minute() -> Column:
    return hour() * 60 + F.minute(ts())


def season() -> Column:
    """1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, 4 = Sep-Nov."""
    return F.floor((month() % 12 + 3) / 3).cast("int")


def occupancy_state(at: Column | None = None) -> Column:
    """First matching rule wins (the fifth state ``Unknown`` is unreachable
    for a non-null timestamp). ``at`` defaults to the row's timestamp."""
    at = ts() if at is None else at
    h, dow = F.hour(at), F.weekday(at)
    work = (h >= 8) & (h < 18) & (dow < 5)
    weekend = dow >= 5
    return (F.when(work, "Workday_Hours")
             .when(~weekend, "Workday_OffHours")
             .when(h.between(8, 18), "Weekend_Day")
             .otherwise("Weekend_Night"))


def is_work_hours() -> Column:
    h = hour()
    return weekday_and((h >= 8) & (h < 18))
