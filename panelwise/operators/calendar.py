"""Next rebalance day as a closed expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelwise.functions.dates import next_bday
from panelwise.functions.exprs import C, _c


def _month_end_bday(d: Column) -> Column:
    end = F.last_day(d)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def next_rebalance(d: C, schedule: str) -> Column:
    """First rebalance day after ``d``. A weekend date first moves to Monday, which is itself excluded."""
    c = _c(d)
    base = F.when(F.weekday(c) >= 5, next_bday(c)).otherwise(c)
    if schedule == "daily":
        return next_bday(base)
    if schedule == "weekly":
        return F.next_day(base, "FRI")
    if schedule == "monthly":
        this = _month_end_bday(base)
        return F.when(base < this, this).otherwise(_month_end_bday(F.date_add(F.last_day(base), 1)))
    raise ValueError(f"Unknown schedule: {schedule}")
