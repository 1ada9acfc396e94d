"""Business-day arithmetic as plain expressions: no calendar table, no join.

Weekday counting starts at Monday 1970-01-05. ``bday_index(d)`` is the number of Monday-Friday
days before ``d``; a Saturday and a Sunday share the index of the Monday that follows.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.functions.exprs import C, _c

_MONDAY = dt.date(1970, 1, 5)


def day_index(d: C) -> Column:
    return F.datediff(_c(d), F.lit(_MONDAY))


def bday_index(d: C) -> Column:
    n = day_index(d)
    return (F.floor(n / F.lit(7)) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))).cast("int")


def bdays_spanned(start: C, end: C) -> Column:
    """Business days in [start, end] minus one, the age of ``start`` seen from ``end``."""
    return bday_index(F.date_add(_c(end), 1)) - bday_index(start) - F.lit(1)


def next_bday(d: C) -> Column:
    c = _c(d)
    step = F.when(F.weekday(c) == 4, 3).when(F.weekday(c) == 5, 2).otherwise(1)
    return F.date_add(c, step)


def is_month_end_bday(d: C) -> Column:
    """Last Monday-Friday day of its month."""
    end = F.last_day(_c(d))
    return _c(d) == F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def is_rebalance_day(d: C, schedule: str) -> Column:
    """Rebalance gate: daily, weekly (Friday), monthly (last business day of the month).

    ``month_end`` and ``quarter_end`` are the calendar variants used by passive benchmarks.
    """
    c = _c(d)
    if schedule == "daily":
        return F.weekday(c) < 5
    if schedule == "weekly":
        return F.weekday(c) == 4
    if schedule == "monthly":
        return is_month_end_bday(c)
    if schedule == "month_end":
        return c == F.last_day(c)
    if schedule == "quarter_end":
        return (c == F.last_day(c)) & (F.month(c) % 3 == 0)
    raise ValueError(f"Unknown schedule: {schedule}")


# Rebalance-day tests as lambda text over ``d``; the same rules as ``is_rebalance_day``.
_RULES = {
    "daily": "weekday(d) < 5",
    "weekly": "weekday(d) = 4",
    "monthly": "d = date_sub(last_day(d), greatest(weekday(last_day(d)) - 4, 0))",
    "month_end": "d = last_day(d)",
    "quarter_end": "d = last_day(d) and month(d) % 3 = 0",
}


def schedule_days(start: str, end: str, schedule: str) -> Column:
    """array<date> of the rebalance days in [start, end]; a constant, folded by the optimizer."""
    if schedule not in _RULES:
        raise ValueError(f"Unknown schedule: {schedule}")
    return F.expr(f"filter(sequence(date'{start}', date'{end}'), d -> {_RULES[schedule]})")


def every_n_bdays(start: str, end: str, n: int) -> Column:
    days = f"filter(sequence(date'{start}', date'{end}'), d -> weekday(d) < 5)"
    return F.expr(f"filter({days}, (d, i) -> i % {int(n)} = 0)")


def union_days(schedules: dict[str, Column]) -> Column:
    """The days of all schedules, each once."""
    return F.array_distinct(F.concat(*schedules.values()))


def schedule_tables(spark: SparkSession, schedules: dict[str, Column]) -> DataFrame:
    """(schedule, seq, as_of, prev_as_of, next_as_of) of several schedules; bounded by their calendars."""
    return reduce(DataFrame.unionByName, [
        schedule_table(spark, days).withColumn("schedule", F.lit(name)) for name, days in schedules.items()])


def schedule_table(spark: SparkSession, days: Column) -> DataFrame:
    """(seq, as_of, prev_as_of, next_as_of); one row per rebalance day, so bounded by the calendar."""
    one = spark.range(1).select(days.alias("days"))
    return one.select(F.posexplode("days").alias("seq", "as_of"), "days").select(
        "seq",
        "as_of",
        F.get("days", F.col("seq") - 1).alias("prev_as_of"),
        F.get("days", F.col("seq") + 1).alias("next_as_of"),
    )
