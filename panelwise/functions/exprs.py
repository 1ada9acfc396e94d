"""Column helpers shared by every operator.

All of them are built-in expressions, so they stay inside whole-stage codegen.
They are safe under ANSI mode: a zero divisor yields NULL instead of an error.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: C, den: C) -> Column:
    """num / den, NULL when den is 0 or either side is NULL."""
    return F.try_divide(_c(num), _c(den))


def change(cur: C, prev: C) -> Column:
    """Simple return cur / prev - 1."""
    return ratio(cur, prev) - F.lit(1.0)


def nan_to_null(x: C) -> Column:
    """NaN is the missing marker of pandas-born files; Spark aggregates only skip NULL."""
    return F.when(~F.isnan(_c(x)), _c(x))


def clip(x: C, lo: float, hi: float) -> Column:
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(float(lo))), F.lit(float(hi))))


def sig(x: C, digits: int = 8) -> Column:
    """Round to significant digits; for values whose magnitude compounds without bound."""
    return F.format_string(f"%.{digits - 1}e", _c(x)).try_cast("double")


def num(x: C, digits: int = 6) -> Column:
    """Rounded on the scaled value, as databases do. ``F.round`` takes the printed digits instead, so that 0.98968749999999995,
    the double next to the tie 0.9896875, goes down there and up in SQL."""
    v, scale = _c(x).cast("double"), F.lit(10.0 ** digits)
    rounded = F.round(v * scale) / scale
    return F.when(F.abs(v * scale) < float("inf"), rounded).otherwise(v)


def literal(v) -> str:
    """SQL text of a constant."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"double('{v!r}')"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.date):
        return f"date'{v}'"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def struct_array(columns: list[str], rows: list[tuple]) -> str:
    """SQL text of a constant array of structs. One expression string instead of one call per cell."""
    cells = ", ".join(
        "struct(" + ", ".join(f"{literal(v)} as {c}" for c, v in zip(columns, r, strict=True)) + ")" for r in rows
    )
    return f"array({cells})"


def literal_rows(spark, columns: list[str], rows: list[tuple]):
    """Configuration rows as constants of the plan: no Python serialization and no job to read them."""
    return spark.range(1).select(F.expr(f"inline({struct_array(columns, rows)})"))
