"""Signals, costs and checks that a user brings: registered callables whose results are held to a schema.

A callable maps DataFrames to a DataFrame, so it stays inside the optimizer. Where built-in expressions cannot state a
signal, ``per_window`` runs a pandas function over each ticker's windows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

# What a registered callable of each kind takes, and the columns its result must have.
KINDS = {
    "signal": {"as_of": "date", "ticker": "string", "score": "double"},
    "cost": {"strategy_id": "string", "as_of": "date", "cost": "double"},
    "check": {"ticker": "string", "date": "date", "issue": "string"},
}
_FOUND: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def register(kind: str, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Decorator. A signal takes (bars, marks), a cost the paired weights, a check the bars; keyword parameters may follow."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}, one of {sorted(KINDS)}")

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _FOUND.get((kind, name), fn) is not fn:
            raise ValueError(f"{kind} {name} is taken")
        _FOUND[kind, name] = fn
        return fn

    return keep


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _FOUND if k == kind)


def checked(df: DataFrame, columns: dict[str, str], label: str) -> DataFrame:
    """The required columns, first those that are missing or of another type named in an error. Runs no job."""
    have = dict(df.dtypes)
    bad = [f"{c} {t}, found {have.get(c, 'none')}" for c, t in columns.items() if have.get(c) != t]
    if bad:
        raise TypeError(f"{label}: needs {'; '.join(bad)}")
    return df.select(*columns)


def apply(kind: str, name: str, *inputs: DataFrame, **params: Any) -> DataFrame:
    """Result of a registered callable, checked and cut to the columns of its kind."""
    if (kind, name) not in _FOUND:
        raise KeyError(f"no {kind} {name}; registered: {names(kind)}")
    return checked(_FOUND[kind, name](*inputs, **params), KINDS[kind], f"{kind} {name}")


def per_window(rows: DataFrame, marks: DataFrame, days: int, fn: Callable[[pd.DataFrame], float | None]) -> DataFrame:
    """(as_of, ticker, score): ``fn`` on each ticker's rows dated in [as_of - days, as_of), oldest first.

    Rows and marks of a ticker meet in one task, which the calendar bounds. A mark without rows, and a result that is
    None or NaN, give a NULL score.
    """
    def run(bars: pd.DataFrame, dates: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date", kind="stable")
        at, days_of = pd.to_datetime(dates["as_of"]), pd.to_datetime(bars["date"]).to_numpy()
        lo = days_of.searchsorted((at - pd.Timedelta(days=days)).to_numpy(), side="left")
        hi = days_of.searchsorted(at.to_numpy(), side="left")
        scores = [fn(bars.iloc[a:b]) if b > a else None for a, b in zip(lo, hi)]
        scores = pd.Series(pd.to_numeric(pd.Series(scores, dtype="object")), dtype="Float64")
        return pd.DataFrame({"as_of": dates["as_of"].to_numpy(), "ticker": dates["ticker"].to_numpy(), "score": scores.where(scores.notna(), None).to_numpy()})

    return rows.groupBy("ticker").cogroup(marks.select("ticker", "as_of").groupBy("ticker")).applyInPandas(run, "as_of date, ticker string, score double")
