"""Broadcast joins with a stated bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# One row per calendar day: more than a century.
DAYS = 40_000
# One row per configured parameter set, regime, window or strategy name.
CONFIGS = 100_000
# Rows that are cheap to hold on every executor.
LIMIT = 2_000_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side that has at most ``rows`` rows by construction.

    Beyond the limit there is no hint: the optimizer then picks a shuffle join from the sizes it sees.
    """
    return F.broadcast(df) if rows <= LIMIT else df
