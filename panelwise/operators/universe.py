"""Universes and reference data: small tables (name, ticker, added_date) and (ticker, name, sector, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def members(universe: DataFrame, name: str, as_of: str | None = None) -> DataFrame:
    """Tickers of a universe; with a date only those already added, undated ones always."""
    u = universe.filter(F.lower("name") == name.lower())
    if as_of is not None:
        u = u.filter(F.col("added_date").isNull() | (F.col("added_date") <= F.lit(as_of).cast("date")))
    return u.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()


def members_at(universe: DataFrame, marks: DataFrame) -> DataFrame:
    """Point-in-time membership for many dates: (ticker, as_of) marks that are in the universe then."""
    m = marks.join(universe.select("ticker", "added_date"), "ticker")
    return m.filter(F.col("added_date").isNull() | (F.col("added_date") <= F.col("as_of"))).drop("added_date")


def metadata(universe: DataFrame) -> DataFrame:
    graduated = F.bool_or(F.col("added_date").isNotNull())
    return universe.groupBy("name").agg(
        F.count_distinct("ticker").alias("size"), F.when(graduated, "graduated").otherwise("static_list").alias("type")
    )


def eligible(
    tickers: DataFrame, instruments: DataFrame, as_of: str, min_history_days: int = 252, min_aum: float = 0.0
) -> DataFrame:
    """Known tickers old enough and large enough; a missing inception date or size passes."""
    at = F.lit(as_of).cast("date")
    old = F.col("inception_date").isNull() | (F.datediff(at, "inception_date") >= min_history_days)
    big = F.col("aum").isNull() | (F.col("aum") >= min_aum)
    return tickers.join(instruments.filter(old & big).select("ticker"), "ticker", "left_semi")


def instrument_master(bars: DataFrame) -> DataFrame:
    """First and last priced date per ticker and its traded value."""
    return bars.filter(F.col("close").isNotNull()).groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min("date").alias("inception_date"), F.sum(F.col("close") * F.col("volume")).alias("aum"),
    )


def sectors(reference: DataFrame) -> DataFrame:
    return reference.groupBy("sector").agg(F.count("*").alias("n_tickers"))


def tickers_by_sector(reference: DataFrame, sector: str) -> DataFrame:
    return reference.filter(F.col("sector") == sector).select("ticker")


def exchanges(raw: DataFrame) -> DataFrame:
    """Exchange rows with defaults for absent attributes."""
    have = set(raw.columns)

    def field(c: str, default):
        return F.coalesce(F.col(c), F.lit(default)).alias(c) if c in have else F.lit(default).alias(c)

    return raw.select(
        F.upper("exchange").alias("exchange"), F.coalesce("name", "exchange").alias("name"), field("trading_hours", "09:30-16:00"),
        field("timezone", "US/Eastern"), field("settlement_days", 2),
    )
