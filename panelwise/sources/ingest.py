"""Ingestion: normalising raw bars, upserts, instrument lists, snapshots."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.exprs import C, _c
from panelwise.functions.joins import bounded
from panelwise.sources.panel import FIELDS

# Texts that stand for a missing entry.
MISSING = ("NAN", "NONE", "")


def clean_ticker(c: C) -> Column:
    t = F.upper(F.regexp_replace(F.trim(_c(c).cast("string")), r"\s+", ""))
    return F.when(~t.isin(*MISSING), t)


def clean_ticker_list(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct cleaned tickers in order of first appearance; a partial aggregate, not a window."""
    t = F.upper(F.trim(F.col(column).cast("string")))
    kept = df.select(F.when(~t.isin(*MISSING), t).alias("ticker"), position).filter(F.col("ticker").isNotNull())
    return kept.groupBy("ticker").agg(F.min(position).alias(position))


def parse_percent(c: C) -> Column:
    """'0.09%', '1,234' -> number; blanks and text -> NULL."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), ",", "")
    return F.trim(F.regexp_replace(s, "%$", "")).try_cast("double")


def blank_to_null(c: C) -> Column:
    return F.when(~_c(c).isin("nan", "None", ""), _c(c))


# Issuer family, marks found in the provider, and the start of the name (or None). Order decides.
ISSUERS: tuple[tuple[str, tuple[str, ...], str | None], ...] = (
    ("iShares", ("ishares",), "ishares "),
    ("Vanguard", ("vanguard",), "vanguard "),
    ("SPDR", ("state street", "spdr"), "spdr "),
    ("Invesco", ("invesco", "powershares"), None),
    ("Schwab", ("schwab",), None),
    ("Fidelity", ("fidelity",), None),
    ("WisdomTree", ("wisdomtree",), None),
    ("ProShares", ("proshares",), None),
    ("VanEck", ("van eck", "vaneck"), None),
    ("Global X", ("global x",), None),
)


def issuer_family(provider: C, name: C) -> Column:
    """First matching rule, else the provider itself, else NULL."""
    p, n = (F.lower(F.trim(F.coalesce(_c(x), F.lit("")))) for x in (provider, name))
    out: Column | None = None
    for family, marks, start in ISSUERS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(p, F.lit(m))
        if start:
            hit = hit | F.startswith(n, F.lit(start))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    own = F.trim(_c(provider))
    return out.otherwise(F.when(own != "", own))


def normalize_bars(raw: DataFrame, order: Sequence[str], key: Sequence[str] = ("ticker",)) -> DataFrame:
    """Raw text columns (any case) -> typed bars; undated rows drop, the last row per (ticker, date) by ``order`` wins.

    The winner is a partial aggregate of (order, row), so a key repeated without bound costs one buffer per task.
    """
    low = {c.lower(): c for c in raw.columns}
    lacking = [c for c in ("date", *FIELDS) if c not in low]
    if lacking:
        raise ValueError(f"missing columns {lacking}")

    def number(c: str) -> Column:
        return F.regexp_replace(F.col(low[c]).cast("string"), ",", "").try_cast("double").alias(c)

    typed = raw.select(*key, F.col(low["date"]).try_cast("date").alias("date"), *[number(f) for f in FIELDS], *order)
    return last_write_wins(typed.filter(F.col("date").isNotNull()), [*key, "date"], order).select(*key, "date", *FIELDS)


def last_write_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest version of each key. ``order`` must decide between versions; ties fall to the larger row."""
    values = [c for c in rows.columns if c not in {*keys, *order}]
    best = F.max(F.struct(*order, *values)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[f"_b.{c}" for c in (*order, *values)])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows with the new ones laid over them."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return last_write_wins(both, keys, ["_v"]).drop("_v")


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming bars later than the last stored date of their ticker."""
    last = existing.groupBy("ticker").agg(F.max("date").alias("_last"))
    j = incoming.join(last, "ticker", "left")
    return j.filter(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last")


LIST_FIELDS = [
    "name", "provider", "inception_date", "expense_ratio_pct", "asset_class", "sub_asset_class", "region", "market", "location",
    "investment_style", "category", "structure", "isin", "cusip",
]


def header(name: str) -> str:
    """Lower-case column name of letters, digits and underscores; anything else between them is one underscore."""
    return "_".join(re.findall("[a-z0-9_]+", name.lower())).strip("_")


def with_plain_headers(df: DataFrame) -> DataFrame:
    """Columns renamed by ``header``. Of equal names the first stays, later ones and nameless ones get their position as a suffix."""
    names: list[str] = []
    for i, c in enumerate(df.columns, 1):
        name = header(c)
        names.append(name if name and name not in names else f"{name or 'column'}_{i}")
    return df.toDF(*names)


def harmonize(primary: DataFrame, secondary: DataFrame, order: str = "position") -> DataFrame:
    """Merge two instrument lists by cleaned ticker. The secondary list wins field by field where it has a value.

    Headers are those of the files and are made plain first. Both lists need ``ticker``; absent fields are NULL. The first row of a ticker by ``order`` is kept per list.
    One grouped pass over the union stands for the full outer join.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        have = set(df.columns)
        vals = []
        for f in LIST_FIELDS:
            v = F.col(f).cast("string") if f in have else F.lit(None).cast("string")
            vals.append((parse_percent(v) if f == "expense_ratio_pct" else blank_to_null(v)).alias(f))
        s = df.select(clean_ticker("ticker").alias("ticker"), F.struct(F.col(order), *vals).alias("row"))
        first = s.filter(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.min_by("row", F.col(f"row.{order}")).alias(tag))
        return first

    p = side(with_plain_headers(primary), "a").withColumn("b", F.lit(None))
    s = side(with_plain_headers(secondary), "b")
    p = p.withColumn("b", F.lit(None).cast(s.schema["b"].dataType))
    both = p.unionByName(s.withColumn("a", F.lit(None).cast(p.schema["a"].dataType)))
    m = both.groupBy("ticker").agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    out = m.select("ticker", "a", "b", *[F.coalesce(F.col("b")[f], F.col("a")[f]).alias(f) for f in LIST_FIELDS])
    source = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("b").isNotNull(), "secondary").otherwise("primary")
    return out.withColumns({"issuer_family": issuer_family("provider", "name"), "source": source}).drop("a", "b")


def manifest(bars: DataFrame, name: str, universe: str, validation: DataFrame) -> DataFrame:
    """One-row summary of a snapshot: counts, date range, fields and validation totals."""
    data = bars.agg(
        F.count("*").alias("num_rows"), F.count_distinct("ticker").alias("num_tickers"), F.count_distinct("date").alias("num_dates"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
    )
    v = validation.agg(
        F.count("*").alias("total_tickers"), F.count_if(F.col("status") == "OK").alias("valid_tickers"),
        F.count_if(F.col("status") != "OK").alias("failed_tickers"), F.sum("anomalies").alias("total_anomalies"),
    )
    return data.join(bounded(v, 1)).select(
        F.lit(name).alias("snapshot_name"), F.lit(universe).alias("universe"), "*", F.lit(",".join(FIELDS)).alias("price_fields")
    )


def write_snapshot(bars: DataFrame, root: str, version: str) -> str:
    """Immutable version folder, partitioned by year.

    Rows are ranged by (year, ticker), so a year is spread over as many tasks as its size asks for, and the files
    of a year hold disjoint ticker ranges, which Parquet statistics can skip.
    """
    path = f"{root}/version={version}"
    out = bars.withColumn("year", F.year("date"))
    ranged = out.repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "date")
    ranged.write.mode("errorifexists").partitionBy("year").parquet(path)
    return path
