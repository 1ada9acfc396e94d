"""Price panel, macro series and dimensions, in long form.

``load_snapshot`` reads a stored panel (long or wide). The ``*_from_orders`` functions derive the
same shapes from the star-schema tables, so that every registered query works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwise.functions.exprs import nan_to_null, ratio

FIELDS = ["open", "high", "low", "close", "volume"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Stored long panel with NaN turned into NULL; fails early when a field is missing."""
    df = spark.read.parquet(path)
    missing = {"date", "ticker", *FIELDS} - set(df.columns)
    if missing:
        raise ValueError(f"snapshot lacks columns {sorted(missing)}")
    return df.withColumns({f: nan_to_null(F.col(f).cast("double")) for f in FIELDS})


def read_snapshot(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bars of a version that ``ingest.write_snapshot`` wrote, from first to last day. Years outside are never listed or read.

    Files of a year hold disjoint ticker ranges, so a filter on ticker skips files by their statistics as well.
    """
    df = load_snapshot(spark, path)
    if "year" not in df.columns:
        raise ValueError("not partitioned by year")
    for at, after in ((first, True), (last, False)):
        if at is not None:
            d = F.lit(at).cast("date")
            df = df.filter((F.col("year") >= F.year(d)) & (F.col("date") >= d) if after else (F.col("year") <= F.year(d)) & (F.col("date") <= d))
    return df.drop("year")


MACRO_SCHEMA = "date date, value double"


def write_macro(macro: DataFrame, path: str) -> None:
    """A folder for each indicator, named after it; the files hold (date, value) only, sorted by date."""
    macro.select("indicator", "date", "value").repartition("indicator").sortWithinPartitions("indicator", "date").write.mode(
        "errorifexists").partitionBy("indicator").parquet(path)


def read_macro(spark: SparkSession, path: str, indicators: list[str] | None = None) -> DataFrame:
    """(indicator, date, value) of the stored series asked for; the indicator is read off each file's own path.

    Only the folders of the indicators asked for are opened; one that isn't stored is an error.
    """
    where = [f"{path}/indicator={i}" for i in indicators] if indicators is not None else [f"{path}/indicator=*"]
    df = spark.read.schema(MACRO_SCHEMA).parquet(*where)
    name = F.regexp_extract("_metadata.file_path", r"indicator=([^/]+)/", 1)
    return df.select(name.alias("indicator"), "date", nan_to_null(F.col("value")).alias("value"))


def wide_to_long(wide: DataFrame, sep: str = "|") -> DataFrame:
    """Columns ``<ticker>|<Field>`` plus ``date`` -> bars.

    One ``stack``-like explode per row, no shuffle: the five fields of a ticker stay together as a struct.
    """
    tickers: dict[str, list[str]] = {}
    for name in wide.columns:
        if sep in name:
            t, f = name.rsplit(sep, 1)
            tickers.setdefault(t, []).append(f.lower())
    cells = [
        F.struct(
            F.lit(t).alias("ticker"),
            *[
                (nan_to_null(F.col(f"`{t}{sep}{f.capitalize()}`").cast("double")) if f in have
                 else F.lit(None).cast("double")).alias(f)
                for f in FIELDS
            ],
        )
        for t, have in sorted(tickers.items())
    ]
    long = wide.select(F.col("date").cast("date").alias("date"), F.inline(F.array(*cells)))
    return long.filter(F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull())


def bars_from_orders(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars by brand: unit price = extendedprice / quantity, Monday to Friday.

    ``part`` is joined without a hint: the optimizer broadcasts it while it is small and shuffles on
    the part key once it is not. The (ticker, date) aggregate is partial before its shuffle, so a brand
    holding a large share of the rows costs one buffer per day and task, not a hot partition.
    """
    li = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.col("l_shipdate").cast("date").alias("date"),
    ).filter(F.weekday("date") < 5)
    part = table(spark, root, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    unit = li.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "u", ratio("l_extendedprice", "l_quantity")
    )
    return unit.groupBy("ticker", "date").agg(
        F.min_by("u", F.struct("l_orderkey", "l_linenumber", "u")).alias("open"),
        F.max("u").alias("high"),
        F.min("u").alias("low"),
        F.avg("u").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def closes_from_orders(spark: SparkSession, root: str) -> DataFrame:
    """Close-only read; the scan and the aggregate carry just what the close needs."""
    return bars_from_orders(spark, root).select("date", "ticker", "close")


def members_from_orders(spark: SparkSession, root: str) -> DataFrame:
    """Every ticker of the panel, from the dimension rather than from a pass over the bars."""
    return table(spark, root, "part").select(F.col("p_brand").alias("ticker")).distinct()


def reference_from_orders(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, name, sector, exchange, currency); sector = most frequent part type, ties alphabetical."""
    by_type = table(spark, root, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    # The pair with the largest count and, among equals, the smallest type name.
    best = by_type.groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("n"), F.col("p_type"))).alias("sector"))
    return best.select(
        F.upper("p_brand").alias("ticker"),
        F.col("p_brand").alias("name"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.lit("Unknown").alias("exchange"),
        F.lit("USD").alias("currency"),
    )


# Macro series ids of the data model and the order priority each is derived from.
MACRO_FROM_PRIORITY = {
    "DGS10": "1-URGENT",
    "DGS2": "2-HIGH",
    "FED_FUNDS": "3-MEDIUM",
    "HY_SPREAD": "4-NOT SPECIFIED",
    "IG_SPREAD": "5-LOW",
}


def macro_from_orders(spark: SparkSession, root: str, vix_level: float = 25.0) -> DataFrame:
    """Long macro table (indicator, date, value), one partial aggregate over orders and an explode.

    The volatility proxy is a day's orders over the mean of all days, at ``vix_level`` on an average day, so it doesn't grow
    with the number of orders. The mean runs over one row for each day.
    """
    o = table(spark, root, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    daily = o.groupBy("date").agg(
        F.count("*").alias("n"),
        (F.avg("o_totalprice") / 250000.0 - 1.0).alias("T10Y2Y"),
        *[
            (F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))) / 100000.0).alias(k)
            for k, p in MACRO_FROM_PRIORITY.items()
        ],
        (F.max("o_totalprice") / 1000.0).alias("CPI"),
        (F.avg(F.when(F.col("o_orderstatus") == "F", 10.0).otherwise(0.0))).alias("UNRATE"),
    )
    share = F.col("n") / F.avg("n").over(Window.partitionBy(F.lit(0)))
    daily = daily.select("date", (share * F.lit(vix_level)).alias("VIX"), *[c for c in daily.columns if c not in ("date", "n")])
    names = [c for c in daily.columns if c != "date"]
    cells = F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).alias("value")) for n in names])
    return daily.select("date", F.inline(cells)).filter(F.col("value").isNotNull())
