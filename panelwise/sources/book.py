"""Book of portfolio states: a versioned table with positions, regime and drawdown level of every portfolio and date.

A state holds nav, peak_nav, maps from ticker to shares, weight and average cost, and the regime and drawdown level that the
monitors last saw. Writes only append: each goes to a version folder of its own, partitioned by year, and never touches
what others have written; a read takes the newest version of each (portfolio, as_of). A job that dies leaves no half version
that is read, as Spark marks a finished one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from panelwise.functions.exprs import ratio

KEYS = ["portfolio", "as_of"]
_POSITIONS = MapType(StringType(), DoubleType())
SCHEMA = StructType([
    StructField("portfolio", StringType()), StructField("as_of", DateType()), StructField("nav", DoubleType()),
    StructField("peak_nav", DoubleType()), StructField("holdings", _POSITIONS), StructField("weights", _POSITIONS),
    StructField("cost_basis", _POSITIONS), StructField("regime", StringType()), StructField("drawdown_level", StringType()),
])
STORED = StructType([*SCHEMA.fields, StructField("version", LongType()), StructField("year", IntegerType())])
MAPS = ("holdings", "weights", "cost_basis")


def _refused(bad: Column, why: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(why))).otherwise(value)


def checked(states: DataFrame) -> DataFrame:
    """States in the table's schema. Missing columns are null, missing maps empty; negative money or shares stop the job."""
    have = set(states.columns)
    if not {"portfolio", "as_of", "nav", "peak_nav"} <= have:
        raise ValueError("a state needs portfolio, as_of, nav and peak_nav")
    cols = {}
    for f in SCHEMA:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols[f.name] = F.coalesce(c, F.create_map().cast(f.dataType)) if f.name in MAPS else c
    for name in ("nav", "peak_nav"):
        cols[name] = _refused(cols[name].isNull() | (cols[name] < 0), f"{name} must not be null or negative", cols[name])
    for name in ("holdings", "cost_basis"):
        some = F.exists(F.map_values(cols[name]), lambda v: v < 0)
        cols[name] = _refused(some, f"{name} must not be negative", cols[name])
    return states.select(*[c.alias(n) for n, c in cols.items()])


def states(positions: DataFrame, curve: DataFrame) -> DataFrame:
    """One row per portfolio and date of positions (portfolio, as_of, ticker, shares, weight, cost) and curve (.., nav, peak_nav).

    Positions without shares, as cash, have a weight only.
    """
    def as_map(value: str) -> Column:
        rows = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("ticker", value)))
        return F.map_from_entries(F.array_sort(rows))

    held = positions.groupBy(*KEYS).agg(
        as_map("shares").alias("holdings"), as_map("weight").alias("weights"), as_map("cost").alias("cost_basis"))
    return curve.join(held, KEYS, "left")


def append(new: DataFrame, path: str, version: int) -> None:
    """Add a version. A version that exists is refused rather than replaced."""
    out = checked(new).withColumn("year", F.year("as_of"))
    out.write.mode("errorifexists").partitionBy("year").parquet(f"{path}/version={version}")


def read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The newest version of each state, of the dates asked for; years outside are not read."""
    df = spark.read.schema(STORED).parquet(path)
    for bound, at in (("first", first), ("last", last)):
        if at is not None:
            d = F.lit(at).cast("date")
            year, day = (F.col("year") >= F.year(d), F.col("as_of") >= d) if bound == "first" else (F.col("year") <= F.year(d), F.col("as_of") <= d)
            df = df.filter(year & day)
    values = [f.name for f in SCHEMA if f.name not in KEYS]
    newest = df.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "version").alias("s"))
    return newest.select(*KEYS, "s.*")


def latest(book: DataFrame) -> DataFrame:
    """The last state of each portfolio."""
    values = [c for c in book.columns if c != "portfolio"]
    return book.groupBy("portfolio").agg(F.max_by(F.struct(*values), "as_of").alias("s")).select("portfolio", "s.*")


def at(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The state of each portfolio as of a day: the last one on or before it."""
    return latest(read(spark, path, last=day))


def drawdown(book: DataFrame) -> DataFrame:
    dd = F.when(F.col("peak_nav") > 0, F.greatest(F.lit(0.0), (F.col("peak_nav") - F.col("nav")) / F.col("peak_nav"))).otherwise(0.0)
    return book.withColumn("drawdown", dd)


def positions(book: DataFrame) -> DataFrame:
    """(portfolio, as_of, ticker, weight, shares, cost_basis): a row for each ticker that has a weight or shares."""
    tickers = F.array_union(F.map_keys("weights"), F.map_keys("holdings"))
    rows = book.select(*KEYS, "holdings", "weights", "cost_basis", F.explode(tickers).alias("ticker"))
    return rows.select(*KEYS, "ticker", F.try_element_at("weights", F.col("ticker")).alias("weight"),
                       F.try_element_at("holdings", F.col("ticker")).alias("shares"),
                       F.try_element_at("cost_basis", F.col("ticker")).alias("cost_basis"))


def drift(book: DataFrame, targets: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Stored weights against targets (portfolio, ticker, weight): differences of at least the threshold."""
    zero = F.lit(0.0)
    current = positions(book).select("portfolio", "ticker", F.coalesce("weight", zero).alias("current_weight"), zero.alias("target_weight"))
    target = targets.select("portfolio", "ticker", zero.alias("current_weight"), F.coalesce("weight", zero).alias("target_weight"))
    both = current.unionByName(target).groupBy("portfolio", "ticker").agg(
        F.sum("current_weight").alias("current_weight"), F.sum("target_weight").alias("target_weight"))
    d = F.col("target_weight") - F.col("current_weight")
    return both.withColumns({"drift": d, "abs_drift": F.abs(d)}).filter(F.col("abs_drift") >= threshold)


def unrealized(book: DataFrame, prices: DataFrame) -> DataFrame:
    """(portfolio, as_of, cost, value, gain) of the shares held, at prices (as_of, ticker, price). Unpriced shares stay at cost."""
    p = positions(book).filter(F.col("shares").isNotNull()).join(prices.select("as_of", "ticker", "price"), ["as_of", "ticker"], "left")
    cost, value = F.sum(F.col("shares") * F.col("cost_basis")), F.sum(F.col("shares") * F.coalesce("price", "cost_basis"))
    return p.groupBy(*KEYS).agg(cost.alias("cost"), value.alias("value")).withColumn("gain", ratio(F.col("value") - F.col("cost"), "cost"))


def to_json(book: DataFrame) -> DataFrame:
    """(portfolio, as_of, state): each state as one JSON text, dates in ISO form, nulls kept."""
    fields = F.struct(*[f.name for f in SCHEMA])
    return book.select(*KEYS, F.to_json(fields, {"ignoreNullFields": "false"}).alias("state"))


def from_json(texts: DataFrame, column: str = "state") -> DataFrame:
    """States out of JSON texts. Text that is no object and keys outside the schema stop the job instead of being dropped."""
    known = F.array(*[F.lit(f.name) for f in SCHEMA])
    keys = F.json_object_keys(column)
    extra = F.array_except(keys, known)
    raw = F.when(keys.isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.coalesce(F.left(column, F.lit(80)), F.lit("null"))))).when(
        F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.concat_ws(", ", extra)))).otherwise(F.col(column))
    return checked(texts.select(F.from_json(raw, SCHEMA, {"mode": "FAILFAST"}).alias("s")).select("s.*"))
