"""State and result tables: portfolio state, strategy artifacts, feature store.

All are partitioned Parquet tables. Reads prune partitions; an upsert lays new versions over old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.sources.ingest import upsert


def save_state(states: DataFrame, new: DataFrame) -> DataFrame:
    """States with the rows of ``new`` replacing those of the same portfolio and date."""
    return upsert(states, new, ["portfolio", "as_of"])


def latest_state(states: DataFrame) -> DataFrame:
    cols = [c for c in states.columns if c != "portfolio"]
    s = states.groupBy("portfolio").agg(F.max_by(F.struct(*cols), "as_of").alias("s"))
    return s.select("portfolio", "s.*")


def state_at(states: DataFrame, as_of: str) -> DataFrame:
    return states.filter(F.col("as_of") == F.lit(as_of).cast("date"))


def state_history(states: DataFrame, as_of: str, lookback_days: int) -> DataFrame:
    """States of the ``lookback_days`` up to ``as_of``; the reference date is explicit, never the clock."""
    at = F.lit(as_of).cast("date")
    return states.filter((F.col("as_of") >= F.date_sub(at, lookback_days)) & (F.col("as_of") <= at))


def write_artifacts(frames: dict[str, DataFrame], path: str) -> None:
    """One folder per result table, partitioned by strategy."""
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy("strategy_id").parquet(f"{path}/{name}")


def read_artifacts(spark: SparkSession, path: str, name: str, strategies: list[str] | None = None) -> DataFrame:
    """Many runs at once: partition discovery over strategies, pruned to the wanted ones."""
    df = spark.read.parquet(f"{path}/{name}")
    return df if strategies is None else df.filter(F.col("strategy_id").isin(strategies))


def write_features(features: DataFrame, path: str, dataset: str, name: str) -> None:
    """Feature rows by date under dataset and feature-set name; a date is replaced as a whole."""
    out = features.withColumns({"dataset_id": F.lit(dataset), "name": F.lit(name)})
    # Dynamic overwrite is an option of this write, not of the session.
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "name", "as_of").parquet(path)


def read_features(spark: SparkSession, path: str, dataset: str, name: str, as_of: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter((F.col("dataset_id") == dataset) & (F.col("name") == name))
    df = df.withColumn("as_of", F.col("as_of").cast("date")).drop("dataset_id", "name")
    return df if as_of is None else df.filter(F.col("as_of") == F.lit(as_of).cast("date"))
