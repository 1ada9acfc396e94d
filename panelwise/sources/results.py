"""Log of optimizer runs: append-only tables keyed by run and version.

Each run writes ``all`` (every configuration, failed ones included), ``winners``, ``mapping`` and ``history``. A run may be
written again as a higher version; readers take the newest version of each run by partition discovery, so only its files are
opened, and several runs are read at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.functions.exprs import sig

TABLES = ("all", "winners", "mapping", "history")
OK, FAILED = "ok", "failed"


def outcomes(configs: DataFrame, evaluated: DataFrame, score: str = "composite_score") -> DataFrame:
    """Every configuration with its results; one without a result or score is failed and keeps nulls."""
    own = [c for c in evaluated.columns if c not in configs.columns or c == "strategy_id"]
    j = configs.join(evaluated.select(*own), "strategy_id", "left")
    return j.withColumn("status", F.when(F.col(score).isNull(), FAILED).otherwise(OK))


def winners(outcome: DataFrame, measure: str = "oos_active_return_mean") -> DataFrame:
    return outcome.filter((F.col("status") == OK) & (F.col(measure) > 0))


def summary(outcome: DataFrame) -> DataFrame:
    """One row: configurations, failed ones, winners, best score."""
    return outcome.agg(
        F.count("*").alias("n_configs"), F.count_if(F.col("status") == FAILED).alias("n_failed"),
        F.count_if((F.col("status") == OK) & (F.col("oos_active_return_mean") > 0)).alias("n_winners"),
        F.max("composite_score").alias("best_score"))


def best(outcome: DataFrame) -> DataFrame:
    """One row: the configuration of the best score, null if none has one.

    As in ``walkforward.rank``, scores equal in ten digits are ties and go to the smallest id: equivalent configurations differ
    in rounding noise only, which follows the order of sums.
    """
    order = F.when(F.col("composite_score").isNotNull(), F.struct(sig("composite_score", 10), -F.col("strategy_id")))
    return outcome.agg(F.max_by("config_name", order).alias("config_name"))


def append(frames: dict[str, DataFrame], path: str, run_id: str, version: int = 1) -> None:
    """Write the tables of a run. A version that is there already is refused."""
    unknown = set(frames) - set(TABLES)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}/run_id={run_id}/version={version}")


def read(spark: SparkSession, path: str, name: str, runs: list[str] | None = None) -> DataFrame:
    """Rows of the newest version of each run, with run_id and version."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    df = df.withColumns({"run_id": F.col("run_id").cast("string"), "version": F.col("version").cast("long")})
    if runs is not None:
        df = df.filter(F.col("run_id").isin(runs))
    # A few numbers a run, from the folders' names.
    newest = df.groupBy("run_id").agg(F.max("version").alias("version"))
    return df.join(newest, ["run_id", "version"], "left_semi")
