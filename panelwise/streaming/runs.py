"""Bounded runs of the streaming monitors: everything that has arrived, then stop. Used for replays and checks."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.sources.storage import remove, shared_folder
from panelwise.streaming import ingest, monitors

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FLUSH = "~flush"
# First day and the day behind the last; None leaves that end open.
Span = tuple[str | None, str | None]


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _land(df: DataFrame, path: str, key: str, parts: list[Span]) -> Iterator[None]:
    """Each arrival (a date range; None is open) in a folder of its own, then a marker row that moves the watermark to the end."""
    for i, (lo, hi) in enumerate(parts):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col("date") >= lo)
        if hi is not None:
            inside = inside & (F.col("date") < hi)
        df.filter(inside).write.parquet(f"{path}/{i:04d}")
        yield
    last = F.lit(dt.date(2100, 1, 1))
    empty = [F.lit(FLUSH).alias(c) if c == key else last.alias(c) if c == "date" else F.lit(1.0).alias(c) for c in df.columns]
    df.sparkSession.range(1).select(*empty).write.parquet(f"{path}/{len(parts):04d}")
    yield


def _restore(spark: SparkSession, before: dict) -> None:
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drain(stream: DataFrame, target: str, checkpoint: str) -> None:
    q = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _replay(rows: DataFrame, key: str, parts: list[Span], build, schema) -> DataFrame:
    spark, root = rows.sparkSession, _folder(rows.sparkSession)
    # The number of state stores is fixed at a query's first start: one per core, as each costs a commit per batch.
    own = {PROVIDER: STATE_STORE, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in own}
    arrivals = _land(rows, f"{root}/in", key, parts)
    try:
        for _ in arrivals:  # a run takes one arrival, all of its files in one micro-batch
            for k, v in own.items():
                spark.conf.set(k, v)
            _drain(build(spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")), f"{root}/out", f"{root}/checkpoint")
            _restore(spark, before)
    finally:
        _restore(spark, before)
    for done in ("in", "checkpoint"):
        remove(spark, f"{root}/{done}")
    return spark.read.schema(schema).parquet(f"{root}/out").filter(F.col(key) != FLUSH)


def drawdown_replay(values: DataFrame, parts: list[Span]) -> DataFrame:
    """(portfolio, date, nav) through the alert stream, one micro-batch per arrival."""
    rows = values.select(F.col("portfolio").cast("string").alias("portfolio"), "date", F.col("nav").cast("double").alias("nav"))
    return _replay(rows, "portfolio", parts, monitors.drawdown_stream, monitors.ALERTS)


def label_replay(indicators: DataFrame, parts: list[Span]) -> DataFrame:
    """(date, price, ma, vix) of one series through the label stream."""
    ok = indicators.filter(F.col("ma").isNotNull() & F.col("vix").isNotNull())
    rows = ok.select(F.lit("benchmark").alias("series"), "date", "price", "ma", "vix")
    return _replay(rows, "series", parts, monitors.label_stream, monitors.LABELS)


def bar_replay(batches: list[DataFrame]) -> DataFrame:
    """Bars arriving in the given order; the stored table after the last one. Later arrivals win."""
    spark = batches[0].sparkSession
    root = _folder(spark)
    for i, b in enumerate(batches):
        rows = b.withColumn("arrival", F.lit(i))
        rows.write.parquet(f"{root}/in/{i:04d}")
        stream = ingest.bar_stream(spark, f"{root}/in/*", rows.schema, None)
        q = ingest.append_versions(stream, f"{root}/table", f"{root}/checkpoint", "arrival")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    for done in ("in", "checkpoint"):
        remove(spark, f"{root}/{done}")
    return ingest.current_bars(spark, f"{root}/table", "arrival")
