"""Streaming ingestion of bars: every micro-batch is laid over the stored days it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelwise.sources.ingest import last_write_wins


def bar_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = 1) -> DataFrame:
    """Bar files arriving in a folder; None takes all that have arrived into one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def append_versions(stream: DataFrame, table: str, checkpoint: str, order: str) -> StreamingQuery:
    """Append every arriving row as a version of its (ticker, date), partitioned by year and batch.

    Nothing stored is rewritten, so a late bar costs its own bytes. The batch id is part of the path and the batch
    folder is overwritten, so a batch replayed after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = last_write_wins(batch, ["ticker", "date"], [order])
        out = newest.withColumns({"year": F.year("date"), "batch_id": F.lit(batch_id)})
        # Replays overwrite just the (batch, year) folders they produce.
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "year").parquet(table)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_bars(spark: SparkSession, table: str, order: str, years: list[int] | None = None) -> DataFrame:
    """Newest version of each bar: later batches win, then the larger ``order``; years prune partitions."""
    df = spark.read.parquet(table)
    if years is not None:
        df = df.filter(F.col("year").isin(years))
    return last_write_wins(df.drop("year"), ["ticker", "date"], ["batch_id", order]).drop("batch_id")


def compact(spark: SparkSession, table: str, target: str, order: str) -> None:
    """Rewrite the versions as one, ranged by (year, ticker); run when a table has collected many batches."""
    out = current_bars(spark, table, order).withColumns({"year": F.year("date"), "batch_id": F.lit(-1)})
    out.repartitionByRange("year", "ticker").write.mode("errorifexists").partitionBy("batch_id", "year").parquet(target)
