"""Operations that arrive as a stream: applied batch by batch, with analytics on each published snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.log import graph_at


def read_operations(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of ``(seq, op, src, dst, weight)`` from Parquet files as they come."""
    return spark.readStream.schema("seq long, op string, src long, dst long, weight double").option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(ops: DataFrame, log_path: str, checkpoint: str, analyse: Callable | None = None) -> StreamingQuery:
    """Append each batch to the log as the epoch of its number, so that epochs publish in order and a batch that is
    tried again replaces itself; then call ``analyse(graph, epoch)`` on the snapshot that ends with it."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/epoch={epoch}")
        if analyse:
            log = batch.sparkSession.read.schema(batch.schema).parquet(log_path)
            analyse(graph_at(log), epoch)

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_edges(ops: DataFrame) -> DataFrame:
    """``(lo, hi, op, weight, seq)``: the last operation of each pair, as state by edge that every batch of a stream
    updates (output mode ``update`` or ``complete``); works on tables too. An edge is live where op is U."""
    ends = ops.where("src <> dst").withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    last = ends.groupBy("lo", "hi").agg(F.max_by(F.struct("op", "weight"), "seq").alias("x"), F.max("seq").alias("seq"))
    return last.select("lo", "hi", "x.op", "x.weight", "seq")


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their summed value by window and type; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
