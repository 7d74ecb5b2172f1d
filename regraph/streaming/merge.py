"""Incremental block-wise graph building: partial states merge by addition, in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EDGE_STATE = "node1 long, node2 long, edge_size long, p_s1 double, p_s2 double"


def merged_stream(spark: SparkSession, folder: str, schema: str = EDGE_STATE, keys: tuple[str, ...] = ("node1", "node2")) -> DataFrame:
    """Running totals of the block states that arrive as Parquet files in folder.

    Addition does not mind order, so late blocks need no watermark; the state is one row a key.
    """
    blocks = spark.readStream.schema(schema).parquet(folder)
    return blocks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in blocks.columns if c not in keys])


def write_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each trigger replaces the table at path with the totals so far; a repeated batch writes the same rows."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return totals.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by window and user; for a stream, rows later than `late` behind the newest are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "user_id", "n", "total")
