"""Written intermediate tables: where iterations cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session, whose driver is its one executor."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.gettempdir() + "/checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_before(rows: DataFrame, value: str, *order: Column) -> DataFrame:
    """rows with before: the sum of value over all rows ahead in the order, 0 for the first; null values add nothing.

    Rows are dealt by ranges of the order and each range is summed in its own task; only the ranges'
    sums, one row each, meet in one.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_in", inside).join(kept(sums.select("_range", ahead.alias("_ahead"))), "_range")
    return out.withColumn("before", F.coalesce("_ahead", F.lit(0)) + F.coalesce("_in", F.lit(0))).drop("_range", "_in", "_ahead")
