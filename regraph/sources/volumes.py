"""Volumes as Parquet voxel tables, label maps, and the binary block format."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labels(spark: SparkSession, path: str, transforms: DataFrame | None = None) -> DataFrame:
    """voxels(x, y, z, label), with labels sent through transforms(old, new) if given."""
    v = spark.read.parquet(path)
    missing = {"x", "y", "z", "label"} - set(v.columns)
    if missing:
        raise ValueError(f"not a 3-D label volume: {sorted(missing)} missing")
    if transforms is None:
        return v
    from ..operators.graph import relabelled

    return relabelled(v, transforms, "label")


def channels(voxels: DataFrame, column: str = "preds") -> DataFrame:
    """(x, y, z, channel, value): one row a voxel and channel of an array column."""
    return voxels.select("x", "y", "z", F.posexplode(column).alias("channel", "value"))


def write_volume(voxels: DataFrame, path: str, block: int = 64) -> None:
    """Partitioned by z block, sorted in scan order."""
    voxels.withColumn("zb", F.expr(f"z div {block}")).repartition("zb").sortWithinPartitions("z", "y", "x").write.mode("overwrite").partitionBy("zb").parquet(path)


def from_array(spark: SparkSession, labels: np.ndarray, preds: np.ndarray | None = None) -> DataFrame:
    """voxels of a (z, y, x) label array and an optional (z, y, x, channel) float array held by the caller."""
    if labels.ndim != 3 or labels.dtype.kind not in "ui":
        raise ValueError("labels must be a 3-D integer array")
    z, y, x = (a.ravel().astype(np.int32) for a in np.indices(labels.shape))
    columns = {"x": x, "y": y, "z": z, "label": labels.ravel().astype(np.int64)}
    if preds is not None:
        if preds.shape[:3] != labels.shape or preds.ndim != 4:
            raise ValueError("predictions must be (z, y, x, channel) of the labels' shape")
        columns["preds"] = pa.FixedSizeListArray.from_arrays(pa.array(preds.astype(np.float32).ravel()), preds.shape[3]).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table(columns))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """voxels of binary block files: three unsigned 64-bit sizes x, y, z, then labels with x fastest."""

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                nx, ny, nz = (int(v) for v in np.frombuffer(content, "<u8", 3))
                labels = np.frombuffer(content, "<u8", nx * ny * nz, 24)
                plane = nx * ny
                for k in range(nz):
                    at = np.arange(plane)
                    yield pa.RecordBatch.from_pydict({"block": [name] * plane, "x": (at % nx).astype(np.int32), "y": (at // nx).astype(np.int32), "z": np.full(plane, k, np.int32), "label": labels[k * plane : (k + 1) * plane].astype(np.int64)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "block string, x int, y int, z int, label long")


def rebased(voxels: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """The lazy label map applied once."""
    from ..operators.graph import relabelled

    return relabelled(voxels, mapping, label)
