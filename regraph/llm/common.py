"""Helpers the training-data operators share: written tables and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it (fixed value).
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and driver and executors are one process (a local test session)
    is a temporary folder used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.gettempdir() + "/checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, partition_by: str | None = None, options: dict | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.mode("overwrite").options(**(options or {}))
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of an Arrow batch of about `limit` bytes of text each, so long texts stay few at a time.

    What Arrow's pool holds of a slice's words goes back after it: workers live on between tasks and stages.
    """
    pool = pa.default_memory_pool()
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
            pool.release_unused()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary): text i has the words vocabulary[codes[offsets[i]:offsets[i + 1]]].

    Words are maximal runs without ASCII white space; null counts as empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if empty >= 0:  # leading or trailing white space
        keep = codes != empty
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes = before[offsets], codes[keep]
    return offsets, codes.astype(np.int64), vocabulary


def word_hashes(vocabulary: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each word, the same on every worker."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocabulary))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixer, vectorised (public-domain constants, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
