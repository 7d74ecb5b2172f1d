"""Byte layouts of feature states: count i64; moments u64 n, u32 order, sums f64; histogram u64 n, u32 bins, u64 counts.

States stay native columns inside Spark; these pack them for exchange, in Arrow batches.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.BinaryType())
def pack_count(n: pd.Series) -> pd.Series:
    return n.map(lambda v: struct.pack("<q", int(v)))


@pandas_udf(T.LongType())
def unpack_count(data: pd.Series) -> pd.Series:
    return data.map(lambda b: struct.unpack_from("<q", b)[0])


@pandas_udf(T.BinaryType())
def pack_moments(n: pd.Series, sums: pd.Series) -> pd.Series:
    return pd.Series([struct.pack(f"<QI{len(s)}d", int(c), len(s), *s) for c, s in zip(n, sums)])


@pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]))
def unpack_moments(data: pd.Series) -> pd.DataFrame:
    rows = []
    for b in data:
        n, k = struct.unpack_from("<QI", b)
        rows.append((n, list(struct.unpack_from(f"<{k}d", b, 12))))
    return pd.DataFrame(rows, columns=["n", "sums"])


@pandas_udf(T.BinaryType())
def pack_histogram(n: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([struct.pack(f"<QI{len(s)}Q", int(c), len(s), *map(int, s)) for c, s in zip(n, counts)])


@pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType()))]))
def unpack_histogram(data: pd.Series) -> pd.DataFrame:
    rows = []
    for b in data:
        n, k = struct.unpack_from("<QI", b)
        rows.append((n, list(struct.unpack_from(f"<{k}Q", b, 12))))
    return pd.DataFrame(rows, columns=["n", "counts"])


def hexadecimal(data):
    return F.hex(data)


def from_hexadecimal(text):
    return F.unhex(text)
