"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def classes(rows: DataFrame, *by: str, extra: list[Column] = ()) -> DataFrame:
    """Equal vectors (and equal `by`) as one row: k1, k2, rep (smallest vec_id), copies, vector, by."""
    return rows.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), *[F.first(b).alias(b) for b in by], *extra
    )


def keyed(vectors: DataFrame, *by: str) -> DataFrame:
    """vec_id, vector, by, and two 64-bit hashes of vector and by, equal for equal ones."""
    v = F.col("embedding")
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), *by,
        F.xxhash64(v, *by).alias("k1"), F.xxhash64(F.lit(31), *by, F.size(v), v).alias("k2"),
    )
