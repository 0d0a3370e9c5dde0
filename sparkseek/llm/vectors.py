"""Cleaning and blocks of vectors, shared by the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero, not empty."""
    # exists() is null where a component is null and none is outright bad
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def dots(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products of each row with one vector, the same for equal rows wherever they stand."""
    return (rows * one).sum(axis=1)


def kept_type(vectors: DataFrame, column: str) -> Column:
    """A vector column as it is moved: floats stay floats (a double holds each exactly), anything else becomes doubles."""
    kind = vectors.schema[column].dataType
    return F.col(column) if kind.simpleString() == "array<float>" else F.col(column).cast("array<double>")


def sample_of(rows: DataFrame, n: int, *columns: str) -> list:
    """n rows at most, the first by hash of vec_id: a bounded sample for fitting."""
    return bounded(rows.select("vec_id", *(c for c in columns if c != "vec_id")), n, "vec_id").collect()


def length_of(rows: DataFrame) -> int | None:
    """The length that most vectors `v` have, of equals the longest; None without rows."""
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most and most.d
