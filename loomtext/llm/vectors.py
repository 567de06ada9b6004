"""Vectors as whole numbers: what the operators on embeddings keep, and how tasks see it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond it could give squared distances that no 64-bit number holds.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """True for a vector that is there and whose components are all there and finite."""
    some = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & some, F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), x as double; an error for one beyond LARGEST, whose distances have no exact result."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    large = F.exists(scaled, lambda x: F.abs(x) > F.lit(float(LARGEST)))
    told = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<int>")
    return F.when(large, told).otherwise(F.transform(scaled, lambda x: F.floor(x).cast("int")))


def whole(rows: DataFrame, scale: int, keep: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, `more` and v, the kept vectors as whole numbers; other columns of the caller are not looked at."""
    return rows.where(keep).select("vec_id", *more, floors(F.col("embedding"), scale).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column whose rows all have `dims` numbers, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def floor_means(sums: list[int], n: int) -> list[int]:
    return [int(s) // n for s in sums]
