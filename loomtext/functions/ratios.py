"""Ratios that have a value where their denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def hit_rate(hits: Column, total: Column, other: Column) -> Column:
    """hits / total; without a total 1 if the other side is empty too, else 0."""
    return F.when(total > 0, hits / F.nullif(total, F.lit(0))).when(other == 0, 1.0).otherwise(0.0)


def accuracy(found: Column, expected: Column) -> Column:
    """1 less the relative error, at least 0; with nothing expected 1 if nothing was found."""
    return F.when(expected == 0, F.when(found == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(found - expected) / F.nullif(expected, F.lit(0))))
