"""Places in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.sources.staging import staged


def ranked(rows: DataFrame, order: list[Column], within: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """Adds the place of each row, from 1, in the given order within equal values of `within` (nulls together).

    Rows are dealt to tasks by ranges of the order, once and for good (a written table: ranges are drawn from samples); each task
    numbers its own rows, and what earlier ranges hold is added. Only the counts of ranges meet in one place. Rows that tie
    in the whole order get places in any order.
    """
    spread = staged(rows.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_of_{c}") for c in within], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    own = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    return spread.withColumn("_own", own).join(before, same).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*rows.columns, name)
