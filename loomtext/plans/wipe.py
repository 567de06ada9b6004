"""Removing what was extracted from a manuscript, and what that would remove. The raw layer stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import upsert

#: Tables of the extracted layers, with the review decisions.
EXTRACTED = ("character", "mention", "merge_candidate")


def preview(tables: dict[str, DataFrame], manuscript_id: str) -> DataFrame:
    """table_name and rows of the manuscript in each extracted table."""
    out = None
    for name in EXTRACTED:
        if name in tables:
            n = tables[name].where(F.col("manuscript_id") == manuscript_id).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            out = n if out is None else out.unionAll(n)
    return out


def wiped(tables: dict[str, DataFrame], manuscript_id: str) -> dict[str, DataFrame]:
    """The tables without the manuscript's extracted rows, and edges without characters that are gone."""
    left = {name: upsert.without(rows, [manuscript_id]) if name in EXTRACTED else rows for name, rows in tables.items()}
    if "appears_in" in left and "character" in left:
        left["appears_in"] = left["appears_in"].join(left["character"].select("character_id").distinct(), "character_id", "left_semi")
    return left


def wiped_ids(rows: DataFrame, column: str, ids: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Rows whose id is neither listed nor begins with the prefix; an empty list or prefix removes nothing."""
    left = upsert.without(rows, ids or [], column)
    return left.where(~F.col(column).startswith(prefix)) if prefix else left
