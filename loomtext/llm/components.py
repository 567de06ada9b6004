"""Connected components by contraction: joins and minima only, nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, label) for every node of the edges (a, b); label is the same within a component, else different.

    Each round every node hooks on to the least node among itself and its neighbours, chains of hooks are followed by
    doubling, and edges are rewritten to the ends of the chains; loops and repeats fall away. An edge table without
    rows gives no rows; loops in the input give their node.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = None
    edges = written(edges.select("a", "b").distinct(), name)
    while True:
        hooks = written(both(edges).groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), name)
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            jumped = written(hooks.join(up, "label").select("node", F.col("higher").alias("label"), (F.col("higher") != F.col("label")).alias("moved")), name)
            hooks = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        found = hooks if found is None else written(found.join(hooks.select(F.col("node").alias("label"), F.col("label").alias("higher")), "label", "left").select("node", F.coalesce("higher", "label").alias("label")), name)
        a, b = hooks.select(F.col("node").alias("a"), F.col("label").alias("x")), hooks.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
        if edges.isEmpty():
            return found
