"""Who belongs together by links that chain: connected components by joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.sources.staging import dropped, staged


#: Links of which one task can keep track.
SMALL = 100_000


def _by_walking(edges: DataFrame) -> DataFrame:
    """Rows (a, b), b the least node that a reaches, of links that are few enough for one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        yield pd.DataFrame([(x, root(x)) for x in list(up)], columns=["a", "b"])

    return edges.repartition(1).mapInPandas(walk, f"a {kind}, b {kind}").where("a <> b")


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node that can be reached. Links of a node with itself count.

    Links are redrawn in two turns until nothing changes: every node hands its larger neighbours to the least node it
    knows, then its smaller ones. Each round about halves the distances, and a node with very many links is a minimum and a join
    of one row with many, which a skewed join splits. Joins are merges: by the size of the files that links are staged in, Spark would
    send tables of many times that size through the driver. As soon as no more than `small` links are left, one task walks them.
    """
    nodes = staged(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while (n := edges.count()) > small:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = staged(both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(mins.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = staged(moved.unionAll(mins.select("a", F.col("m").alias("b"))).distinct(), "links")
        same = turned.count() == n and turned.join(edges.hint("merge"), ["a", "b"], "left_anti").isEmpty()
        dropped(edges, large)
        edges = turned
        if same:
            break
    else:
        edges = _by_walking(edges)
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def final_targets(merges: DataFrame, small: int = SMALL) -> DataFrame:
    """(from_id, to_id): where each merged id ends up when merges (from_id, to_id) are followed to their end.

    Chains of any length lead to the id that is merged into nothing. An id that was merged into several makes those one:
    the least of them that is merged into nothing stays. In a circle the least id stays. An id merged into itself stays.
    """
    given = merges.where("from_id <> to_id").select("from_id", "to_id").distinct()
    found = staged(components(given.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), small), "merged")
    absorbed = given.select(F.col("from_id").alias("node")).distinct().withColumn("gone", F.lit(True))
    told = found.join(absorbed.hint("merge"), "node", "left")
    roots = told.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("gone").isNull(), F.col("node"))), F.min("node")).alias("to_id"))
    return found.join(roots.hint("merge"), "label").where("node <> to_id").select(F.col("node").alias("from_id"), "to_id")
