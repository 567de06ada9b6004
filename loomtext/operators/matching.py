"""Greedy matching of two lists whose entries meet when they share a name."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.ranking import ranked
from loomtext.sources.staging import dropped, staged

#: Rows of a group that one task matches in order.
SMALL = 200_000


def _in_order(first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """Matches of groups that are small: one walk over x in order, each name keeping its place in its sorted y.

    A task walks its groups one after the other in one stream of rows (y of a group before its x), so a group costs what its
    rows cost, however many groups there are.
    """
    kinds = {c: t for d in (first, second) for c, t in d.dtypes}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, names, free, taken, rows = object(), None, [], {}, set(), []

        def settle() -> None:
            best = None
            for name in names:
                left = free.get(name, ())
                while left and left[0] in taken:
                    left.popleft()
                if left and (best is None or left[0] < best):
                    best = left[0]
            if best is not None:
                taken.add(best)
                rows.append((at, x, best))
            names.clear()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)) if rows else ([], [], []), strict=True)), schema=schema)
            rows.clear()
            return out

        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in (group, "x", "y")])
            for work, name, a, b, is_first in zip(*(batch.column(c).to_pylist() for c in (group, "name", "x", "y", "is_first")), strict=True):
                if work != at or is_first and names and a != x:
                    settle()
                if work != at:
                    at, free, taken = work, {}, set()
                if is_first:
                    x = a
                    names.append(name)
                else:
                    free.setdefault(name, deque()).append(b)
            yield told()
        if names:
            settle()
            yield told()

    side = lambda rows, c, other: rows.select(group, "name", c, F.lit(None).cast(kinds[other]).alias(other), F.lit(c == "x").alias("is_first"))
    line = side(first, "x", "y").unionByName(side(second, "y", "x")).repartition(group).sortWithinPartitions(group, "is_first", "x", "y")
    return line.mapInArrow(walk, f"{group} {kinds[group]}, x {kinds['x']}, y {kinds['y']}")


def _sure(first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """Matches that hold whatever the others do.

    An x and a y that are each other's least choice are one. Under one name, entries without another name that come before the first
    entry with several match in order, all at once, as nobody else can come between them.
    """
    by_name = [group, "name"]
    least_y = first.join(second.groupBy(*by_name).agg(F.min("y").alias("y")), by_name).groupBy(group, "x").agg(F.min("y").alias("y"))
    least_x = second.join(first.groupBy(*by_name).agg(F.min("x").alias("x")), by_name).groupBy(group, "y").agg(F.min("x").alias("x"))
    mutual = least_y.join(least_x, [group, "x", "y"])

    def simple(rows: DataFrame, c: str) -> DataFrame:
        many = rows.join(rows.groupBy(group, c).agg(F.count("*").alias("names")), [group, c])
        bound = many.where("names > 1").groupBy(*by_name).agg(F.min(c).alias("bound"))
        early = many.join(bound, by_name, "left").where(F.col("bound").isNull() | (F.col(c) < F.col("bound"))).where("names = 1")
        return ranked(early.select(*by_name, c), [F.col(c)], tuple(by_name))

    zipped = simple(first, "x").join(simple(second, "y"), [*by_name, "place"]).select(group, "x", "y")
    return mutual.select(group, "x", "y").unionByName(zipped).distinct()


def greedy(first: DataFrame, second: DataFrame, group: str, small: int = SMALL) -> DataFrame:
    """(group, x, y): each x in order takes the least y that shares a name with it and is not taken, within a group.

    first: (group, name, x), second: (group, name, y), a row for each name. Pairs that share a name are never listed. Groups
    of at most `small` rows are walked in order in one task each. Larger ones lose, round by round, the matches that
    are sure, until they are small or done; the result is the same. A chain in which every choice waits for the one before it
    takes a round for each link beyond `small` rows.
    """
    first, second = staged(first.select(group, "name", "x").distinct(), "first"), staged(second.select(group, "name", "y").distinct(), "second")
    found = None
    while True:
        names = first.select(group, "name").distinct().intersect(second.select(group, "name").distinct())
        a, b = (staged(rows.join(names, [group, "name"], "left_semi"), "live") for rows in (first, second))
        dropped(first, second)
        sizes = a.select(group).unionAll(b.select(group)).groupBy(group).agg(F.count("*").alias("n"))
        large = staged(sizes.where(F.col("n") > small).select(group), "large")
        done = _in_order(a.join(large, group, "left_anti"), b.join(large, group, "left_anti"), group)
        found = done if found is None else found.unionByName(done)
        if large.isEmpty():
            return found
        a, b = (rows.join(large, group, "left_semi") for rows in (a, b))
        sure = staged(_sure(a, b, group), "sure")
        found = found.unionByName(sure)
        first, second = (staged(rows.join(sure.select(group, c).distinct(), [group, c], "left_anti"), "left") for rows, c in ((a, "x"), (b, "y")))
