"""Greedy matching by rounds and in order, and places in a total order, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import matching
from loomtext.operators.ranking import ranked


def plain_greedy(first, second):
    """{(group, x, y)} of rows (group, name, x) and (group, name, y): each x in order takes the least free y."""
    names, free, out = {}, {}, set()
    for g, n, x in first:
        names.setdefault((g, x), set()).add(n)
    for g, n, y in second:
        free.setdefault((g, n), set()).add(y)
    taken = set()
    for (g, x), own in sorted(names.items()):
        left = [y for n in own for y in free.get((g, n), ()) if (g, y) not in taken]
        if left:
            taken.add((g, min(left)))
            out.add((g, x, min(left)))
    return out


def got_greedy(spark, first, second, **how):
    a = spark.createDataFrame(first, "work string, name string, x long")
    b = spark.createDataFrame(second, "work string, name string, y long")
    return [tuple(r) for r in matching.greedy(a, b, "work", **how).collect()]


def lists(rng, n, names):
    return [(rng.choice("uvw"), rng.choice(names), i) for i in range(n) for _ in range(rng.choice([1, 1, 1, 2, 3]))]


def test_rounds_match_like_the_walk(spark):
    rng = random.Random(31)
    first, second = lists(rng, 120, [f"n{i}" for i in range(60)]), lists(rng, 120, [f"n{i}" for i in range(60)])
    # everyone in h is called h; some have another name too
    first += [("h", "h", i) for i in range(90)] + [("h", f"k{i % 4}", i) for i in range(0, 90, 30)]
    second += [("h", "h", i) for i in range(0, 160, 2)] + [("h", f"k{i % 3}", i) for i in range(10, 90, 40)]
    want = plain_greedy(first, second)
    for small in (25, matching.SMALL):
        got = got_greedy(spark, first, second, small=small)
        assert len(got) == len(set(got)) and set(got) == want, small


def test_small_groups_are_walked_in_one_stream(spark):
    """Works cost what their rows cost: no frame is made for each, and one may stand in several batches."""
    rng = random.Random(33)
    names = [f"n{i}" for i in range(9)]
    first, second = ([(f"w{rng.randrange(40)}", rng.choice(names), i // 2) for i in range(400)] for _ in range(2))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert set(got_greedy(spark, first, second)) == plain_greedy(first, second)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    a, b = spark.createDataFrame(first, "work string, name string, x long"), spark.createDataFrame(second, "work string, name string, y long")
    plan = matching.greedy(a, b, "work")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_lists_that_do_not_meet_or_are_not_there(spark):
    assert got_greedy(spark, [("w", "a", 1)], [("w", "b", 1)]) == got_greedy(spark, [], []) == got_greedy(spark, [("w", "a", 1)], [("v", "a", 1)]) == []
    assert got_greedy(spark, [("w", "a", 1)] * 3 + [("w", "a", 2)], [("w", "a", 5)] * 2) == [("w", 1, 5)]


def test_a_large_work_has_no_task_of_its_own(spark):
    """30,000 entities of one work, most with names of their own, 2,000 of one name: few rounds, and no stage walks the work."""
    a = spark.range(30_000).select(F.lit("w").alias("work"), F.when(F.col("id") % 15 == 0, "shared").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"), F.col("id").alias("x"))
    b = a.select("work", "name", (30_000 - F.col("x")).alias("y"))
    got = {(r.x, r.y) for r in matching.greedy(a, b, "work", small=50).collect()}
    shared = range(0, 30_000, 15)
    assert {y for x, y in got if x % 15 == 0} == {30_000 - x for x in shared} and (0, 30_000 - shared[-1]) in got
    assert len(got) == 30_000 and all(y == 30_000 - x for x, y in got if x % 15)


@pytest.mark.parametrize("within", [(), ("g",)])
def test_places_are_those_of_a_sorted_list(spark, within):
    rng = random.Random(33)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), i) for i in range(400)]
    table = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r.i: r.place for r in ranked(table, [F.desc("v"), F.col("i")], within).collect()}
    for g in {r[0] for r in rows} if within else {0}:
        own = sorted(((-v, i) for x, v, i in rows if not within or x == g))
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert ranked(table.where("false"), [F.col("v")], within).count() == 0
