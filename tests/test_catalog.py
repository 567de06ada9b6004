"""Tables with a layout: created once, joined without a shuffle, replaced from themselves."""

import pytest
from pyspark.sql import functions as F

from loomtext.sources import catalog


@pytest.fixture
def database(spark):
    name = "loomtext_layout"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    catalog.created(spark, name, buckets=3)
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_joins_by_manuscript_need_no_exchange(spark, database):
    books = [f"m{i}" for i in range(7)]
    scene = spark.createDataFrame([(f"{m}:s{i}", f"{m}:c0", m, i, i, "text", 4, 0, 4, "separator", "text") for m in books for i in range(3)], spark.table(f"{database}.scene").schema)
    node = spark.createDataFrame([(f"{m}:x{i}", m, f"{m}:s{i}", "Ana", "name", 0, 3, "q") for m in books for i in range(3)], spark.table(f"{database}.mention_node").schema)
    catalog.saved(scene.repartition(5), database, "scene")
    catalog.saved(node.repartition(5), database, "mention_node")
    settings = catalog.IN_PLACE | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        scenes, mentions = catalog.table(spark, database, "scene"), catalog.table(spark, database, "mention_node")
        joined = mentions.join(scenes.select("manuscript_id", "scene_id", "order_narrative_global"), ["manuscript_id", "scene_id"])
        counted = joined.groupBy("manuscript_id").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, counted.collect())) == [(m, 3) for m in books]
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_tables_are_created_once_and_replaced_from_themselves(spark, database):
    kind = spark.table(f"{database}.has_mention").schema
    catalog.saved(spark.createDataFrame([("m", "c1", "x1"), ("n", "c2", "x2")], kind), database, "has_mention")
    catalog.created(spark, database, buckets=3)
    own = catalog.table(spark, database, "has_mention")
    assert own.count() == 2
    catalog.saved(own.unionByName(spark.createDataFrame([("m", "c3", "x1")], kind)).where("manuscript_id = 'm'"), database, "has_mention")
    assert sorted(map(tuple, catalog.table(spark, database, "has_mention").collect())) == [("m", "c1", "x1"), ("m", "c3", "x1")]
    with pytest.raises(Exception, match="end_offset|UNRESOLVED_COLUMN"):
        catalog.saved(own, database, "mention_node")
