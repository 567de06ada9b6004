"""Tables of the catalog with a layout: bucketed by manuscript, so that the joins of the layers find their rows in place.

A join by manuscript and a further column (scene, mention) is in place too if the session lets part of the keys do: IN_PLACE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.schemas import TABLES
from loomtext.sources.staging import dropped, staged


#: Session settings under which joins by the owner and more find their rows in place.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.enabled": "true"}


def created(spark: SparkSession, database: str, buckets: int = 64) -> None:
    """Create what is absent of TABLES, each bucketed by its owner and sorted by it and its key; what is there stays as it is.

    The number of buckets fits tables whose buckets are some hundred MB each; all tables need the same for joins in place.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (schema, owner, key) in TABLES.items():
        order = ", ".join(dict.fromkeys([owner, *key]))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet CLUSTERED BY ({owner}) SORTED BY ({order}) INTO {buckets} BUCKETS")


def table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"{database}.{name}")


def saved(rows: DataFrame, database: str, name: str) -> None:
    """Replace the table by rows, in the columns and types of its schema. Rows may be made from the table itself."""
    spark = rows.sparkSession
    schema = spark.table(f"{database}.{name}").schema
    ready = staged(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), f"save_{name}")
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {database}.{name}").collect() if r["col_name"] == "Num Buckets"))
    ready.repartition(buckets, TABLES[name][1]).write.insertInto(f"{database}.{name}", overwrite=True)
    dropped(ready)
