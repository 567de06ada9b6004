"""Stored model responses: a keyed table instead of one file for each response."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store(spark: SparkSession, path: str) -> DataFrame:
    """cache_key and payload of a folder of <key>.json files, or of a table written by save()."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("cache_key"), F.col("value").alias("payload"))


def looked_up(wanted: DataFrame, stored: DataFrame, schema: str, valid: Column, force: bool = False) -> DataFrame:
    """Adds response and hit to rows with a cache_key. Missing, unreadable or contract-breaking payloads are misses.

    `valid` is over the column response. force takes every row as a miss. Of several payloads of a key the latest counts.
    """
    at = F.col("answered_at") if "answered_at" in stored.columns else F.lit(0)
    latest = stored.where("payload is not null").groupBy("cache_key").agg(F.max_by("payload", at).alias("payload"))
    rows = wanted.join(latest, "cache_key", "left").withColumn("response", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
    hit = F.lit(False) if force else F.coalesce(F.col("response").isNotNull() & valid, F.lit(False))
    return rows.withColumn("hit", hit).withColumn("response", F.when(F.col("hit"), F.col("response"))).drop("payload")


def save(responses: DataFrame, path: str) -> None:
    """Append rows (layer, cache_key, payload and more), one folder a layer."""
    responses.write.mode("append").partitionBy("layer").parquet(path)


def saved(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """The rows save() has written for a layer; none if there are none yet."""
    schema = "layer string, cache_key string, payload string, error string, answered_at timestamp"
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("layer") == layer)
    except AnalysisException:  # the folder does not exist yet
        return spark.createDataFrame([], schema)
