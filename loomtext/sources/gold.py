"""Gold data sets and stored evaluation results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import NotMeasured

CHARACTERS = "work string, annotation_criteria string, characters array<struct<gold_id:string,canonical_name:string,aliases:array<string>,role:string,is_mentioned_only:boolean,appearances:array<string>,mentions:array<struct<scene:string,surface:string>>>>"
RELATIONS = "work string, annotation_criteria string, partial boolean, relations array<struct<a:string,b:string,rel_type:string,descriptor:string,provenance:string>>"
ATTRIBUTES = "work string, annotation_criteria string, attributes array<struct<character:string,key:string,value_norm:string,class:string>>"
RESULT = "layer string, work string, day string, commit string, scores string"


def gold(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """One row an annotation, with its work and its position; a missing file is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("work", F.posexplode(field).alias("pos", "g")).select("work", "pos", "g.*")


def save_result(spark: SparkSession, path: str, layer: str, work: str, day: str, commit: str, scores: dict) -> None:
    row = [(layer, work.replace("/", "-").replace(".", "-"), day, commit, json.dumps(scores, sort_keys=True))]
    spark.createDataFrame(row, RESULT).coalesce(1).write.mode("append").partitionBy("layer").json(path)


def last_result(spark: SparkSession, path: str, layer: str, work: str) -> dict | None:
    """The latest stored scores of a work; read it before saving new ones to compare with them."""
    rows = spark.read.schema(RESULT).json(path).where((F.col("layer") == layer) & (F.col("work") == work.replace("/", "-").replace(".", "-")))
    last = rows.agg(F.max_by("scores", F.struct("day", "commit")).alias("s")).first()["s"]
    return json.loads(last) if last else None


def measured(predicted: DataFrame, what: str) -> DataFrame:
    """The rows, or an error: nothing extracted is not a score of 0."""
    if predicted.isEmpty():
        raise NotMeasured(what)
    return predicted
