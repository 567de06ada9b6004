"""Scenes as they come: responses are looked up batch by batch, and only manuscripts that a batch touches are derived again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators import evidence, upsert
from loomtext.plans import layers
from loomtext.schemas import RELATIONS
from loomtext.sources import responses
from loomtext.sources.staging import dropped, staged

KEYED = "manuscript_id string, scene_id string, order_narrative_global int, cast_ids array<string>, cache_key string"
EVIDENCE = "scene_id string, narrative_order int, character_a_id string, character_b_id string, rel_type string, descriptor string, role_a string, role_b string, provenance string, confidence double, quote string, evidence_id string, manuscript_id string"
RELATES = "character_a_id string, character_b_id string, rel_type string, descriptor string, role_a string, role_b string, provenance string, confidence double, evidence_count long, first_evidence_id string, manuscript_id string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


def take(batch: DataFrame, store: str, target: str) -> None:
    """One batch of keyed scenes into target/relation_evidence and target/relates_to, both one folder a manuscript.

    Evidence is keyed, the latest of an id counts, so a batch that is taken twice leaves the same tables. The join with the
    response store is made for each batch, and so sees what was stored since the stream began. A touched manuscript
    without a relation keeps a row of nulls, which takes the place of relations that it had.
    """
    spark = batch.sparkSession
    looked = responses.looked_up(batch, responses.saved(spark, store, "relations"), RELATIONS, layers.relation_contract())
    names = [c.split()[0] for c in EVIDENCE.split(", ")]
    new = layers.relation_tables(looked)["relation_evidence"].select(*names)
    touched = staged(batch.select("manuscript_id").distinct(), "touched")
    old = _stored(spark, f"{target}/relation_evidence", EVIDENCE).join(touched, "manuscript_id", "left_semi").select(*names)
    rows = staged(upsert.upserted(old, new, ["evidence_id"]), "evidence")
    upsert.write_manuscripts(rows, f"{target}/relation_evidence")
    columns = [c.split()[0] for c in RELATES.split(", ")]
    made = touched.join(evidence.relation_map(rows), "manuscript_id", "left").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in RELATES.split(", ")])
    upsert.write_manuscripts(made.select(*columns), f"{target}/relates_to")
    dropped(touched, rows)


def relations(spark: SparkSession, target: str) -> DataFrame:
    """The relation map as it stands."""
    return _stored(spark, f"{target}/relates_to", RELATES).where("character_a_id is not null")


def evidence_stream(spark: SparkSession, source: str, store: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read JSON rows of KEYED scenes from a folder until it is drained."""
    stream = spark.readStream.schema(KEYED).json(source)
    return stream.writeStream.foreachBatch(lambda batch, _: take(batch.persist(), store, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
