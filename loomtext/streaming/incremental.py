"""Manuscripts as they come: block files are ingested in micro-batches, whole manuscripts at a time.

A late block has no place in scenes already numbered, so a manuscript with new blocks is segmented again from all its
blocks. The block log is append-only and keyed, so a batch that is run twice leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators import segmentation, upsert
from loomtext.schemas import BLOCK


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read JSON block rows from a folder until it is drained; scenes go to target/scene, by source manuscript."""
    stream = spark.readStream.schema(BLOCK).json(source)

    def take(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["manuscript_id", "pos"]).withColumn("batch", F.lit(batch_id))
        new.write.mode("overwrite").parquet(f"{target}/blocks/batch={batch_id}")
        log = spark.read.schema(f"{BLOCK}, batch long").parquet(f"{target}/blocks")
        touched = log.where(F.col("batch") == batch_id).select("manuscript_id").distinct()
        last = log.join(touched, "manuscript_id", "left_semi").groupBy("manuscript_id", "pos").agg(F.max_by(F.struct("kind", "text", "level", "style", "source_role"), "batch").alias("b")).select("manuscript_id", "pos", "b.*")
        upsert.write_manuscripts(segmentation.scene_table(last).drop("chapter_run"), f"{target}/scene", "source_id")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
