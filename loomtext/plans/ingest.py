"""From manuscript files to the raw layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext import errors
from loomtext.functions.text import word_count
from loomtext.operators import segmentation, upsert
from loomtext.schemas import accepted_and_quarantined
from loomtext.sources import manuscripts

KEYS = {"manuscript": ["manuscript_id"], "chapter": ["chapter_id"], "scene": ["scene_id"], "non_narrative_block": ["block_id"], "next_chapter": ["from_id", "to_id"], "next_scene": ["from_id", "to_id"]}
Keep = Callable[[DataFrame, str], DataFrame]
FAILURES = (errors.UnsupportedFormat, errors.InvalidFile, errors.NoNarrativeContent)


def kept_in(spark: SparkSession, root: str) -> Keep:
    """Writes what several tables derive from, so that files are parsed and scenes are made once."""

    def keep(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    return keep


def raw_layer(blocks: DataFrame, titles: DataFrame | None = None, keep: Keep = lambda rows, name: rows) -> dict[str, DataFrame]:
    """The tables of the raw layer for BLOCK rows of any number of manuscripts; titles: (manuscript_id, title) by source."""
    scenes = keep(segmentation.scene_table(blocks), "scenes")
    chapters = keep(segmentation.chapter_table(blocks, scenes), "chapters")
    sources = scenes.select("source_id", "manuscript_id").distinct()
    aside = segmentation.non_narrative(blocks).withColumnRenamed("manuscript_id", "source_id").join(sources, "source_id")
    per_scene = scenes.groupBy("manuscript_id", "source_id").agg(F.count("*").alias("scene_count"), F.count_distinct("chapter_id").alias("chapter_count"), F.sum(word_count(F.col("text"))).alias("word_count"))
    named = per_scene.withColumn("title", F.lit(None).cast("string")) if titles is None else per_scene.join(titles.select(F.col("manuscript_id").alias("source_id"), "title"), "source_id", "left")
    return {
        "manuscript": named.withColumn("source_format", F.lower(F.regexp_extract("source_id", r"\.([A-Za-z0-9]+)$", 1))).withColumn("ingested_at", F.current_timestamp()).dropDuplicates(["manuscript_id"]),
        "chapter": chapters.drop("source_id").dropDuplicates(["chapter_id"]),
        "scene": scenes.drop("source_id", "chapter_run").dropDuplicates(["scene_id"]),
        "non_narrative_block": aside.select(F.concat("manuscript_id", F.lit(":nn"), F.col("block_no").cast("string")).alias("block_id"), "manuscript_id", "kind", "text", "detected_by", "position").dropDuplicates(["block_id"]),
        "next_chapter": segmentation.next_edges(chapters.dropDuplicates(["chapter_id"]), "chapter_id", "order_narrative"),
        "next_scene": segmentation.next_edges(scenes.dropDuplicates(["scene_id"]), "scene_id", "order_narrative_global"),
    }


def ingest(spark: SparkSession, path: str, staging: str | None = None) -> dict[str, DataFrame]:
    """Read files under a path or pattern: the tables of those that can be read, `failed` (source_id, code, error), and `quarantine`
    with the rows that break a rule of their table.

    A file fails alone: of an unknown format, unreadable, without text, or without a scene. If all fail, the error of
    the first by name is raised; also if there is none, as Spark lists no file without bytes. staging: a folder for what several tables derive from; without it they compute it each.
    """
    keep = kept_in(spark, staging) if staging else lambda rows, name: rows
    found = manuscripts.files(spark, path)
    parsed = keep(manuscripts.parsed_files(found), "parsed")
    blocks = keep(manuscripts.blocks(found, parsed), "blocks")
    tables = accepted_and_quarantined(raw_layer(blocks, parsed, keep), keep)
    told = parsed.where("code is not null").select(F.col("manuscript_id").alias("source_id"), "code", "error")
    with_scenes = segmentation.raw_scenes(blocks).select(F.col("manuscript_id").alias("source_id")).distinct()
    empty = parsed.where("code is null").select(F.col("manuscript_id").alias("source_id")).join(with_scenes, "source_id", "left_anti")
    tables["failed"] = told.unionByName(empty.select("source_id", F.lit(errors.NoNarrativeContent.code).alias("code"), F.lit("no scene").alias("error")))
    if tables["scene"].isEmpty():
        first = tables["failed"].orderBy("source_id").first()
        raise next((e for e in FAILURES if first and e.code == first.code), errors.InvalidFile)(first.source_id if first else path)
    return tables


def saved(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Write the raw layer, one folder a manuscript: what is there of the same manuscripts is replaced."""
    for name in KEYS:
        upsert.write_manuscripts(tables[name], f"{root}/{name}")


def summaries(tables: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """What an upload is answered with, a row a manuscript: its counts, and whether it was not there before (created).

    known: the manuscript table before this one is written.
    """
    asides = tables["non_narrative_block"].groupBy("manuscript_id").agg(F.count("*").alias("non_narrative_block_count"))
    rows = tables["manuscript"].join(asides, "manuscript_id", "left").select("manuscript_id", "title", "source_format", "word_count", "chapter_count", "scene_count", F.coalesce("non_narrative_block_count", F.lit(0).cast("long")).alias("non_narrative_block_count"))
    if known is None:
        return rows.withColumn("created", F.lit(True))
    return rows.join(known.select("manuscript_id", F.lit(True).alias("old")).distinct(), "manuscript_id", "left").withColumn("created", F.col("old").isNull()).drop("old")
