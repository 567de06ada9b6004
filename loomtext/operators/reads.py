"""Read queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.errors import ManuscriptNotFound, NotExtracted
from loomtext.operators.evidence import first_appearances
from loomtext.operators.ranking import ranked


def mentions_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mentions with their characters, a row for each edge: mention_node rows joined with has_mention."""
    return nodes.join(edges.select("mention_id", "character_id"), "mention_id")


def structure(scenes: DataFrame) -> DataFrame:
    """One row a manuscript: chapters in order, each with its scenes in order, as nested arrays."""
    columns = [c for c in ("order_in_chapter", "scene_id", "order_narrative_global", "start_offset", "end_offset", "boundary_reason", "snippet") if c in scenes.columns]
    chapters = scenes.groupBy("manuscript_id", "order_narrative").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("scenes"))
    return chapters.groupBy("manuscript_id").agg(F.array_sort(F.collect_list(F.struct("order_narrative", "scenes"))).alias("chapters"))


def structure_summary(tables: dict[str, DataFrame], include_snippets: bool = True, snippet_len: int = 120) -> DataFrame:
    """One row a manuscript of the raw layer: its counts, chapters with their scenes, and non-narrative blocks in order.

    Manuscripts without chapters, and chapters without scenes, have empty arrays.
    """
    scene = ["order_in_chapter", "order_narrative_global", "char_count", "boundary_reason", *([F.substring("snippet", 1, snippet_len).alias("snippet")] if include_snippets else [])]
    scenes = tables["scene"].groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct(*scene))).alias("scenes"))
    chapters = tables["chapter"].join(scenes, "chapter_id", "left").withColumn("scenes", F.coalesce("scenes", F.array().cast(scenes.schema["scenes"].dataType)))
    listed = chapters.groupBy("manuscript_id").agg(F.array_sort(F.collect_list(F.struct("order_narrative", "title", "kind", "word_count", F.size("scenes").alias("scene_count"), "scenes"))).alias("chapters"))
    aside = tables["non_narrative_block"].withColumn("no", F.regexp_extract("block_id", r"(\d+)$", 1).cast("int"))
    asides = aside.groupBy("manuscript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "kind", "detected_by", "position"))), lambda x: F.struct(x["kind"].alias("kind"), x["detected_by"].alias("detected_by"), x["position"].alias("position"))).alias("non_narrative_blocks"))
    rows = tables["manuscript"].join(listed, "manuscript_id", "left").join(asides, "manuscript_id", "left")
    empty = lambda c, d: F.coalesce(c, F.array().cast(d.schema[c].dataType)).alias(c)
    return rows.select("manuscript_id", "title", "source_format", "word_count", "chapter_count", "scene_count", empty("chapters", listed), empty("non_narrative_blocks", asides))


def pending_count(candidates: DataFrame, manuscript_id: str) -> int:
    """Merge candidates of a manuscript that wait for a decision."""
    return candidates.where((F.col("manuscript_id") == manuscript_id) & (F.col("status") == "pending")).count()


def characters_of(manuscript_id: str, characters: DataFrame, appearances: DataFrame, scenes: DataFrame, mentions: DataFrame, **how) -> DataFrame:
    """character_list() of one manuscript with each one's first scene in narrative order and first quote there."""
    own = characters.where(F.col("manuscript_id") == manuscript_id)
    first = first_appearances(appearances, scenes, mentions).select("character_id", F.col("order_narrative_global").alias("first_order"), F.col("quote").alias("first_quote"))
    return character_list(own, appearances, **how).join(first, "character_id", "left")


def character_list(characters: DataFrame, appearances: DataFrame, role: str | None = None, include_mentioned_only: bool = True, order_by: str = "appearances") -> DataFrame:
    """Characters with their counts, the first scene in narrative order, and their place in the list.

    Lists are ordered by appearances (the most first; also if order_by is unknown), first_appearance or name.
    """
    seen = appearances.groupBy("character_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "present").alias("present"), F.min("scene_id").alias("first_scene"))
    rows = characters.join(seen, "character_id", "left").withColumn("appearance_count", F.coalesce("n", F.lit(0)))
    if role:
        rows = rows.where(F.col("role") == role)
    if not include_mentioned_only:
        rows = rows.where(F.coalesce("present", F.lit(0)) > 0)
    orders = {"appearances": [F.desc("appearance_count"), F.col("canonical_name")], "first_appearance": [F.col("first_scene").asc_nulls_last()], "name": [F.col("canonical_name")]}
    return ranked(rows.select("character_id", "canonical_name", "appearance_count", "first_scene"), [*orders.get(order_by, orders["appearances"]), F.col("character_id")])


def character_detail(characters: DataFrame, appearances: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """character_id, appearances in narrative order, mentions by scene and place."""
    seen = appearances.groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct("order_narrative_global", "scene_id", "kind"))).alias("appearances"))
    out = characters.join(seen, "character_id", "left").withColumn("appearances", F.coalesce("appearances", F.array().cast(seen.schema["appearances"].dataType)))
    if mentions is None:
        return out
    said = mentions.groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct("scene_id", "start_offset", "mention_id", "surface", "quote"))).alias("mentions"))
    return out.join(said, "character_id", "left")


def merge_queue(candidates: DataFrame, characters: DataFrame, status: str | None = "pending") -> DataFrame:
    """Candidates with both names, by falling confidence; pending ones, those of a status, or all."""
    names = lambda side: characters.select(F.col("character_id").alias(f"character_{side}_id"), F.col("canonical_name").alias(f"name_{side}"))
    rows = candidates if status is None else candidates.where(F.col("status") == status)
    return ranked(rows.join(names("a"), "character_a_id").join(names("b"), "character_b_id"), [F.desc("confidence"), F.col("character_a_id"), F.col("character_b_id")])


def relation_list(relates_to: DataFrame, characters: DataFrame, provenance: str | None = None) -> DataFrame:
    names = lambda side: characters.select(F.col("character_id").alias(f"character_{side}_id"), F.col("canonical_name").alias(f"name_{side}"), F.col("aliases").alias(f"aliases_{side}"))
    rows = relates_to if provenance is None else relates_to.where(F.col("provenance") == provenance)
    return rows.join(names("a"), "character_a_id").join(names("b"), "character_b_id").orderBy(F.desc("evidence_count"), "name_a", "character_a_id", "character_b_id")


def attribute_list(attributes: DataFrame, characters: DataFrame) -> DataFrame:
    return attributes.join(characters.select("character_id", "canonical_name"), "character_id").orderBy("canonical_name", "key", "value_norm")


def scene_coordinates(scenes: DataFrame) -> DataFrame:
    return scenes.select("scene_id", F.concat(F.lit("c"), F.col("order_narrative").cast("string"), F.lit("/s"), F.col("order_in_chapter").cast("string")).alias("coordinate"))


def require(manuscripts: DataFrame, layer_runs: DataFrame, manuscript_id: str, layer: str) -> None:
    """Existence first, then whether the layer ran: a run that found nothing is a run."""
    if manuscripts.where(F.col("manuscript_id") == manuscript_id).isEmpty():
        raise ManuscriptNotFound(manuscript_id)
    if layer_runs.where((F.col("manuscript_id") == manuscript_id) & (F.col("layer") == layer)).isEmpty():
        raise NotExtracted(f"{manuscript_id}: {layer}")


def gated(rows: DataFrame, manuscripts: DataFrame, layer_runs: DataFrame, manuscript_id: str, layer: str) -> DataFrame:
    """The rows; their plan itself fails where require() would, so that no job has to look first.

    What is looked at are two counts; they come as a further branch without rows, which is evaluated with the others, also
    where rows has none.
    """
    own = F.col("manuscript_id") == manuscript_id
    there = manuscripts.where(own).agg(F.count("*").alias("n")).select("n", F.lit(f"{ManuscriptNotFound.code}: {manuscript_id}").alias("told"))
    ran = layer_runs.where(own & (F.col("layer") == layer)).agg(F.count("*").alias("n")).select("n", F.lit(f"{NotExtracted.code}: {manuscript_id}: {layer}").alias("told"))
    first = F.min(F.struct("place", "n", "told"))  # of two failures the first is told
    failed = there.withColumn("place", F.lit(1)).unionAll(ran.withColumn("place", F.lit(2))).where("n = 0").agg(first.alias("x")).where("x is not null")
    probe = failed.where(F.raise_error(F.col("x.told")).cast("boolean")).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionAll(probe)
