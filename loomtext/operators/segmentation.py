"""Blocks to chapters, scenes and non-narrative runs: running sums over the order of blocks.

Every step is a window over one manuscript, so manuscripts are the unit of parallelism. Text is joined to ordinals
last where a step needs keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import heading_kind, heading_title, normalized, paratext_kind, snippet, word_count

#: Declared roles of blocks that are not narrative, and their kind.
ROLE_KINDS = {
    "cover": "cover", "title-page": "cover", "titlepage": "cover", "copyright-page": "license", "copyright": "license", "toc": "toc", "loi": "toc", "lot": "toc",
    "dedication": "frontmatter", "acknowledgements": "frontmatter", "notes": "backmatter", "colophon": "backmatter", "index": "backmatter", "bibliography": "backmatter", "glossary": "backmatter",
}


def _order(owner: str = "manuscript_id", by: str = "pos") -> Window:
    return Window.partitionBy(owner).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def is_paratext() -> Column:
    return F.lower(F.coalesce("source_role", F.lit(""))).isin(*ROLE_KINDS)


def with_chapters(blocks: DataFrame) -> DataFrame:
    """Narrative blocks with the running number of their heading; 0 is front matter, or the only chapter of a manuscript without headings."""
    heading = (F.col("kind") == "heading").cast("int")
    counted = blocks.where(~is_paratext()).withColumn("chapter_run", F.sum(heading).over(_order()))
    return counted.withColumn("has_heading", F.max(heading).over(Window.partitionBy("manuscript_id")) == 1)


def narrative(blocks: DataFrame) -> DataFrame:
    return with_chapters(blocks).where((F.col("chapter_run") > 0) | ~F.col("has_heading"))


def front_matter(blocks: DataFrame) -> DataFrame:
    return with_chapters(blocks).where((F.col("chapter_run") == 0) & F.col("has_heading"))


def with_scenes(chaptered: DataFrame) -> DataFrame:
    """Adds scene_run: separators seen so far in the chapter."""
    by_chapter = Window.partitionBy("manuscript_id", "chapter_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chaptered.withColumn("scene_run", F.sum((F.col("kind") == "separator").cast("int")).over(by_chapter))


def raw_scenes(blocks: DataFrame) -> DataFrame:
    """manuscript_id, chapter_run, scene_run, text, boundary_reason: scenes with text after normalisation."""
    parts = with_scenes(narrative(blocks)).where("kind = 'paragraph'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return (
        parts.groupBy("manuscript_id", "chapter_run", "scene_run")
        .agg(normalized(joined).alias("text"))
        .where("text <> ''")
        .withColumn("boundary_reason", F.when(F.col("scene_run") > 0, "separator").otherwise("chapter_start"))
    )


def with_ordinals(scenes: DataFrame) -> DataFrame:
    """Orders from 0 of the chapters and scenes that are left, and offsets with two places between scenes."""
    whole = Window.partitionBy("manuscript_id").orderBy("chapter_run", "scene_run")
    chapter = Window.partitionBy("manuscript_id", "chapter_run").orderBy("scene_run")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    return (
        scenes.withColumn("char_count", F.length("text"))
        .withColumn("order_narrative", F.dense_rank().over(Window.partitionBy("manuscript_id").orderBy("chapter_run")) - 1)
        .withColumn("order_in_chapter", F.row_number().over(chapter) - 1)
        .withColumn("order_narrative_global", F.row_number().over(whole) - 1)
        .withColumn("start_offset", F.coalesce(F.sum(F.col("char_count") + 2).over(before), F.lit(0)).cast("long"))
        .withColumn("end_offset", F.col("start_offset") + F.col("char_count"))
    )


def content_ids(scenes: DataFrame) -> DataFrame:
    """Per source manuscript, the SHA-256 of its scenes in order, joined by an empty line."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order_narrative_global", "text"))), lambda x: x["text"])
    return scenes.groupBy("manuscript_id").agg(F.sha2(F.array_join(texts, "\n\n"), 256).alias("content_id"))


def scene_table(blocks: DataFrame) -> DataFrame:
    """SCENE rows; ids derive from the content, so the same text gives the same ids."""
    ordered = with_ordinals(raw_scenes(blocks))
    named = ordered.join(content_ids(ordered), "manuscript_id").withColumn("source_id", F.col("manuscript_id")).withColumn("manuscript_id", F.col("content_id"))
    chapter = F.concat("manuscript_id", F.lit(":c"), F.col("order_narrative").cast("string"))
    return named.select(
        F.concat(chapter, F.lit(":s"), F.col("order_in_chapter").cast("string")).alias("scene_id"),
        chapter.alias("chapter_id"),
        "manuscript_id",
        "order_in_chapter",
        "order_narrative_global",
        "text",
        "char_count",
        "start_offset",
        "end_offset",
        "boundary_reason",
        snippet(F.col("text")).alias("snippet"),
        "order_narrative",
        "chapter_run",
        "source_id",
    )


def chapter_table(blocks: DataFrame, scenes: DataFrame) -> DataFrame:
    """CHAPTER rows from the scenes and the heading blocks that opened the chapters."""
    headings = narrative(blocks).where("kind = 'heading'").select(F.col("manuscript_id").alias("source_id"), "chapter_run", F.col("text").alias("heading"))
    per = scenes.groupBy("source_id", "manuscript_id", "chapter_id", "order_narrative", "chapter_run").agg(
        F.sum(word_count(F.col("text"))).alias("word_count"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset")
    )
    kind, title = heading_kind(F.col("heading")), heading_title(F.col("heading"))
    return per.join(headings, ["source_id", "chapter_run"], "left").select(
        "chapter_id", "manuscript_id", "order_narrative", title.alias("title"), F.when(F.col("heading").isNull(), "chapter").otherwise(kind).alias("kind"), "word_count", "start_offset", "end_offset", "source_id"
    )


def non_narrative(blocks: DataFrame) -> DataFrame:
    """manuscript_id, block_no, kind, detected_by, text, position: declared paratext, then front matter, equal neighbours joined."""
    roles = F.create_map(*[F.lit(x) for pair in ROLE_KINDS.items() for x in pair])
    role = F.lower(F.coalesce("source_role", F.lit("")))
    columns = ("manuscript_id", "pos", "kind", "text", "source_role")
    drafts = blocks.where(is_paratext()).select(*columns, F.lit(0).alias("part")).unionByName(front_matter(blocks).select(*columns, F.lit(1).alias("part"))).where("kind <> 'separator'")
    said = F.when(role.isin(*ROLE_KINDS), F.struct(F.try_element_at(roles, role).alias("kind"), F.lit("source_role").alias("detected_by"))).otherwise(paratext_kind(F.col("text")))
    return merged_runs(drafts.withColumn("said", said).select("manuscript_id", "part", "pos", "said.kind", "said.detected_by", "text")).withColumn("position", F.lit("before"))


def merged_runs(drafts: DataFrame) -> DataFrame:
    """Gaps and islands: neighbours of equal kind and detected_by become one row, texts joined by an empty line."""
    order = Window.partitionBy("manuscript_id").orderBy("part", "pos")
    changed = (F.lag("kind").over(order) == F.col("kind")) & (F.lag("detected_by").over(order) == F.col("detected_by"))
    runs = drafts.withColumn("new", (~F.coalesce(changed, F.lit(False))).cast("int")).withColumn("block_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "text"))), lambda x: x["text"]), "\n\n")
    return runs.groupBy("manuscript_id", "block_no").agg(F.first("kind").alias("kind"), F.first("detected_by").alias("detected_by"), text.alias("text"))


def next_edges(nodes: DataFrame, key: str, order: str, owner: str = "manuscript_id") -> DataFrame:
    """from_id, to_id of neighbours in narrative order."""
    return nodes.select(F.col(owner), F.col(key).alias("from_id"), F.lead(key).over(Window.partitionBy(owner).orderBy(order)).alias("to_id")).where("to_id is not null")
