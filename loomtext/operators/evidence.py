"""Evidence rows and the facts derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.schemas import key_class

LEAST_CONFIDENCE = 0.5


def within_cast(evidence: DataFrame, cast: DataFrame, *characters: str) -> DataFrame:
    """Evidence whose characters all belong to the scene's cast (scene_id, character_id)."""
    for c in characters:
        evidence = evidence.join(cast.select("scene_id", F.col("character_id").alias(c)).distinct(), ["scene_id", c], "left_semi")
    return evidence


def canonical(evidence: DataFrame) -> DataFrame:
    """Pairs in code-point order, roles swapped along."""
    swap = F.col("character_a_id") > F.col("character_b_id")
    both = lambda a, b: (F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a), F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b))
    moved = {*("character_a_id", "character_b_id", "role_a", "role_b")}
    return evidence.select(*[c for c in evidence.columns if c not in moved], *both("character_a_id", "character_b_id"), *both("role_a", "role_b"))


def strongest(evidence: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row a key: the highest confidence, the first on ties."""
    rank = Window.partitionBy(*key).orderBy(F.desc("confidence"), pos)
    return evidence.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def relation_map(evidence: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """RELATES_TO rows: one a pair, by weighted vote of its evidence.

    Extracted evidence weighs 2, inferred 1; the type of most weight wins, ties go to a type with extracted evidence,
    then to the one whose evidence (extracted if it has any) is latest. Descriptor and confidence are those of the
    winner's most confident evidence, the first on ties; pairs under `least` have no row. evidence_count and
    first_evidence_id are over all types. Roles stand where no two evidences of the winner disagree on either.
    """
    pair = ["manuscript_id", "character_a_id", "character_b_id"]
    extracted = F.col("provenance") == "extracted"
    strongest_of = lambda c: F.max_by(c, F.struct("confidence", -F.col("narrative_order")))
    distinct = lambda c: F.array_size(F.collect_set(c))
    by_type = evidence.groupBy(*pair, "rel_type").agg(
        F.sum(F.when(extracted, 2).otherwise(1)).alias("weight"),
        F.max(F.when(extracted, F.col("narrative_order"))).alias("last_extracted"),
        F.max("narrative_order").alias("last"),
        F.max("confidence").alias("confidence"),
        strongest_of("descriptor").alias("descriptor"),
        (distinct("role_a") + 0).alias("roles_a"),
        (distinct("role_b") + 0).alias("roles_b"),
        F.max("role_a").alias("role_a"),
        F.max("role_b").alias("role_b"),
        F.count("*").alias("n"),
        F.min(F.struct("narrative_order", "evidence_id")).alias("first"),
    )
    rank = F.struct("weight", F.col("last_extracted").isNotNull().alias("sure"), F.coalesce("last_extracted", "last").alias("latest"))
    columns = [c for c in by_type.columns if c not in (*pair, "n", "first")]
    won = by_type.groupBy(*pair).agg(F.max_by(F.struct(*columns), rank).alias("w"), F.sum("n").alias("evidence_count"), F.min("first").alias("first"))
    agreed = (F.col("w.roles_a") <= 1) & (F.col("w.roles_b") <= 1)
    return won.where(F.col("w.confidence") >= least).select(
        *pair,
        "w.rel_type",
        "w.descriptor",
        F.when(agreed, F.col("w.role_a")).alias("role_a"),
        F.when(agreed, F.col("w.role_b")).alias("role_b"),
        F.when(F.col("w.last_extracted").isNotNull(), "extracted").otherwise("inferred").alias("provenance"),
        "w.confidence",
        "evidence_count",
        F.col("first.evidence_id").alias("first_evidence_id"),
    )


def attribute_sheet(evidence: DataFrame) -> DataFrame:
    """ATTRIBUTE rows: one a (character, key, value); contradictions stay side by side."""
    return evidence.groupBy("manuscript_id", "character_id", "key", "value_norm").agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("evidence_count"), F.min_by("evidence_id", F.struct("narrative_order", "evidence_id")).alias("first_evidence_id")
    ).withColumn("attr_class", key_class("key"))


def character_counters(characters: DataFrame, mentions: DataFrame, appearances: DataFrame) -> DataFrame:
    """character_id, mention_count, appearance_count, is_mentioned_only, recomputed from the rows they count."""
    said = mentions.groupBy("character_id").agg(F.count("*").alias("mention_count"))
    seen = appearances.groupBy("character_id").agg(F.count("*").alias("appearance_count"), F.count_if(F.col("kind") == "present").alias("present"))
    return (
        characters.select("character_id")
        .join(said, "character_id", "left")
        .join(seen, "character_id", "left")
        .select("character_id", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("appearance_count", F.lit(0)).alias("appearance_count"), (F.coalesce("present", F.lit(0)) == 0).alias("is_mentioned_only"))
    )


def appearance_counters(appearances: DataFrame, mentions: DataFrame) -> DataFrame:
    """Appearances with the count and the first of their mentions by place; without mentions an old first one stays."""
    per = mentions.groupBy("character_id", "scene_id").agg(F.count("*").alias("n"), F.min_by("mention_id", F.struct("start_offset", "mention_id")).alias("first"))
    kept = [c for c in appearances.columns if c not in ("mention_count", "first_mention_id")]
    old = F.col("first_mention_id") if "first_mention_id" in appearances.columns else F.lit(None).cast("string")
    return appearances.join(per, ["character_id", "scene_id"], "left").select(*kept, F.coalesce("n", F.lit(0)).alias("mention_count"), F.coalesce(F.col("first"), old).alias("first_mention_id"))


def scene_casts(appearances: DataFrame, characters: DataFrame) -> DataFrame:
    """scene_id and its cast, ordered by name: present or mentioned, animals left out."""
    people = characters.where(F.coalesce("entity_kind", F.lit("person")) == "person").select("character_id", "canonical_name")
    members = F.array_sort(F.collect_list(F.struct("canonical_name", "character_id")))
    return appearances.select("scene_id", "character_id").distinct().join(people, "character_id").groupBy("scene_id").agg(members.alias("cast"))


def first_appearances(appearances: DataFrame, scenes: DataFrame, mentions: DataFrame) -> DataFrame:
    """character_id with the first scene in narrative order and the quote of its first mention there."""
    quotes = mentions.groupBy("character_id", "scene_id").agg(F.min_by("quote", F.struct("start_offset", "mention_id")).alias("quote"))
    first = appearances.join(scenes.select("scene_id", "order_narrative_global"), "scene_id").groupBy("character_id").agg(F.min(F.struct("order_narrative_global", "scene_id")).alias("x"))
    return first.select("character_id", "x.scene_id", "x.order_narrative_global").join(quotes, ["character_id", "scene_id"], "left")


def top_quotes(mentions: DataFrame, order: Column, k: int = 3) -> DataFrame:
    """The first k non-empty quotes of each character."""
    rank = Window.partitionBy("character_id").orderBy(order, "mention_id")
    return mentions.where("quote is not null and quote <> ''").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
