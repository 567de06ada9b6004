"""Evaluation of the character, relation and attribute layers against gold rows of one or more works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.errors import InconsistentGold, NotMeasured
from loomtext.functions.characters import case_folded
from loomtext.functions.ids import canonical_pair
from loomtext.functions.names import fold
from loomtext.functions.ratios import accuracy
from loomtext.functions.text import strip
from loomtext.operators import matching, metrics
from loomtext.operators.ranking import ranked
from loomtext.operators.reads import scene_coordinates
from loomtext.schemas import GATE_KEYS
from loomtext.sources.gold import measured
from loomtext.sources.staging import staged


def folded_names(entities: DataFrame) -> DataFrame:
    """Rows (work, ident, order) with each folded name of theirs, from canonical_name and aliases."""
    every = F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entities.select("work", "ident", "order", every.alias("name")).withColumn("name", fold(F.col("name"))).where("name <> ''").distinct()


def people(characters: DataFrame) -> DataFrame:
    """Predicted entities as (work, ident, order, canonical_name, aliases), animals left out; an empty list is an error."""
    kept = measured(characters, "characters").where(F.coalesce("entity_kind", F.lit("person")) != "animal")
    return kept.select(F.col("manuscript_id").alias("work"), F.col("character_id").alias("ident"), F.struct("canonical_name", "character_id").alias("order"), "canonical_name", "aliases")


def placed(entities: DataFrame) -> DataFrame:
    """(work, ident, place): the place of each entity in the list of its work."""
    return ranked(entities.select("work", "ident", "order").distinct(), [F.col("order"), F.col("ident")], ("work",)).select("work", "ident", "place")


def matched(first: DataFrame, second: DataFrame) -> DataFrame:
    """(work, first, second): entities of the first list in order take the first free one of the second that shares a folded name."""
    a, b = staged(placed(first), "places"), staged(placed(second), "places")
    side = lambda places, rows, c: folded_names(rows).select("work", "ident", "name").join(places, ["work", "ident"]).select("work", "name", F.col("place").alias(c))
    found = matching.greedy(side(a, first, "x"), side(b, second, "y"), "work")
    back = lambda places, c, name: places.select("work", F.col("place").alias(c), F.col("ident").alias(name))
    return found.join(back(a, "x", "first"), ["work", "x"]).join(back(b, "y", "second"), ["work", "y"]).select("work", "first", "second")


def detection(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """precision, recall, f1 a work; predictions in list order take the first free gold entity."""
    return metrics.detection(gold, predicted, matched(predicted, gold), "work")


def alignment(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(work, gold, pred): gold entities in order take the first free prediction."""
    return matched(gold, predicted).withColumnsRenamed({"first": "gold", "second": "pred"})


def mention_clusters(mentions: DataFrame, scenes: DataFrame) -> DataFrame:
    """key and cluster of predicted mentions: coordinate and folded surface; resolved pronouns and unknown scenes don't count."""
    named = mentions.where(F.coalesce("kind", F.lit("name")) != "pronoun_resolved").join(scene_coordinates(scenes), "scene_id")
    return named.select(F.concat_ws("::", "coordinate", strip(case_folded(F.col("surface")))).alias("key"), F.col("character_id").alias("cluster")).distinct()


def gold_clusters(characters: DataFrame) -> DataFrame:
    """key and cluster of annotated mentions (gold_id, mentions)."""
    told = characters.select("gold_id", F.explode("mentions").alias("m"))
    return told.select(F.concat_ws("::", "m.scene", strip(case_folded(F.col("m.surface")))).alias("key"), F.col("gold_id").alias("cluster")).distinct()


def annotated_clusters(characters: DataFrame) -> DataFrame | None:
    """gold_clusters() of a work whose characters all have mentions; None if none has, an error if only some have."""
    with_, all_ = characters.agg(F.count("mentions"), F.count("*")).first()
    if not with_:
        return None
    if with_ != all_:
        raise InconsistentGold(", ".join(r.gold_id for r in characters.where("mentions is null").select("gold_id").orderBy("gold_id").take(5)))
    return gold_clusters(characters)


def resolution_scores(characters: DataFrame, mentions: DataFrame, scenes: DataFrame) -> DataFrame | None:
    """B-cubed scores of predicted mentions against annotated ones; None where the gold has no mentions, an error where there are
    no scenes to have coordinates of."""
    told = annotated_clusters(characters)
    measured(scenes, "scene coordinates")
    return None if told is None else metrics.bcubed(told, mention_clusters(mentions, scenes))


def first_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(work, gold, pred): for each gold entity the first prediction in list order whose names meet, taken or not."""
    least = folded_names(predicted).groupBy("work", "name").agg(F.min(F.struct("order", "ident")).alias("pred"))
    return folded_names(gold).join(least, ["work", "name"]).groupBy("work", F.col("ident").alias("gold")).agg(F.min("pred")["ident"].alias("pred"))


def silent_bad_merges(gold: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(work, x, y, pred): gold entities without a common name that became one prediction, no candidate of theirs covering it.

    candidates: (work, a, b), structs of canonical_name and aliases, of any status. First matches of one prediction are
    compared with each other only, so a prediction that swallowed many gold entities gives as many pairs as it deserves.
    """
    first = first_matches(gold, predicted)
    x, y = first.select("work", "pred", F.col("gold").alias("x")), first.select("work", "pred", F.col("gold").alias("y"))
    one = x.join(y, ["work", "pred"]).where("x < y")
    mine = folded_names(gold).select("work", "ident", "name")
    alike = mine.withColumnRenamed("ident", "x").join(mine.withColumnRenamed("ident", "y"), ["work", "name"]).where("x < y").select("work", "x", "y").distinct()
    every = lambda c: F.explode(F.array_union(F.array(f"{c}.canonical_name"), F.coalesce(f"{c}.aliases", F.array().cast("array<string>"))))
    numbered = candidates.distinct().withColumn("n", F.xxhash64("work", "a", "b"))
    touched = lambda c: numbered.select("work", "n", every(c).alias("name")).withColumn("name", fold(F.col("name"))).where("name <> ''").join(mine, ["work", "name"]).select("work", "n", F.col("ident").alias(c)).distinct()
    known = touched("a").join(touched("b"), ["work", "n"]).where("a <> b").select("work", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return one.join(alike, ["work", "x", "y"], "left_anti").join(known, ["work", "x", "y"], "left_anti").select("work", "x", "y", "pred")


def segmentation(annotations: DataFrame, scenes: DataFrame) -> DataFrame:
    """manuscript_id, chapter_accuracy and separator_accuracy, from (manuscript_id, expected_chapters, expected_separators)."""
    found = scenes.groupBy("manuscript_id").agg(F.count_distinct("order_narrative").alias("chapters"), F.count_if(F.col("boundary_reason") == "separator").alias("separators"))
    rows = annotations.join(found, "manuscript_id", "left")
    score = lambda c: accuracy(F.coalesce(c, F.lit(0)), F.col(f"expected_{c}"))
    return rows.select("manuscript_id", score("chapters").alias("chapter_accuracy"), score("separators").alias("separator_accuracy"))


def skipped_or_failed(reason: str, strict: str | None) -> str:
    """The reason to skip a gate that can't be measured; an error if strict is exactly "1"."""
    if strict == "1":
        raise NotMeasured(reason)
    return reason


def relations(gold: DataFrame, relates_to: DataFrame, aligned: DataFrame) -> DataFrame:
    """relation_metrics of one work; gold pairs without a counterpart stay and are misses."""
    to = lambda c: aligned.select(F.col("gold").alias(c), F.col("pred").alias(f"{c}_id"))
    named = gold.join(to("a"), "a", "left").join(to("b"), "b", "left")
    x, y = F.coalesce("a_id", F.concat(F.lit("gold:"), "a")), F.coalesce("b_id", F.concat(F.lit("gold:"), "b"))
    low, high = canonical_pair(x, y)
    pairs = named.select(low.alias("a"), high.alias("b"), "rel_type", "provenance")
    low, high = canonical_pair(F.col("character_a_id"), F.col("character_b_id"))
    return metrics.relation_metrics(pairs, relates_to.select(low.alias("a"), high.alias("b"), "rel_type", "provenance"))


def attributes(gold: DataFrame, sheet: DataFrame, aligned: DataFrame, gate_only: bool = True) -> DataFrame:
    """attribute_metrics of one work, over the keys of the gate or over all."""
    named = gold.join(aligned.select(F.col("gold").alias("character"), "pred"), "character", "left")
    g = named.select(F.coalesce("pred", F.concat(F.lit("gold:"), "character")).alias("character"), "key", "value_norm", F.col("class").alias("attr_class"))
    p = sheet.select(F.col("character_id").alias("character"), "key", "value_norm", "attr_class")
    inside = lambda d: d.where(F.col("key").isin(*GATE_KEYS)) if gate_only else d
    return metrics.attribute_metrics(inside(g), inside(p))
