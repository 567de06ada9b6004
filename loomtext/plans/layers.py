"""Characters, relations and attributes from stored or fresh model responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import ids, names
from loomtext.functions.text import offset_of
from loomtext.operators import evidence, reads, resolution
from loomtext.schemas import ATTRIBUTES, CHARACTER_ROLES, ENTITY_KINDS, EXTRACTION, MENTION_KINDS, RELATIONS, accepted_and_quarantined, valid_attribute, valid_relation
from loomtext.sources import responses


def keyed(scenes: DataFrame, model: str, prompt: str, schema: str, casts: DataFrame | None = None, least_cast: int = 0) -> DataFrame:
    """Scenes with their cache_key; with casts, only scenes of at least so many people, and their ids are part of it."""
    if casts is None:
        return scenes.withColumn("cache_key", ids.response_key(F.col("text"), prompt, model, schema))
    people = scenes.join(casts, "scene_id").where(F.size("cast") >= least_cast).withColumn("cast_ids", F.transform("cast", lambda c: c["character_id"]))
    return people.withColumn("cache_key", ids.response_key(F.col("text"), prompt, model, schema, F.col("cast_ids")))


def extractions(scenes: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    return responses.looked_up(scenes, stored, EXTRACTION, extraction_contract(), force)


def candidates(extracted: DataFrame) -> DataFrame:
    """CANDIDATE rows and whether the scene has the character present."""
    return extracted.where("response is not null").select("manuscript_id", "scene_id", F.col("order_narrative_global").cast("long").alias("scene_order"), F.posexplode("response.new_characters").alias("pos", "c")).select(
        "manuscript_id", "scene_id", "scene_order", F.col("pos").cast("long").alias("pos"), "c.canonical_name", F.coalesce("c.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("c.role", F.lit("unknown")).alias("role"), F.coalesce("c.entity_kind", F.lit("person")).alias("entity_kind"), F.coalesce("c.is_present_in_scene", F.lit(False)).alias("present"),
    )


def character_layer(extracted: DataFrame, decisions: DataFrame | None = None, judgements: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> dict[str, DataFrame]:
    """character, mention_node, has_mention, mention (both joined), appears_in and merge_candidate rows of the extracted scenes.

    Names are linked at their scene: to the character that the form stood for when the scene's own candidates had been
    resolved, also where another character takes the form over later. A mention that two characters claim is one node with two edges. keep (staging.staged, say) writes what several of the tables derive from: the fold is then made once.
    """
    asked = candidates(extracted)
    outcome = keep(resolution.resolved(asked.drop("scene_id", "present"), decisions, judgements), "resolved")
    found = asked.join(outcome.select("manuscript_id", "scene_order", "pos", "resolved_name", "outcome", "confidence", "rationale", "known_aliases"), ["manuscript_id", "scene_order", "pos"])
    named = found.where("outcome <> 'filtered'").withColumn("entity", F.when(F.col("outcome") == "queued", F.col("canonical_name")).otherwise(F.col("resolved_name")))
    entity_id = ids.character_id(F.col("manuscript_id"), names.fold(F.col("entity")))
    first = F.struct("scene_order", "pos")
    known_role = F.when(F.col("role") != "unknown", F.col("role"))
    people = named.groupBy("manuscript_id", "entity").agg(
        F.array_sort(F.max_by("known_aliases", first)).alias("aliases"), F.coalesce(F.min_by(known_role, F.when(known_role.isNotNull(), first)), F.lit("unknown")).alias("role"),
        F.min_by("entity_kind", first).alias("entity_kind"), F.min_by("scene_id", first).alias("first_scene_id"),
    )
    characters = keep(people, "people").select(entity_id.alias("character_id"), "manuscript_id", F.col("entity").alias("canonical_name"), "aliases", "role", "entity_kind", "first_scene_id")
    history = resolution.form_history(outcome)

    def linked(rows: DataFrame, name: Column) -> DataFrame:
        """Rows (manuscript_id, scene_order, ...) with the character that the name stands for at the end of their scene."""
        split = rows.withColumn("s", names.split_honorific(names.fold(name))).withColumns({"base": F.col("s.base"), "honorific": F.col("s.honorific")})
        known = resolution.lookup_at(split, history).where("canonical is not null")
        return known.withColumn("character_id", ids.character_id(F.col("manuscript_id"), names.fold(F.col("canonical")))).drop("s", "base", "honorific", "canonical")

    answered = extracted.where("response is not null").withColumn("scene_order", F.col("order_narrative_global").cast("long"))
    told = answered.select("manuscript_id", "scene_id", "scene_order", "text", F.posexplode("response.mentions").alias("nth", "m")).withColumn("start_offset", offset_of(F.col("text"), F.col("m.surface"))).where("start_offset is not null").drop("text")
    said = keep(linked(told, F.coalesce(F.nullif("m.links_to", F.lit("")), "m.surface")).select(
        ids.mention_id(F.col("scene_id"), F.col("m.surface"), F.col("start_offset")).alias("mention_id"), "character_id", "scene_id", "manuscript_id", "m.surface", "m.kind", "start_offset",
        (F.col("start_offset") + F.length("m.surface")).alias("end_offset"), "m.quote", "nth",
    ), "said")
    fields = ["scene_id", "manuscript_id", "surface", "kind", "start_offset", "end_offset", "quote"]
    nodes = said.groupBy("mention_id").agg(F.min(F.struct("nth", *fields)).alias("x")).select("mention_id", *[f"x.{c}" for c in fields])
    edges = said.select("manuscript_id", "character_id", "mention_id").distinct()
    mentions = reads.mentions_of(nodes, edges)
    listed = linked(answered.select("manuscript_id", "scene_id", "scene_order", F.explode("response.present_entities").alias("name")), F.col("name")).select("character_id", "scene_id", F.lit("present").alias("kind"))
    came = named.where("present").select(entity_id.alias("character_id"), "scene_id", F.lit("present").alias("kind"))
    seen = mentions.select("character_id", "scene_id", F.lit("mentioned").alias("kind")).unionAll(listed).unionAll(came)
    appearances = keep(seen, "seen").groupBy("character_id", "scene_id").agg(F.when(F.max((F.col("kind") == "present").cast("int")) == 1, "present").otherwise("mentioned").alias("kind"))
    queued = found.where("outcome = 'queued'")
    person = lambda c: ids.character_id(F.col("manuscript_id"), names.fold(F.col(c)))
    merges = queued.select(ids.merge_candidate_id(person("resolved_name"), person("canonical_name")).alias("candidate_id"), "manuscript_id", person("resolved_name").alias("character_a_id"), person("canonical_name").alias("character_b_id"), F.col("resolved_name").alias("name_a"), F.col("canonical_name").alias("name_b"), "confidence", "rationale", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("resolved_at"))
    counted = characters.join(evidence.character_counters(characters, mentions, appearances), "character_id")
    tables = {"character": counted, "mention": mentions, "mention_node": nodes, "has_mention": edges, "appears_in": evidence.appearance_counters(appearances, mentions), "merge_candidate": merges.dropDuplicates(["candidate_id"])}
    return accepted_and_quarantined(tables, keep)


def _evidences(looked: DataFrame, columns: list[str]) -> DataFrame:
    return looked.where("response is not null").select("manuscript_id", "scene_id", "cast_ids", F.col("order_narrative_global").alias("narrative_order"), F.posexplode("response.evidences").alias("pos", "e")).select("manuscript_id", "scene_id", "cast_ids", "narrative_order", "pos", "e", *[f"e.{c}" for c in columns])


def relation_contract() -> Column:
    return F.col("response.evidences").isNotNull() & F.forall("response.evidences", valid_relation)


def attribute_contract() -> Column:
    return F.col("response.evidences").isNotNull() & F.forall("response.evidences", valid_attribute)


def extraction_contract() -> Column:
    """Lists that are there, closed values, and the texts that every mention and character has; one that breaks it breaks the response."""
    said = lambda m: m["kind"].isin(*MENTION_KINDS) & m["surface"].isNotNull() & m["quote"].isNotNull()
    new = lambda c: c["canonical_name"].isNotNull() & F.coalesce(c["role"], F.lit("unknown")).isin(*CHARACTER_ROLES) & F.coalesce(c["entity_kind"], F.lit("person")).isin(*ENTITY_KINDS)
    return F.coalesce(F.forall("response.mentions", said) & F.forall("response.new_characters", new), F.lit(False))


def relations_looked_up(scenes: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    return responses.looked_up(scenes, stored, RELATIONS, relation_contract(), force)


def attributes_looked_up(scenes: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    return responses.looked_up(scenes, stored, ATTRIBUTES, attribute_contract(), force)


def relation_layer(scenes: DataFrame, stored: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    return relation_tables(relations_looked_up(scenes, stored, force))


def relation_tables(looked: DataFrame) -> dict[str, DataFrame]:
    """relation_evidence and relates_to from keyed() scenes with responses: inside the cast, one evidence a scene and pair."""
    rows = _evidences(looked, ["character_a_id", "character_b_id", "rel_type", "descriptor", "role_a", "role_b", "provenance", "confidence", "quote"])
    inside = rows.where(F.array_contains("cast_ids", F.col("character_a_id")) & F.array_contains("cast_ids", F.col("character_b_id"))).drop("e", "cast_ids")
    kept = evidence.strongest(evidence.canonical(inside), ["scene_id", "character_a_id", "character_b_id"], "pos")
    named = kept.withColumn("evidence_id", ids.relation_evidence_id(F.col("scene_id"), F.col("character_a_id"), F.col("character_b_id"))).drop("pos")
    checked = accepted_and_quarantined({"relation_evidence": named})
    return checked | {"relates_to": evidence.relation_map(checked["relation_evidence"])}


def attribute_layer(scenes: DataFrame, stored: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    return attribute_tables(attributes_looked_up(scenes, stored, force))


def attribute_tables(looked: DataFrame) -> dict[str, DataFrame]:
    rows = _evidences(looked, ["character_id", "key", "value_norm", "value_quote", "confidence"])
    inside = rows.where(F.array_contains("cast_ids", F.col("character_id"))).drop("e", "cast_ids").withColumn("value_norm", F.lower(F.trim("value_norm")))
    kept = evidence.strongest(inside, ["scene_id", "character_id", "key"], "pos")
    named = kept.withColumn("evidence_id", ids.attribute_evidence_id(F.col("scene_id"), F.col("character_id"), F.col("key"))).drop("pos")
    checked = accepted_and_quarantined({"attribute_evidence": named})
    sheet = evidence.attribute_sheet(checked["attribute_evidence"])
    return checked | {"attribute": sheet.withColumn("attribute_id", ids.attribute_id(F.col("character_id"), F.col("key"), F.col("value_norm")))}


def run_counters(looked: DataFrame) -> DataFrame:
    """Scenes, cache hits and misses of each manuscript."""
    return looked.groupBy("manuscript_id").agg(F.count("*").alias("scenes"), F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("misses"))
