"""Stored layers and what a new run brings: one merge rule a table, and derived rows of the touched manuscripts made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import evidence, reads, upsert

COUNTERS = ("mention_count", "appearance_count", "is_mentioned_only")


def recounted(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """character and appears_in with counters of the mentions and appearances that are there."""
    mentions = reads.mentions_of(tables["mention_node"], tables["has_mention"])
    people, seen = tables["character"].drop(*COUNTERS), tables["appears_in"]
    counted = people.join(evidence.character_counters(people, mentions, seen), "character_id")
    return tables | {"character": counted.select(*tables["character"].columns), "mention": mentions, "appears_in": evidence.appearance_counters(seen, mentions)}


def merged_characters(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The character layer after a run over some scenes; running it again changes nothing.

    Characters are updated by their rules; a mention is made once and keeps its fields; its edges add up; an appearance that is
    present stays so; a merge candidate keeps the decision it has. Counters are counted again.
    """
    return recounted({
        "character": upsert.upserted_characters(old["character"], new["character"]),
        "mention_node": upsert.inserted(old["mention_node"], new["mention_node"], ["mention_id"]),
        "has_mention": old["has_mention"].unionByName(new["has_mention"]).distinct(),
        "appears_in": upsert.upserted_appearances(old["appears_in"], new["appears_in"]),
        "merge_candidate": upsert.inserted(old["merge_candidate"], new["merge_candidate"], ["candidate_id"]),
    })


def accepted_merges(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The character layer after its accepted merge candidates: b becomes a, chains are followed, mentions and appearances move."""
    merges = tables["merge_candidate"].where("status = 'accepted'").select(F.col("character_b_id").alias("from_id"), F.col("character_a_id").alias("to_id"))
    people, edges, seen = upsert.accepted(tables["character"], tables["has_mention"], tables["appears_in"], merges)
    return recounted(tables | {"character": people, "has_mention": edges, "appears_in": seen})


def merged_relations(old: dict[str, DataFrame], new: DataFrame, touched: DataFrame) -> dict[str, DataFrame]:
    """relation_evidence with the latest of each id, and relates_to with the rows of touched manuscripts made again from it."""
    rows = upsert.upserted(old["relation_evidence"], new.select(*old["relation_evidence"].columns), ["evidence_id"])
    again = evidence.relation_map(rows.join(touched.select("manuscript_id").distinct(), "manuscript_id", "left_semi"))
    return {"relation_evidence": rows, "relates_to": upsert.replaced(old["relates_to"], again.select(*old["relates_to"].columns), touched)}
