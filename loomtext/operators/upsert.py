"""Keyed tables as whole DataFrames: upsert, insert only, replace, merge, delete.

File tables have no MERGE INTO, so each operation returns the new table; write it with write_manuscripts(), which
overwrites only the partitions it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.errors import CandidateNotFound, CandidateResolved, InvalidDecision
from loomtext.operators.components import final_targets
from loomtext.sources.staging import staged


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and old ones whose key is not among them. Of several new rows of a key, the caller keeps one."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, manuscripts: DataFrame, owner: str = "manuscript_id") -> DataFrame:
    """Derived rows of the given manuscripts rewritten, also where they have none any more."""
    return old.join(manuscripts.select(owner).distinct(), owner, "left_anti").unionByName(new)


def upserted_characters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases are overwritten, a role fills only an unknown one, is_mentioned_only can only turn false; the rest is set once."""
    o, n = old.alias("o"), new.alias("n")
    both = F.col("o.character_id").isNotNull() & F.col("n.character_id").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    merged = {
        "aliases": F.coalesce(F.col("n.aliases"), F.col("o.aliases")).alias("aliases"),
        "role": F.when(both & (F.col("o.role") == "unknown"), F.col("n.role")).otherwise(F.coalesce(F.col("o.role"), F.col("n.role"))).alias("role"),
        "is_mentioned_only": F.when(both, F.col("o.is_mentioned_only") & F.col("n.is_mentioned_only")).otherwise(F.coalesce(F.col("o.is_mentioned_only"), F.col("n.is_mentioned_only"))).alias("is_mentioned_only"),
    }
    return o.join(n, F.col("o.character_id") == F.col("n.character_id"), "full").select(*[merged.get(c, pick(c)) for c in old.columns])


def upserted_appearances(old: DataFrame, new: DataFrame) -> DataFrame:
    """A present appearance stays present."""
    kind = F.when(F.max((F.col("kind") == "present").cast("int")) == 1, "present").otherwise("mentioned")
    return old.select("character_id", "scene_id", "kind").unionByName(new.select("character_id", "scene_id", "kind")).groupBy("character_id", "scene_id").agg(kind.alias("kind"))


def moved(rows: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Rows with merged characters' ids rewritten; merges are rows (from_id, to_id)."""
    m = merges.select(F.col("from_id").alias(column), "to_id")
    return rows.join(m, column, "left").withColumn(column, F.coalesce("to_id", column)).drop("to_id")


def accepted(characters: DataFrame, mention_edges: DataFrame, appearances: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Characters, mention edges and appearances after merging from_id into to_id, all accepted merges of a batch at once.

    Merges that chain are followed to their end (final_targets()), so nothing is left with an id that is gone. Mentions move, appearances in one scene are added up and keep the target's kind, the target takes over names and
    aliases and remembers whom it absorbed. Counters are for evidence.character_counters() to recompute.
    """
    merges = staged(final_targets(merges), "targets").hint("merge")  # its files are far smaller than what a broadcast would send
    b = characters.join(merges.withColumnRenamed("from_id", "character_id"), "character_id")
    gone = b.groupBy(F.col("to_id").alias("character_id")).agg(
        F.flatten(F.collect_list(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array())))).alias("more"), F.array_sort(F.collect_set(F.col("character_id").cast("string"))).alias("absorbed")
    )
    merged_from = F.col("merged_from") if "merged_from" in characters.columns else F.array().cast("array<string>")
    left = characters.join(merges.select(F.col("from_id").alias("character_id")), "character_id", "left_anti").join(gone, "character_id", "left")
    aliases = F.array_sort(F.array_except(F.array_union(F.coalesce("aliases", F.array()), F.coalesce("more", F.array().cast("array<string>"))), F.array("canonical_name")))
    people = left.withColumn("aliases", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(aliases)).withColumn("merged_from", F.array_union(F.coalesce(merged_from, F.array().cast("array<string>")), F.coalesce("absorbed", F.array().cast("array<string>")))).drop("more", "absorbed")
    own = appearances.join(merges.select(F.col("from_id").alias("character_id"), F.lit(False).alias("kept")), "character_id", "left")
    own = moved(own.withColumn("own", F.coalesce("kept", F.lit(True))).drop("kept"), "character_id", merges)
    seen = own.groupBy("character_id", "scene_id").agg(F.max_by("kind", F.struct("own", (F.col("kind") == "present"))).alias("kind"), F.sum("mention_count").alias("mention_count"))
    return people, moved(mention_edges, "character_id", merges).distinct(), seen


def decided(candidates: DataFrame, candidate_id: str, decision: str, now: Column | None = None) -> DataFrame:
    """The candidates with one accepted or rejected."""
    if decision not in ("accept", "reject"):
        raise InvalidDecision(decision)
    found = candidates.where(F.col("candidate_id") == candidate_id).select("status").take(1)
    if not found:
        raise CandidateNotFound(candidate_id)
    if found[0]["status"] != "pending":
        raise CandidateResolved(candidate_id)
    this = F.col("candidate_id") == candidate_id
    when = now if now is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return candidates.withColumn("status", F.when(this, {"accept": "accepted", "reject": "rejected"}[decision]).otherwise(F.col("status"))).withColumn("resolved_at", F.when(this, when).otherwise(F.col("resolved_at")))


def without(rows: DataFrame, ids: list[str], column: str = "manuscript_id") -> DataFrame:
    """Rows of other manuscripts; an empty list removes nothing."""
    return rows.where(~F.col(column).isin(*ids)) if ids else rows


def write_manuscripts(rows: DataFrame, path: str, owner: str = "manuscript_id") -> None:
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(owner).mode("overwrite").parquet(path)
