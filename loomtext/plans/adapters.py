"""The test tables as the engine's inputs: events as evidence, conversations as blocks, orders as scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event with two different characters."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('m', (event_id div 10) % 7)").alias("manuscript_id"),
        F.expr("event_id div 10").alias("scene_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence_id"),
        F.col("event_id").alias("narrative_order"),
        F.concat(F.lit("c"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("character_a_id"),
        F.concat(F.lit("c"), F.lpad((F.col("event_id") % 12).cast("string"), 2, "0")).alias("character_b_id"),
        F.col("event_type").alias("rel_type"),
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 4).cast("string")).alias("descriptor"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string"))).alias("role_a"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string"))).alias("role_b"),
        F.when(F.col("event_id") % 3 == 0, "extracted").otherwise("inferred").alias("provenance"),
        ((F.floor("value").cast("long") % 100) / 100.0).alias("confidence"),
    ).where("character_a_id <> character_b_id")


RELATION_EVIDENCE = """
ev AS (
  SELECT 'm' || ((event_id // 10) % 7) AS manuscript_id, event_id // 10 AS scene_id, 'e' || event_id AS evidence_id, event_id AS narrative_order,
    'c' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS a0, 'c' || lpad(CAST(event_id % 12 AS VARCHAR), 2, '0') AS b0, event_type AS rel_type,
    event_type || '-' || (event_id % 4) AS descriptor,
    CASE WHEN event_id % 7 = 0 THEN 'r' || (event_id % 3) END AS ra, CASE WHEN event_id % 11 = 0 THEN 's' || (event_id % 2) END AS rb,
    CASE WHEN event_id % 3 = 0 THEN 'extracted' ELSE 'inferred' END AS provenance,
    (CAST(floor(value) AS BIGINT) % 100) / CAST(100 AS DOUBLE) AS confidence
  FROM events
), ev2 AS (SELECT * FROM ev WHERE a0 <> b0)"""


def casts(evidence: DataFrame) -> DataFrame:
    """Characters of five sixths of the events: some scenes lack some."""
    some = evidence.where("narrative_order % 6 <> 5")
    return some.select("scene_id", F.col("character_a_id").alias("character_id")).union(some.select("scene_id", "character_b_id")).distinct()


CASTS = """
sc AS (SELECT scene_id, a0 AS c FROM ev2 WHERE narrative_order % 6 <> 5 UNION SELECT scene_id, b0 FROM ev2 WHERE narrative_order % 6 <> 5)"""

#: Evidence within the cast, in canonical order, the strongest of each scene and pair.
KEPT_EVIDENCE = f"""{RELATION_EVIDENCE},{CASTS},
kept AS (
  SELECT * FROM (
    SELECT manuscript_id, scene_id, evidence_id, narrative_order, least(a0, b0) AS a, greatest(a0, b0) AS b, rel_type, descriptor,
      CASE WHEN a0 > b0 THEN rb ELSE ra END AS role_a, CASE WHEN a0 > b0 THEN ra ELSE rb END AS role_b, provenance, confidence,
      row_number() OVER (PARTITION BY scene_id, least(a0, b0), greatest(a0, b0) ORDER BY confidence DESC, narrative_order) AS rk
    FROM ev2 WHERE (scene_id, a0) IN (SELECT scene_id, c FROM sc) AND (scene_id, b0) IN (SELECT scene_id, c FROM sc)
  ) WHERE rk = 1
)"""

RELATION_MAP = """
ty AS (
  SELECT manuscript_id, a, b, rel_type, sum(CASE WHEN provenance = 'extracted' THEN 2 ELSE 1 END) AS weight,
    max(CASE WHEN provenance = 'extracted' THEN narrative_order END) AS last_x, max(narrative_order) AS last_o, max(confidence) AS confidence,
    arg_max(descriptor, {'c': confidence, 'o': -narrative_order}) AS descriptor,
    count(DISTINCT role_a) AS na, count(DISTINCT role_b) AS nb, max(role_a) AS role_a, max(role_b) AS role_b
  FROM kept GROUP BY ALL
), win AS (
  SELECT *, row_number() OVER (PARTITION BY manuscript_id, a, b ORDER BY weight DESC, (last_x IS NOT NULL) DESC, coalesce(last_x, last_o) DESC) AS rk FROM ty
), allp AS (
  SELECT manuscript_id, a, b, count(*) AS n, arg_min(evidence_id, narrative_order) AS first_id FROM kept GROUP BY ALL
), rel AS (
  SELECT w.manuscript_id, w.a, w.b, w.rel_type, w.descriptor, CASE WHEN na <= 1 AND nb <= 1 THEN role_a END AS role_a, CASE WHEN na <= 1 AND nb <= 1 THEN role_b END AS role_b,
    CASE WHEN last_x IS NOT NULL THEN 'extracted' ELSE 'inferred' END AS provenance, w.confidence, CAST(n AS BIGINT) AS evidence_count, first_id AS first_evidence_id
  FROM win w JOIN allp USING (manuscript_id, a, b) WHERE rk = 1 AND w.confidence >= 0.5
)"""


def attribute_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*map(F.lit, ("eye_color", "hair", "height", "scar", "age", "gender", "status")))
    return table(spark, sf_dir, "events").select(
        F.expr("concat('m', (event_id div 10) % 7)").alias("manuscript_id"),
        F.expr("event_id div 10").alias("scene_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence_id"),
        F.col("event_id").alias("narrative_order"),
        F.concat(F.lit("c"), (F.col("user_id") % 12).cast("string")).alias("character_id"),
        F.get(keys, (F.col("event_id") % 7).cast("int")).alias("key"),
        F.concat("event_type", (F.floor("value").cast("long") % 3).cast("string")).alias("value_norm"),
        ((F.floor("value").cast("long") % 100) / 100.0).alias("confidence"),
    )


ATTRIBUTE_EVIDENCE = """
ae AS (
  SELECT 'm' || ((event_id // 10) % 7) AS manuscript_id, event_id // 10 AS scene_id, 'e' || event_id AS evidence_id, event_id AS narrative_order, 'c' || (user_id % 12) AS character_id,
    ['eye_color', 'hair', 'height', 'scar', 'age', 'gender', 'status'][(event_id % 7) + 1] AS key, event_type || (CAST(floor(value) AS BIGINT) % 3) AS value_norm,
    (CAST(floor(value) AS BIGINT) % 100) / CAST(100 AS DOUBLE) AS confidence
  FROM events
), ak AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, character_id, key ORDER BY confidence DESC, narrative_order) AS rk FROM ae) WHERE rk = 1
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as BLOCK rows: system turns are paratext, every other user turn a heading, some assistant turns separators."""
    kind = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), "heading").when((F.col("role") == "assistant") & (F.col("turn") % 8 == 5), "separator").otherwise("paragraph")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("manuscript_id"), F.col("turn").alias("pos"), kind.alias("kind"), "text", F.when(F.col("role") == "system", "cover").alias("source_role")
    )


BLOCKS = """
bl AS (
  SELECT 'k' || conv_id AS mid, turn AS pos, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'heading' WHEN role = 'assistant' AND turn % 8 = 5 THEN 'separator' ELSE 'paragraph' END AS kind, text,
    CASE WHEN role = 'system' THEN 'cover' END AS source_role
  FROM conversations
), ch0 AS (
  SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY mid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter_run,
    max(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY mid) AS has_heading
  FROM bl WHERE source_role IS NULL
), ch AS (SELECT * FROM ch0 WHERE chapter_run > 0 OR has_heading = 0),
sn AS (
  SELECT *, sum(CASE WHEN kind = 'separator' THEN 1 ELSE 0 END) OVER (PARTITION BY mid, chapter_run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS scene_run FROM ch
), raw AS (
  SELECT mid, chapter_run, scene_run, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS t FROM sn WHERE kind = 'paragraph' GROUP BY ALL
), scn AS (
  SELECT mid, chapter_run, scene_run, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' (\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text,
    CASE WHEN scene_run > 0 THEN 'separator' ELSE 'chapter_start' END AS boundary_reason
  FROM raw
), ord AS (
  SELECT *, CAST(length(text) AS BIGINT) AS char_count, dense_rank() OVER (PARTITION BY mid ORDER BY chapter_run) - 1 AS order_narrative,
    row_number() OVER (PARTITION BY mid, chapter_run ORDER BY scene_run) - 1 AS order_in_chapter, row_number() OVER (PARTITION BY mid ORDER BY chapter_run, scene_run) - 1 AS global_order,
    coalesce(sum(length(text) + 2) OVER (PARTITION BY mid ORDER BY chapter_run, scene_run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset
  FROM scn WHERE text <> ''
), cid AS (SELECT mid, sha256(string_agg(text, chr(10) || chr(10) ORDER BY global_order)) AS content_id FROM ord GROUP BY ALL)"""
