"""Queries of stored tables and of evaluation over the test tables that grow, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext import schemas
from loomtext.operators import evidence, reads, upsert
from loomtext.operators.ranking import ranked
from loomtext.plans import adapters as A
from loomtext.plans import evaluation, graph
from loomtext.plans.catalogue import query


@query(
    "q70_rejected_candidate",
    "SELECT 'c' || doc_id AS candidate_id, CASE WHEN doc_id = 3 THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 3 = 1 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN doc_id = 3 THEN 'now' WHEN doc_id % 3 <> 0 THEN 'then' END AS resolved_at FROM documents",
)
def rejected_candidate(spark, sf_dir):
    k = F.col("doc_id")
    rows = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), F.when(k % 3 == 0, "pending").when(k % 3 == 1, "accepted").otherwise("rejected").alias("status"), F.when(k % 3 != 0, "then").alias("resolved_at"))
    return upsert.decided(rows, "c3", "reject", F.lit("now"))


_EVIDENCE = """e0 AS (SELECT 'm' || doc_id % 50 AS manuscript_id, 'e' || doc_id AS evidence_id, doc_id AS narrative_order, n_chars % 5 AS x, n_chars // 5 % 5 AS y, lang AS rel_type, 'd' || doc_id % 4 AS descriptor, NULL::VARCHAR AS role_a, NULL::VARCHAR AS role_b,
  CASE WHEN doc_id % 3 = 0 THEN 'extracted' ELSE 'inferred' END AS provenance, n_chars % 100 / CAST(100 AS DOUBLE) AS confidence FROM documents),
ev AS (SELECT *, 'c' || least(x, y) AS a, 'c' || greatest(x, y) AS b FROM e0 WHERE x <> y)"""


@query(
    "q71_latest_evidence",
    f"""WITH {_EVIDENCE}, merged AS (SELECT * FROM ev WHERE narrative_order % 4 <> 1 OR manuscript_id >= 'm3'),
kept AS (SELECT * REPLACE (CASE WHEN narrative_order % 4 = 0 AND manuscript_id < 'm3' THEN 'again' ELSE rel_type END AS rel_type) FROM merged WHERE manuscript_id < 'm3'),
{A.RELATION_MAP.strip()} SELECT manuscript_id, a AS character_a_id, b AS character_b_id, rel_type, provenance, confidence, evidence_count, first_evidence_id FROM rel
UNION ALL SELECT manuscript_id, a, b, 'stored', NULL, NULL, 0, NULL FROM (SELECT DISTINCT manuscript_id, a, b FROM ev WHERE manuscript_id >= 'm3')""",
)
def latest_evidence(spark, sf_dir):
    """A second run over some manuscripts: the latest evidence of an id counts, and only their relations are made again."""
    d, n = A.table(spark, sf_dir, "documents"), F.col("n_chars")
    x, y = (n % 5).cast("string"), (F.floor(n / 5) % 5).cast("string")
    none = F.lit(None).cast("string")
    rows = d.where(x != y).select(
        F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string")).alias("manuscript_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"), F.col("doc_id").alias("narrative_order"), F.concat(F.lit("c"), F.least(x, y)).alias("character_a_id"),
        F.concat(F.lit("c"), F.greatest(x, y)).alias("character_b_id"), F.col("lang").alias("rel_type"), F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string")).alias("descriptor"), none.alias("role_a"), none.alias("role_b"),
        F.when(F.col("doc_id") % 3 == 0, "extracted").otherwise("inferred").alias("provenance"), ((n % 100) / 100.0).alias("confidence"),
    )
    touched = F.col("manuscript_id") < "m3"
    first = rows.where((F.col("narrative_order") % 4 != 1) | ~touched)
    pairs = rows.where(~touched).select("manuscript_id", "character_a_id", "character_b_id").distinct()
    shape = evidence.relation_map(rows)
    held = {"rel_type": F.lit("stored"), "evidence_count": F.lit(0).cast("long")}
    stored = pairs.select(*[(held[c] if c in held else F.col(c) if c in pairs.columns else F.lit(None).cast(shape.schema[c].dataType)).alias(c) for c in shape.columns])
    again = rows.where((F.col("narrative_order") % 4 == 0) & touched).withColumn("rel_type", F.lit("again"))
    merged = graph.merged_relations({"relation_evidence": first, "relates_to": stored}, again, rows.where(touched))
    return merged["relates_to"].select("manuscript_id", "character_a_id", "character_b_id", "rel_type", "provenance", "confidence", "evidence_count", "first_evidence_id")


@query(
    "q72_quarantine",
    """WITH m AS (SELECT 'x' || doc_id AS mention_id, CASE WHEN doc_id % 11 = 0 THEN 'shout' ELSE 'name' END AS kind, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS surface, n_chars % 90 - 3 AS start_offset, n_chars % 90 + CASE WHEN doc_id % 5 = 0 THEN -9 ELSE 4 END AS end_offset FROM documents),
r AS (SELECT mention_id, list_filter([CASE WHEN kind <> 'name' THEN 'kind' END, CASE WHEN surface = '' THEN 'surface' END, CASE WHEN NOT (start_offset >= 0 AND end_offset >= start_offset) THEN 'offsets' END], lambda x: x IS NOT NULL) AS reasons FROM m)
SELECT mention_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM r""",
)
def quarantine(spark, sf_dir):
    """Mentions of which some break rules: what is accepted, and what is set aside with which reasons."""
    n, k = F.col("n_chars"), F.col("doc_id")
    rows = A.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("x"), k.cast("string")).alias("mention_id"), F.when(k % 11 == 0, "shout").otherwise("name").alias("kind"), F.when(k % 7 == 0, "").otherwise(F.col("source")).alias("surface"),
        (n % 90 - 3).alias("start_offset"), (n % 90 + F.when(k % 5 == 0, -9).otherwise(4)).alias("end_offset"),
    )
    out = schemas.accepted_and_quarantined({"mention_node": rows})
    good = out["mention_node"].select("mention_id", F.lit("").alias("reasons"), F.lit(True).alias("accepted"))
    return good.unionAll(out["quarantine"].select("row_key", F.array_join("reasons", ","), F.lit(False)))


@query(
    "q73_shared_mentions",
    """WITH r AS (SELECT doc_id, 'x' || n_chars % 2000 AS mention_id, source AS character_id, doc_id % 2 AS run FROM documents),
f AS (SELECT mention_id, coalesce(min(doc_id) FILTER (WHERE run = 0), min(doc_id)) AS made_by FROM r GROUP BY 1)
SELECT mention_id, made_by, count(DISTINCT character_id) AS characters FROM r JOIN f USING (mention_id) GROUP BY ALL""",
)
def shared_mentions(spark, sf_dir):
    """Two runs: a mention is made once and keeps its fields, its edges add up."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x"), (F.col("n_chars") % 2000).cast("string")).alias("mention_id"), F.col("source").alias("character_id"))
    run = lambda k: rows.where(F.col("doc_id") % 2 == k)
    made = lambda d: d.groupBy("mention_id").agg(F.min("doc_id").alias("made_by"))
    nodes = upsert.inserted(made(run(0)), made(run(1)), ["mention_id"])
    edges = run(0).select("mention_id", "character_id").unionAll(run(1).select("mention_id", "character_id")).distinct()
    return reads.mentions_of(nodes, edges).groupBy("mention_id", "made_by").agg(F.count("*").alias("characters"))


_TURNS = r"""t AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(text, '\s+'), lambda x: lower(regexp_replace(strip_accents(x[1]), '[^\x00-\x7F]', '', 'g')))[1] AS name, turn % 7 = 5 AS animal FROM conversations)"""


@query(
    "q74_alignment_without_animals",
    f"""WITH RECURSIVE {_TURNS}, g AS (SELECT conv_id, turn AS g, name FROM t WHERE turn % 2 = 0 AND name <> ''), p AS (SELECT conv_id, turn AS p, name FROM t WHERE turn % 2 = 1 AND NOT animal AND name <> ''),
e AS (SELECT g.conv_id, g.g, list_sort(list(p.p)) AS ps FROM g JOIN p USING (conv_id, name) GROUP BY ALL), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY g) AS i FROM e),
s(conv_id, i, taken, g, p) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
  UNION ALL SELECT s.conv_id, o.i, CASE WHEN len(list_filter(ps, lambda x: NOT list_contains(taken, x))) > 0 THEN list_append(taken, list_filter(ps, lambda x: NOT list_contains(taken, x))[1]) ELSE taken END, o.g, list_filter(ps, lambda x: NOT list_contains(taken, x))[1] FROM s JOIN o ON o.conv_id = s.conv_id AND o.i = s.i + 1)
SELECT CAST(conv_id AS VARCHAR) AS work, g AS gold, p AS pred FROM s WHERE p IS NOT NULL""",
)
def alignment_without_animals(spark, sf_dir):
    """Even turns of a conversation as gold, odd ones as predictions, some of them animals, named by the first letter of their first word."""
    t = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("work"), "turn", F.substring(F.element_at(F.split("text", r"\s+"), 1), 1, 1).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    gold = t.where("turn % 2 = 0").select("work", F.col("turn").alias("ident"), F.struct("turn").alias("order"), "canonical_name", "aliases")
    kinds = t.where("turn % 2 = 1").select(F.col("work").alias("manuscript_id"), F.col("turn").alias("character_id"), F.when(F.col("turn") % 7 == 5, "animal").otherwise("person").alias("entity_kind"), "canonical_name", "aliases")
    predicted = evaluation.people(kinds).withColumn("order", F.struct("ident"))
    return evaluation.alignment(gold, predicted).select("work", "gold", "pred")


@query(
    "q75_places_in_lists",
    "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place_in_source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents",
)
def places_in_lists(spark, sf_dir):
    """The longest document first, of each source and of all."""
    rows = A.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    order = [F.desc("n_chars"), F.col("doc_id")]
    both = ranked(ranked(rows, order, ("source",), "place_in_source"), order)
    return both.select("source", "doc_id", "place_in_source", "place")
