"""Queries of linking, merging and matching over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import names
from loomtext.operators import resolution, upsert
from loomtext.plans import adapters as A
from loomtext.plans.catalogue import query

_TITLED = "['', 'mr', 'mrs', 'dr'][(n_chars % 4) + 1]"


@query(
    "q66_linking_at_the_scene",
    f"""WITH d AS (SELECT doc_id // 200 AS manuscript_id, doc_id AS scene_order, n_chars, {_TITLED} AS honorific, source FROM documents),
f AS (SELECT manuscript_id, scene_order, 'n' || (n_chars // 4 % 9) AS base, honorific, source AS canonical FROM d WHERE n_chars % 3 = 1), a AS (SELECT manuscript_id, scene_order, honorific, 'n' || (n_chars // 16 % 9) AS base FROM d),
b0 AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id, base, honorific ORDER BY scene_order) = 1 AS new FROM f),
b AS (SELECT manuscript_id, base, scene_order, honorific AS last_honorific, canonical AS last, sum(new::int) OVER (PARTITION BY manuscript_id, base ORDER BY scene_order ROWS UNBOUNDED PRECEDING) AS forms FROM b0)
SELECT a.manuscript_id, a.scene_order, a.base, a.honorific, coalesce(f.canonical, CASE WHEN b.forms = 1 AND (a.honorific = '' OR b.last_honorific = '') THEN b.last END) AS canonical
FROM a ASOF LEFT JOIN f ON a.manuscript_id = f.manuscript_id AND a.base = f.base AND a.honorific = f.honorific AND a.scene_order >= f.scene_order
ASOF LEFT JOIN b ON a.manuscript_id = b.manuscript_id AND a.base = b.base AND a.scene_order >= b.scene_order""",
)
def linking_at_the_scene(spark, sf_dir):
    """A document is a scene; a third of them write a form for their source, and each asks for a name as the forms stand at it."""
    n, base = F.col("n_chars"), lambda x: F.concat(F.lit("n"), (x % 9).cast("string"))
    rows = A.table(spark, sf_dir, "documents").select(F.expr("doc_id div 200").alias("manuscript_id"), F.col("doc_id").alias("scene_order"), F.get(F.array(*map(F.lit, ("", "mr", "mrs", "dr"))), (n % 4).cast("int")).alias("honorific"), "n_chars", F.col("source").alias("canonical"))
    history = rows.where("n_chars % 3 = 1").select("manuscript_id", base(F.floor(n / 4)).alias("base"), "honorific", "canonical", "scene_order", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("nth"))
    asked = rows.select("manuscript_id", "scene_order", base(F.floor(n / 16)).alias("base"), "honorific")
    return resolution.lookup_at(asked, history).select("manuscript_id", "scene_order", "base", "honorific", "canonical")


@query(
    "q67_similar_names",
    r"""WITH h AS (SELECT page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.') AS w FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) <> ''),
n AS (SELECT DISTINCT page_id // 40 AS manuscript_id, CASE WHEN page_id % 4 = 0 THEN 'Mr. ' WHEN page_id % 4 = 1 THEN 'Mrs. ' ELSE '' END AS title, lower(array_to_string(CASE WHEN page_id % 3 = 0 THEN [w[1]] WHEN page_id % 3 = 1 THEN w[2:] ELSE w END, ' ')) AS base FROM h),
u AS (SELECT manuscript_id, title || base AS name, title, base FROM n WHERE base <> ''), p AS (SELECT a.manuscript_id, a.name AS name_a, b.name AS name_b, a.base AS x, b.base AS y, CASE WHEN length(a.base) < length(b.base) THEN a.base ELSE b.base END AS short, CASE WHEN length(a.base) < length(b.base) THEN b.base ELSE a.base END AS long
FROM u a JOIN u b ON a.manuscript_id = b.manuscript_id AND a.name < b.name WHERE a.title = '' OR b.title = '' OR a.title = b.title),
s AS (SELECT *, contains(long, short) AS holds, contains(x, ' ') AND contains(y, ' ') AND string_split(x, ' ')[-1] = string_split(y, ' ')[-1] AS family FROM p)
SELECT manuscript_id, name_a, name_b, CASE WHEN x = y THEN true WHEN holds THEN NOT (contains(long, ' ') AND short = string_split(long, ' ')[-1]) ELSE string_split(x, ' ')[1:-2] = string_split(y, ' ')[1:-2] END AS auto FROM s WHERE holds OR family""",
)
def similar_names(spark, sf_dir):
    """Words of hosts as names of several words, some of them the first word only or without it, in manuscripts of 40 pages."""
    k, words = F.col("page_id"), F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")
    title = F.when(k % 4 == 0, "Mr. ").when(k % 4 == 1, "Mrs. ").otherwise("")
    some = F.when(k % 3 == 0, F.slice(words, 1, 1)).when(k % 3 == 1, F.slice(words, 2, F.size(words))).otherwise(words)
    named = A.table(spark, sf_dir, "pages").select(F.expr("page_id div 40").alias("manuscript_id"), title.alias("title"), F.lower(F.array_join(some, " ")).alias("base")).where("base <> ''")
    return resolution.similar_pairs(named.select("manuscript_id", F.concat("title", "base").alias("name")))


@query(
    "q68_merge_chains",
    """WITH RECURSIVE m AS (SELECT doc_id AS f, doc_id - 1 AS t FROM documents WHERE doc_id % 10 IN (2, 3, 4, 5) UNION SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 10 = 7 UNION SELECT doc_id, doc_id - 1 FROM documents WHERE doc_id % 20 = 8
  UNION SELECT doc_id, doc_id - 4 FROM documents WHERE doc_id % 10 = 9 UNION SELECT doc_id, doc_id - 9 FROM documents WHERE doc_id % 30 = 9),
e AS (SELECT f AS a, t AS b FROM m UNION SELECT t, f FROM m), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
root AS (SELECT a, coalesce(min(b) FILTER (WHERE b NOT IN (SELECT f FROM m)), min(b)) AS root FROM r GROUP BY a),
c AS (SELECT doc_id AS k, coalesce(root, doc_id) AS character_id, 'd' || doc_id AS name, n_chars FROM documents LEFT JOIN root ON a = doc_id),
n AS (SELECT character_id, count(DISTINCT x) AS n_mentions FROM (SELECT character_id, unnest([n_chars % 997, n_chars * 7 % 997]) AS x FROM c) GROUP BY 1)
SELECT character_id, string_agg(name, ',' ORDER BY name) FILTER (WHERE k <> character_id) AS aliases, count(*) - 1 AS absorbed, max(n_mentions) AS n_mentions FROM c JOIN n USING (character_id) GROUP BY character_id""",
)
def merge_chains(spark, sf_dir):
    """Documents as characters and their accepted merges in one batch: chains of five, circles of two, and some merged into two
    others. A mention that several characters have is one with several edges, and edges that meet become one."""
    rows = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("character_id"), F.col("n_chars").cast("long").alias("n"))
    k = F.col("character_id")
    c = rows.select("character_id", F.concat(F.lit("d"), k.cast("string")).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    step = lambda where, by: rows.where(where).select(k.alias("from_id"), (k + by).alias("to_id"))
    merges = step((k % 10).isin(2, 3, 4, 5), -1).unionAll(step(k % 10 == 7, 1)).unionAll(step(k % 20 == 8, -1)).unionAll(step(k % 10 == 9, -4)).unionAll(step(k % 30 == 9, -9))
    edges = rows.select("character_id", F.explode(F.array(F.col("n") % 997, F.col("n") * 7 % 997)).alias("mention_id")).distinct()
    seen = edges.select("character_id", F.col("mention_id").alias("scene_id"), F.lit("mentioned").alias("kind"), F.lit(1).alias("mention_count"))
    people, moved, _ = upsert.accepted(c, edges, seen, merges)
    n = moved.groupBy("character_id").agg(F.count("*").alias("n_mentions"))
    listed = F.when(F.size("aliases") > 0, F.array_join("aliases", ","))
    return people.join(n, "character_id").select("character_id", listed.alias("aliases"), F.size("merged_from").cast("long").alias("absorbed"), "n_mentions")


#: How an alias is made of a name, and whether it is a valid alias, unnamed, and a collective.
_FORMS = (
    ("{}", True, False, False), ("she", False, True, False), ("ella", False, True, False), ("her friend", False, True, False), ("la Madre", False, False, False), ("mamma", False, True, False), ("Mr. {}", True, False, False),
    ("el anciano", False, True, False), ("the waiter", False, True, True), ("hermana de {}", False, True, False), ("{}'s mother", False, True, False), ("un {}", True, False, False), ("", False, True, False), ("   ", False, True, False),
    ("Tía {}", True, False, False), ("my Sister", False, False, False), ("Señor {}", True, False, False), ("of the {}", True, False, False), ("los {}", True, False, True), ("THE {}", True, False, True), ("todas", False, True, True),
)


@query(
    "q69_alias_rules",
    "WITH f AS (SELECT * FROM (VALUES "
    + ", ".join("({}, '{}', {}, {}, {})".format(i, f.replace("'", "''"), *map(str, x)) for i, (f, *x) in enumerate(_FORMS))
    + f") v(i, form, valid, unnamed, collective)) SELECT doc_id, replace(form, '{{}}', upper(source[1]) || source[2:] || n_chars) AS alias, valid, unnamed, collective FROM documents JOIN f ON doc_id % {len(_FORMS)} = i",
)
def alias_rules(spark, sf_dir):
    """A form of a name for each document, made of its source and length: what the rules say of it."""
    forms = F.array(*[F.lit(f) for f, *_ in _FORMS])
    name = F.concat(F.initcap("source"), F.col("n_chars").cast("string"))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.replace(F.get(forms, (F.col("doc_id") % len(_FORMS)).cast("int")), F.lit("{}"), name).alias("alias"))
    a = F.col("alias")
    return rows.select("doc_id", "alias", names.is_valid_alias(a).alias("valid"), names.is_unnamed(a).alias("unnamed"), names.is_collective(a).alias("collective"))
