"""More of the engine's queries over the test tables: sources, headings, tables, lists and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import ids, names, ratios, text
from loomtext.operators import evidence, metrics, reads, segmentation, upsert
from loomtext.plans import adapters as A
from loomtext.plans import evaluation, ingest, layers, wipe
from loomtext.plans.catalogue import _REL, _SHEET, _kept, _sheet, query
from loomtext.schemas import ATTRIBUTES, RELATIONS
from loomtext.sources import manuscripts, responses

_START, _END = "*** START OF THE PROJECT GUTENBERG EBOOK A ***", "*** END OF THE PROJECT GUTENBERG EBOOK A ***"


@query(
    "q43_txt_blocks",
    r"""WITH b AS (SELECT doc_id, unnest([{'n': 1, 'k': 'heading', 't': 'CHAPTER IV.'}, {'n': 2, 'k': 'paragraph', 't': array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' ')}, {'n': 3, 'k': 'separator', 't': '* * *'}, {'n': 4, 'k': 'heading', 't': 'Epílogo'}, {'n': 5, 'k': 'paragraph', 't': 'The end.'}]) AS b FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_id, CAST(b.n AS BIGINT) AS n, b.k AS kind, trim(b.t) AS text FROM b""",
)
def txt_blocks(spark, sf_dir):
    """Documents as text files with a byte order mark, edition markers, CR LF lines, headings and a separator."""
    parts = F.concat_ws("\r\n\r\n", F.lit("About this edition\r\n" + _START), F.lit("CHAPTER IV."), F.regexp_replace("text", "\n", "\r\n"), F.lit("  * * *  "), F.lit("Epílogo"), F.lit("The end."), F.lit(_END + "\r\nLicense"))
    files = A.table(spark, sf_dir, "documents").where(text.strip(F.col("text")) != "").select(F.col("doc_id").alias("manuscript_id"), F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(parts, "UTF-8")).alias("content"))
    rows = manuscripts.text_blocks(files.withColumn("text", manuscripts.decoded("content")))
    place = F.row_number().over(segmentation.Window.partitionBy("manuscript_id").orderBy("pos")).cast("long")
    return rows.select(F.col("manuscript_id").alias("doc_id"), place.alias("n"), "kind", F.trim("text").alias("text"))


@query(
    "q44_heading_kind_title",
    """WITH h AS (SELECT o_orderkey AS k, ['CHAPTER ' || o_custkey || '.', 'Capítulo ' || o_custkey || ' ] ', 'PROLOGUE', 'Epílogo.', 'interludio :', 'Prólogo'][(o_orderkey % 6) + 1] AS heading FROM orders)
SELECT k, heading, ['chapter', 'chapter', 'prologue', 'epilogue', 'interlude', 'prologue'][(k % 6) + 1] AS kind,
CASE k % 6 WHEN 0 THEN substr(heading, 1, length(heading) - 1) WHEN 1 THEN substr(heading, 1, length(heading) - 3) WHEN 3 THEN 'Epílogo' ELSE trim(heading) END AS title FROM h""",
)
def heading_kind_title(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    n = F.col("o_custkey").cast("string")
    forms = F.array(F.concat(F.lit("CHAPTER "), n, F.lit(".")), F.concat(F.lit("Capítulo "), n, F.lit(" ] ")), F.lit("PROLOGUE"), F.lit("Epílogo."), F.lit("interludio :"), F.lit("Prólogo"))
    rows = o.select(F.col("o_orderkey").alias("k"), F.get(forms, (F.col("o_orderkey") % 6).cast("int")).alias("heading"))
    return rows.select("k", "heading", text.heading_kind(F.col("heading")).alias("kind"), text.heading_title(F.col("heading")).alias("title"))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query(
    "q45_chapters",
    f"""WITH {A.BLOCKS} SELECT content_id || ':c' || order_narrative AS chapter_id, content_id AS manuscript_id, CAST(order_narrative AS BIGINT) AS order_narrative, CAST(sum({_WORDS}) AS BIGINT) AS word_count, CAST(min(start_offset) AS BIGINT) AS start_offset, CAST(max(start_offset + char_count) AS BIGINT) AS end_offset
FROM (SELECT * FROM ord JOIN cid USING (mid)) WHERE mid IN (SELECT arg_min(mid, mid) FROM cid GROUP BY content_id) GROUP BY ALL""",
)
def chapters(spark, sf_dir):
    found = ingest.raw_layer(_blocks(spark, sf_dir))["chapter"]
    return found.select("chapter_id", "manuscript_id", F.col("order_narrative").cast("long").alias("order_narrative"), "word_count", "start_offset", "end_offset")


def _blocks(spark, sf_dir):
    none = F.lit(None)
    return A.blocks(spark, sf_dir).withColumns({"level": none.cast("int"), "style": none.cast("string")})


@query(
    "q46_manuscripts",
    f"""WITH {A.BLOCKS} SELECT content_id AS manuscript_id, count(*) AS scene_count, count(DISTINCT order_narrative) AS chapter_count, CAST(sum({_WORDS}) AS BIGINT) AS word_count, hash_even AS created
FROM (SELECT *, length(content_id) = 64 AND ascii(content_id) % 2 = 0 AS hash_even FROM ord JOIN cid USING (mid)) WHERE mid IN (SELECT arg_min(mid, mid) FROM cid GROUP BY content_id) GROUP BY ALL""",
)
def manuscript_rows(spark, sf_dir):
    """What uploads are answered with, where manuscripts with an odd first letter were there before."""
    tables = ingest.raw_layer(_blocks(spark, sf_dir))
    known = tables["manuscript"].where(F.ascii("manuscript_id") % 2 == 1)
    return ingest.summaries(tables, known).select("manuscript_id", "scene_count", "chapter_count", "word_count", "created")


@query(
    "q47_upsert_overwrite",
    "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
)
def upsert_overwrite(spark, sf_dir):
    side = lambda n, origin: A.table(spark, sf_dir, "customer").where(F.col("c_custkey") % n == 0).select(F.col("c_custkey").alias("k"), F.lit(origin).alias("origin"))
    return upsert.upserted(side(2, "old"), side(3, "new"), ["k"])


@query(
    "q48_upsert_appearances",
    """SELECT o_custkey AS character_id, o_orderkey // 8 AS scene_id, CASE WHEN max(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) = 1 THEN 'present' ELSE 'mentioned' END AS kind FROM orders GROUP BY 1, 2""",
)
def upsert_appearances(spark, sf_dir):
    """Two runs over parts of the appearances: one that is present stays present."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("character_id"), F.expr("o_orderkey div 8").alias("scene_id"), F.when(F.col("o_orderkey") % 3 != 0, "present").otherwise("mentioned").alias("kind"), "o_orderkey")
    return upsert.upserted_appearances(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))


@query(
    "q49_relation_list",
    f"""WITH {A.KEPT_EVIDENCE},{A.RELATION_MAP}, c AS (SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, n_name AS name FROM nation)
SELECT manuscript_id, a AS character_a_id, b AS character_b_id, rel_type, evidence_count, x.name AS name_a, y.name AS name_b FROM rel JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE provenance = 'extracted'""",
)
def relation_list(spark, sf_dir):
    people = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("character_id"), F.col("n_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    found = reads.relation_list(evidence.relation_map(_kept(spark, sf_dir)), people, "extracted")
    return found.select("manuscript_id", "character_a_id", "character_b_id", "rel_type", "evidence_count", "name_a", "name_b")


@query(
    "q50_attribute_list",
    f"""WITH {A.ATTRIBUTE_EVIDENCE}, {_SHEET}, c AS (SELECT 'c' || n_nationkey AS character_id, n_name AS canonical_name FROM nation) SELECT manuscript_id, character_id, canonical_name, key, value_norm, evidence_count, attr_class FROM sheet JOIN c USING (character_id)""",
)
def attribute_list(spark, sf_dir):
    people = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("character_id"), F.col("n_name").alias("canonical_name"))
    return reads.attribute_list(_sheet(spark, sf_dir), people).select("manuscript_id", "character_id", "canonical_name", "key", "value_norm", "evidence_count", "attr_class")


@query("q51_scene_coordinates", f"WITH {A.BLOCKS} SELECT content_id || ':c' || order_narrative || ':s' || order_in_chapter AS scene_id, 'c' || order_narrative || '/s' || order_in_chapter AS coordinate FROM ord JOIN cid USING (mid) WHERE mid IN (SELECT arg_min(mid, mid) FROM cid GROUP BY content_id)")
def scene_coordinates(spark, sf_dir):
    return reads.scene_coordinates(ingest.raw_layer(_blocks(spark, sf_dir))["scene"])


@query(
    "q52_mention_order",
    """WITH m AS (SELECT l_suppkey AS c, l_orderkey // 50 AS scene, l_linenumber AS start, 'x' || l_orderkey || '-' || l_linenumber AS id FROM lineitem)
SELECT s_suppkey AS character_id, coalesce(string_agg(id, ',' ORDER BY scene, start, id), '') AS mentions FROM supplier LEFT JOIN m ON c = s_suppkey GROUP BY 1""",
)
def mention_order(spark, sf_dir):
    m = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("character_id"), F.expr("l_orderkey div 50").alias("scene_id"), F.col("l_linenumber").alias("start_offset"), F.concat(F.lit("x"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("mention_id"), F.lit("s").alias("surface"), F.lit("q").alias("quote"))
    people = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("character_id"))
    seen = m.select("character_id", "scene_id", F.lit("mentioned").alias("kind"), F.col("scene_id").alias("order_narrative_global")).distinct()
    found = reads.character_detail(people, seen, m)
    return found.select("character_id", F.coalesce(F.array_join(F.transform("mentions", lambda x: x["mention_id"]), ","), F.lit("")).alias("mentions"))


@query(
    "q53_mention_clusters",
    """SELECT DISTINCT 'c' || (l_orderkey % 4) || '/s' || (l_orderkey % 7) || '::' || lower(trim('  Name' || (l_partkey % 50) || ' ')) AS key, l_suppkey AS cluster FROM lineitem WHERE l_linenumber <> 3 AND l_orderkey % 28 < 20""",
)
def mention_clusters(spark, sf_dir):
    """Mentions of which every seventh or so is a resolved pronoun, in scenes of which some are unknown."""
    scene = (F.col("l_orderkey") % 28).cast("string")
    m = A.table(spark, sf_dir, "lineitem").select(scene.alias("scene_id"), F.concat(F.lit("  Name"), (F.col("l_partkey") % 50).cast("string"), F.lit(" ")).alias("surface"), F.when(F.col("l_linenumber") == 3, "pronoun_resolved").otherwise("name").alias("kind"), F.col("l_suppkey").alias("character_id"))
    scenes = spark.range(20).select(F.col("id").cast("string").alias("scene_id"), (F.col("id") % 4).alias("order_narrative"), (F.col("id") % 7).alias("order_in_chapter"))
    return evaluation.mention_clusters(m, scenes)


@query(
    "q54_first_quotes",
    """WITH m AS (SELECT l_suppkey AS c, l_orderkey // 50 AS scene, l_linenumber AS start, 'x' || l_orderkey || '-' || l_linenumber AS id FROM lineitem), f AS (SELECT c, min(scene) AS scene FROM m GROUP BY 1)
SELECT f.c AS character_id, f.scene AS scene_id, f.scene AS order_narrative_global, arg_min('q' || id, {'s': start, 'i': id}) AS quote FROM f JOIN m ON m.c = f.c AND m.scene = f.scene GROUP BY 1, 2, 3""",
)
def first_quotes(spark, sf_dir):
    m = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("character_id"), F.expr("l_orderkey div 50").alias("scene_id"), F.col("l_linenumber").alias("start_offset"), F.concat(F.lit("x"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("mention_id"))
    m = m.withColumn("quote", F.concat(F.lit("q"), "mention_id"))
    scenes = m.select("scene_id", F.col("scene_id").alias("order_narrative_global")).distinct()
    found = evidence.first_appearances(m.select("character_id", "scene_id").distinct(), scenes, m)
    return found.select("character_id", "scene_id", "order_narrative_global", "quote")


@query(
    "q55_relation_layer",
    """WITH s AS (SELECT conv_id, turn, 'k' || conv_id AS manuscript_id, 'k' || conv_id || 's' || turn AS scene_id, role FROM conversations),
e AS (SELECT *, 'p1' AS a, 'p2' AS b, 0.1 * (turn % 9) AS c1, 0.1 * ((turn + conv_id) % 9) AS c2, turn % 5 <> 4 AS good FROM s),
k AS (SELECT *, greatest(round(c1, 1), round(c2, 1)) AS confidence, CASE WHEN round(c1, 1) >= round(c2, 1) THEN 'first' ELSE 'second' END AS descriptor FROM e WHERE good)
SELECT scene_id, a AS character_a_id, b AS character_b_id, descriptor, CAST(confidence AS DOUBLE) AS confidence, scene_id || ':re:' || substr(sha256(a || '::' || b), 1, 16) AS evidence_id FROM k""",
)
def relation_layer(spark, sf_dir):
    """Stored responses with two evidences of a pair, in both orders, and one of a stranger; every fifth breaks the contract."""
    rows = _scenes_with_cast(spark, sf_dir)
    item = lambda a, b, d, c: F.struct(F.lit(a).alias("character_a_id"), F.lit(b).alias("character_b_id"), F.lit("social").alias("rel_type"), F.lit(d).alias("descriptor"), F.lit("extracted").alias("provenance"), F.round(c, 1).alias("confidence"), F.lit("q").alias("quote"))
    said = F.to_json(F.struct(F.array(item("p1", "p2", "first", 0.1 * (F.col("turn") % 9)), item("p2", "p1", "second", 0.1 * ((F.col("turn") + F.col("conv_id")) % 9)), item("p1", "stranger", "x", F.lit(0.9))).alias("evidences")))
    stored = rows.select("cache_key", F.when(F.col("turn") % 5 == 4, '{"evidences": [{"rel_type": "none"}]}').otherwise(said).alias("payload"))
    found = layers.relation_tables(responses.looked_up(rows, stored, RELATIONS, layers.relation_contract()))["relation_evidence"]
    return found.select("scene_id", "character_a_id", "character_b_id", "descriptor", "confidence", "evidence_id")


def _scenes_with_cast(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations")
    scene = F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit("s"), F.col("turn").cast("string"))
    return t.select("conv_id", "turn", F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("manuscript_id"), scene.alias("scene_id"), F.sha2(scene, 256).alias("cache_key"), F.col("turn").alias("order_narrative_global"), F.array(F.lit("p1"), F.lit("p2")).alias("cast_ids"))


@query(
    "q56_attribute_layer",
    """SELECT 'k' || conv_id || 's' || turn AS scene_id, 'p' || (1 + turn % 2) AS character_id, 'hair' AS key, 'red ' || (conv_id % 3) AS value_norm, 'k' || conv_id || 's' || turn || ':ae:' || substr(sha256('p' || (1 + turn % 2) || '::' || 'hair'), 1, 16) AS evidence_id FROM conversations WHERE turn % 4 <> 3""",
)
def attribute_layer(spark, sf_dir):
    """Values are lower-cased and trimmed; a response with a confidence over 1 breaks the contract."""
    rows = _scenes_with_cast(spark, sf_dir)
    item = F.struct(F.concat(F.lit("p"), (1 + F.col("turn") % 2).cast("string")).alias("character_id"), F.lit("hair").alias("key"), F.concat(F.lit("  RED "), (F.col("conv_id") % 3).cast("string"), F.lit(" ")).alias("value_norm"), F.lit("q").alias("value_quote"), F.when(F.col("turn") % 4 == 3, 1.5).otherwise(0.5).alias("confidence"))
    stored = rows.select("cache_key", F.to_json(F.struct(F.array(item).alias("evidences"))).alias("payload"))
    found = layers.attribute_tables(responses.looked_up(rows, stored, ATTRIBUTES, layers.attribute_contract()))["attribute_evidence"]
    return found.select("scene_id", "character_id", "key", "value_norm", "evidence_id")


@query("q57_wipe_preview", "SELECT 'character' AS table_name, count(*) AS rows FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'merge_candidate', count(*) FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'mention', count(*) FROM orders WHERE o_custkey % 25 = 3")
def wipe_preview(spark, sf_dir):
    own = lambda name, column: A.table(spark, sf_dir, name).select(F.concat(F.lit("m"), F.col(column).cast("string")).alias("manuscript_id"))
    tables = {"character": own("customer", "c_nationkey"), "merge_candidate": own("supplier", "s_nationkey"), "mention": A.table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 25).cast("string")).alias("manuscript_id"))}
    return wipe.preview(tables, "m3")


@query(
    "q58_segmentation_scores",
    f"""WITH {A.BLOCKS}, d AS (SELECT mid, count(DISTINCT chapter_run) AS ch, count(*) FILTER (WHERE boundary_reason = 'separator') AS sp FROM ord GROUP BY ALL), e AS (SELECT mid, count(*) FILTER (WHERE kind = 'heading') AS ech, count(*) FILTER (WHERE kind = 'separator') AS esp FROM bl GROUP BY ALL),
a AS (SELECT e.mid, CASE WHEN ech = 0 THEN CASE WHEN coalesce(ch, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0, 1 - abs(coalesce(ch, 0) - ech) / CAST(ech AS DOUBLE)) END AS c, CASE WHEN esp = 0 THEN CASE WHEN coalesce(sp, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0, 1 - abs(coalesce(sp, 0) - esp) / CAST(esp AS DOUBLE)) END AS s FROM e LEFT JOIN d USING (mid))
SELECT count(*) AS works, round(CAST(avg(c) AS DOUBLE), 9) AS chapter_accuracy, round(CAST(avg(s) AS DOUBLE), 9) AS separator_accuracy FROM a""",
)
def segmentation_scores(spark, sf_dir):
    rows = A.blocks(spark, sf_dir)
    expected = rows.groupBy("manuscript_id").agg(F.count_if(F.col("kind") == "heading").alias("expected_chapters"), F.count_if(F.col("kind") == "separator").alias("expected_separators"))
    found = evaluation.segmentation(expected, segmentation.raw_scenes(rows).withColumnRenamed("chapter_run", "order_narrative"))
    return found.agg(F.count("*").alias("works"), *[F.round(F.avg(c), 9).alias(c) for c in ("chapter_accuracy", "separator_accuracy")])


@query(
    "q59_replace_by_wipe",
    "SELECT c_custkey AS character_id, 'm' || c_nationkey AS manuscript_id FROM customer WHERE c_nationkey NOT IN (3, 4)",
)
def replace_by_wipe(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("character_id"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("manuscript_id"))
    return upsert.without(rows, ["m3", "m4"])


@query(
    "q60_structure_with_asides",
    f"""WITH {A.BLOCKS}, one AS (SELECT arg_min(mid, mid) AS mid FROM cid GROUP BY content_id), n AS (SELECT mid, count(*) AS n FROM (SELECT mid FROM bl WHERE source_role IS NOT NULL AND kind <> 'separator') GROUP BY 1)
SELECT content_id AS manuscript_id, count(*) AS n_scenes, count(DISTINCT order_narrative) AS n_chapters, string_agg(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 20), '|' ORDER BY global_order) AS snippets, max(CASE WHEN n IS NULL THEN 0 ELSE 1 END) AS n_asides
FROM ord JOIN cid USING (mid) JOIN one USING (mid) LEFT JOIN n USING (mid) GROUP BY 1""",
)
def structure_with_asides(spark, sf_dir):
    """Chapters and scenes with snippets of 20 characters, and non-narrative rows; the neighbouring covers are one."""
    found = reads.structure_summary(ingest.raw_layer(_blocks(spark, sf_dir)), snippet_len=20)
    scenes = F.flatten(F.transform("chapters", lambda c: c["scenes"]))
    return found.select("manuscript_id", F.size(scenes).cast("long").alias("n_scenes"), F.size("chapters").cast("long").alias("n_chapters"), F.array_join(F.transform(scenes, lambda s: s["snippet"]), "|").alias("snippets"), F.size("non_narrative_blocks").alias("n_asides"))


@query("q61_accuracy_of_counts", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 7 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ELSE greatest(CAST(0 AS DOUBLE), 1 - abs(o_custkey % 7 - o_orderkey % 5) / CAST(o_orderkey % 5 AS DOUBLE)) END AS accuracy FROM orders")
def accuracy_of_counts(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), ratios.accuracy(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("accuracy"))


@query("q62_kept_relation_rows", f"WITH {A.KEPT_EVIDENCE},{A.RELATION_MAP} SELECT {_REL} FROM rel WHERE manuscript_id = 'm1'")
def kept_relation_rows(spark, sf_dir):
    """Wiping all other manuscripts leaves the relations of one."""
    return upsert.without(evidence.relation_map(_kept(spark, sf_dir)), ["m0", "m2", "m3", "m4", "m5", "m6"])


@query(
    "q63_first_matches",
    """WITH g AS (SELECT s_suppkey AS id, s_nationkey AS nat FROM supplier), p AS (SELECT c_custkey AS id, c_nationkey AS nat, c_custkey AS place FROM customer)
SELECT g.id AS gold_id, arg_min(p.id, p.place) AS pred_id FROM g JOIN p USING (nat) GROUP BY 1""",
)
def first_matches(spark, sf_dir):
    """For each gold entity the first prediction in list order with a common name, also if another took it before."""
    name = lambda c: F.concat(F.lit("Nation "), F.col(c).cast("string"))
    shape = lambda d, ident, nat: d.select(F.lit("w").alias("work"), F.col(ident).alias("ident"), F.struct(F.col(ident).alias("x")).alias("order"), name(nat).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    gold = shape(A.table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")
    predicted = shape(A.table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")
    return evaluation.first_matches(gold, predicted).select(F.col("gold").alias("gold_id"), F.col("pred").alias("pred_id"))


@query("q64_fold_of_surfaces", "SELECT p_partkey AS k, lower(trim(p_name)) AS folded, p_partkey || ':ch:' || substr(sha256(p_partkey || '::' || lower(trim(p_name))), 1, 16) AS character_id FROM part")
def fold_of_surfaces(spark, sf_dir):
    folded = names.fold(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), folded.alias("folded"), ids.character_id(F.col("p_partkey").cast("string"), folded).alias("character_id"))


@query("q65_bad_merges_of_layers", "SELECT CAST(x.s_suppkey AS VARCHAR) AS x, CAST(y.s_suppkey AS VARCHAR) AS y, 'p' || x.s_suppkey AS pred FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1 WHERE x.s_suppkey % 2 = 0 AND x.s_suppkey % 3 <> 0 AND CAST(x.s_suppkey AS VARCHAR) < CAST(y.s_suppkey AS VARCHAR) UNION ALL SELECT CAST(y.s_suppkey AS VARCHAR), CAST(x.s_suppkey AS VARCHAR), 'p' || x.s_suppkey FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1 WHERE x.s_suppkey % 2 = 0 AND x.s_suppkey % 3 <> 0 AND CAST(x.s_suppkey AS VARCHAR) > CAST(y.s_suppkey AS VARCHAR)")
def bad_merges_of_layers(spark, sf_dir):
    """Every even supplier's prediction also has the name of the next one; candidates cover every third of them."""
    s = A.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("Name "), k.cast("string"))
    shape = lambda d, ident, aliases: d.select(F.lit("w").alias("work"), ident.alias("ident"), F.struct(key).alias("order"), name(key).alias("canonical_name"), aliases.alias("aliases"))
    none = F.array().cast("array<string>")
    even = s.where(key % 2 == 0)
    gold, predicted = shape(s, key.cast("string"), none), shape(even, F.concat(F.lit("p"), key.cast("string")), F.array(name(key + 1)))
    who = lambda k: F.struct(name(k).alias("canonical_name"), none.alias("aliases"))
    candidates = even.where(key % 3 == 0).select(F.lit("w").alias("work"), who(key + 1).alias("a"), who(key).alias("b"))
    return evaluation.silent_bad_merges(gold, predicted, candidates).select("x", "y", "pred")
