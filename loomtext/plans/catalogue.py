"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import ids, names, ratios, text
from loomtext.operators import evidence, matching, metrics, reads, resolution, segmentation, upsert
from loomtext.plans import adapters as A
from loomtext.schemas import EXTRACTION, GATE_KEYS
from loomtext.sources import markup, responses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.relation_evidence(spark, sf_dir)
    inside = evidence.within_cast(rows, A.casts(rows), "character_a_id", "character_b_id")
    return evidence.strongest(evidence.canonical(inside), ["scene_id", "character_a_id", "character_b_id"], "narrative_order")


_REL = "manuscript_id, a AS character_a_id, b AS character_b_id, rel_type, descriptor, role_a, role_b, provenance, confidence, evidence_count, first_evidence_id"


@query("q01_relation_map", f"WITH {A.KEPT_EVIDENCE},{A.RELATION_MAP} SELECT {_REL} FROM rel")
def relation_map(spark, sf_dir):
    return evidence.relation_map(_kept(spark, sf_dir))


_SHEET = """sheet AS (
  SELECT manuscript_id, character_id, key, value_norm, max(confidence) AS confidence, count(*) AS evidence_count, arg_min(evidence_id, narrative_order) AS first_evidence_id,
    CASE WHEN key = 'status' THEN 'stateful' ELSE 'static' END AS attr_class FROM ak GROUP BY manuscript_id, character_id, key, value_norm
)"""


def _sheet(spark, sf_dir):
    return evidence.attribute_sheet(evidence.strongest(A.attribute_evidence(spark, sf_dir), ["scene_id", "character_id", "key"], "narrative_order"))


@query("q02_attribute_sheet", f"WITH {A.ATTRIBUTE_EVIDENCE}, {_SHEET} SELECT * FROM sheet")
def attribute_sheet(spark, sf_dir):
    return _sheet(spark, sf_dir)


@query(
    "q03_normalize_hash",
    r"""SELECT doc_id, sha256(t) AS content_id, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
def normalize_hash(spark, sf_dir):
    t = A.table(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("content_id"), F.length("t").cast("long").alias("n"))


@query(
    "q04_snippet_wordcount",
    r"""SELECT doc_id, CAST(len(list_filter(w, lambda x: x <> '')) AS BIGINT) AS word_count, substr(array_to_string(list_filter(w, lambda x: x <> ''), ' '), 1, 120) AS snippet FROM (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents)""",
)
def snippet_wordcount(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("word_count"), text.snippet(F.col("text")).alias("snippet"))


@query(
    "q05_chapter_segmentation",
    f"WITH {A.BLOCKS} SELECT mid AS manuscript_id, CAST(chapter_run AS BIGINT) AS chapter_run, CAST(order_narrative AS BIGINT) AS order_narrative, count(*) AS n_scenes, CAST(sum(char_count) AS BIGINT) AS chars FROM ord GROUP BY ALL",
)
def chapter_segmentation(spark, sf_dir):
    scenes = segmentation.with_ordinals(segmentation.raw_scenes(A.blocks(spark, sf_dir)))
    return longs(scenes.groupBy("manuscript_id", "chapter_run", "order_narrative").agg(F.count("*").alias("n_scenes"), F.sum("char_count").alias("chars")), "order_narrative", "chars")


@query("q06_scene_segmentation", f"WITH {A.BLOCKS} SELECT mid AS manuscript_id, CAST(chapter_run AS BIGINT) AS chapter_run, CAST(scene_run AS BIGINT) AS scene_run, boundary_reason, sha256(text) AS text_sha FROM scn WHERE text <> ''")
def scene_segmentation(spark, sf_dir):
    return segmentation.raw_scenes(A.blocks(spark, sf_dir)).select("manuscript_id", "chapter_run", "scene_run", "boundary_reason", F.sha2("text", 256).alias("text_sha"))


@query(
    "q07_offsets_ordinals",
    f"WITH {A.BLOCKS} SELECT content_id || ':c' || order_narrative || ':s' || order_in_chapter AS scene_id, content_id AS manuscript_id, CAST(global_order AS BIGINT) AS global_order, CAST(start_offset AS BIGINT) AS start_offset, CAST(start_offset + char_count AS BIGINT) AS end_offset FROM ord JOIN cid USING (mid)",
)
def offsets_ordinals(spark, sf_dir):
    scenes = segmentation.scene_table(A.blocks(spark, sf_dir))
    return scenes.select("scene_id", "manuscript_id", F.col("order_narrative_global").cast("long").alias("global_order"), "start_offset", F.col("end_offset").cast("long").alias("end_offset"))


@query(
    "q08_next_edges",
    f"WITH {A.BLOCKS}, x AS (SELECT mid AS manuscript_id, mid || ':' || global_order AS from_id, lead(mid || ':' || global_order) OVER (PARTITION BY mid ORDER BY global_order) AS to_id FROM ord) SELECT * FROM x WHERE to_id IS NOT NULL",
)
def next_edges(spark, sf_dir):
    scenes = segmentation.with_ordinals(segmentation.raw_scenes(A.blocks(spark, sf_dir)))
    return segmentation.next_edges(scenes.withColumn("id", F.concat("manuscript_id", F.lit(":"), F.col("order_narrative_global").cast("string"))), "id", "order_narrative_global")


_PARATEXT = r"""CASE WHEN contains(l, 'project gutenberg') OR contains(l, 'produced by') THEN 'license/gutenberg_marker' WHEN contains(l, 'copyright') OR contains(l, 'all rights reserved') THEN 'license/copyright_keyword'
WHEN contains(l, 'list of illustrations') OR contains(l, 'table of contents') OR contains(l, 'heading to chapter') OR contains(l, 'tailpiece') OR trim(l) IN ('contents', 'índice', 'indice') THEN 'toc/toc_heuristic' ELSE 'frontmatter/frontmatter_position' END"""


@query("q09_non_narrative_text", f"SELECT doc_id, {_PARATEXT} AS verdict FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def non_narrative_text(spark, sf_dir):
    said = text.paratext_kind(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", said.alias("said")).select("doc_id", F.concat_ws("/", "said.kind", "said.detected_by").alias("verdict"))


@query(
    "q10_run_merge_islands",
    """WITH d AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'toc' ELSE 'frontmatter' END AS kind, CASE WHEN turn % 5 = 0 THEN 'x' ELSE 'y' END AS by_, text FROM conversations),
r AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(by_) OVER w = by_ THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS block_no FROM r)
SELECT 'k' || conv_id AS manuscript_id, CAST(block_no AS BIGINT) AS block_no, min(kind) AS kind, min(by_) AS detected_by, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_sha FROM g GROUP BY conv_id, block_no""",
)
def run_merge_islands(spark, sf_dir):
    drafts = A.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("manuscript_id"),
        F.lit(0).alias("part"),
        F.col("turn").alias("pos"),
        F.when(F.length("text") % 3 == 0, "toc").otherwise("frontmatter").alias("kind"),
        F.when(F.col("turn") % 5 == 0, "x").otherwise("y").alias("detected_by"),
        "text",
    )
    return segmentation.merged_runs(drafts).select("manuscript_id", F.col("block_no").cast("long").alias("block_no"), "kind", "detected_by", F.sha2("text", 256).alias("text_sha"))


_LINES = ("* * *", "CHAPTER IV", "Capítulo 12.", "CAPÍTULO I]", "chapter one", "Prólogo", "EPILOGUE.", "Interludio:", "— — —", "***x", "", "   ", "# § •", "chap 3)", "Prologue to war")
_LINE_ROWS = ", ".join(f"({-1 - i}, '{line}')" for i, line in enumerate(_LINES))


@query(
    "q11_heading_predicates",
    f"""WITH x AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT * FROM (VALUES {_LINE_ROWS}) v(id, line))
SELECT CAST(id AS BIGINT) AS id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(trim(line, ' \t'), '^[*·~—#§•\\-–_ \\t]+$')) AS n_separators,
count(*) FILTER (WHERE regexp_matches(line, '(?i)^\\s*(CHAPTER|CHAP|CAP[IÍ]TULO)\\s+([IVXLCDM]+|\\d+)\\b[.\\])\\s]*$')) AS n_chapters,
count(*) FILTER (WHERE regexp_matches(line, '(?i)^\\s*(PROLOGUE|PRÓLOGO|PROLOGO|EPILOGUE|EPÍLOGO|EPILOGO|INTERLUDE|INTERLUDIO)\\b[.\\s:]*$')) AS n_specials FROM x GROUP BY id""",
)
def heading_predicates(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    own = spark.createDataFrame([(-1 - i, line) for i, line in enumerate(_LINES)], "id long, line string")
    line = F.col("line")
    return docs.unionAll(own).groupBy("id").agg(
        F.count("*").alias("n_lines"), F.count_if(text.is_separator(line)).alias("n_separators"), F.count_if(text.is_chapter_heading(line)).alias("n_chapters"), F.count_if(text.is_special_heading(line)).alias("n_specials")
    )


_SURFACES = ("The", "ment", "ung", "License", "idiot", "ción")


@query(
    "q12_mention_location",
    f"""SELECT doc_id, surface, CAST(p - 1 AS BIGINT) AS start_offset, CAST(p - 1 + length(surface) AS BIGINT) AS end_offset, 'd' || doc_id || ':mn:' || substr(sha256('d' || doc_id || '::' || surface || '::' || (p - 1)), 1, 16) AS mention_id
FROM (SELECT doc_id, surface, instr(text, surface) AS p FROM documents, (VALUES {", ".join(f"('{s}')" for s in _SURFACES)}) v(surface)) WHERE p > 0""",
)
def mention_location(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, _SURFACES))).alias("surface"))
    placed = rows.select("doc_id", "surface", text.offset_of(F.col("text"), F.col("surface")).alias("start")).where("start is not null")
    scene = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return placed.select("doc_id", "surface", F.col("start").cast("long").alias("start_offset"), (F.col("start") + F.length("surface")).cast("long").alias("end_offset"), ids.mention_id(scene, F.col("surface"), F.col("start")).alias("mention_id"))


def _suppliers(spark, sf_dir):
    return A.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("character_id"), F.col("s_name").alias("canonical_name"), F.when(F.col("s_nationkey") % 7 == 0, "animal").when(F.col("s_nationkey") % 7 == 1, F.lit(None)).otherwise("person").alias("entity_kind")
    )


def _appearances(spark, sf_dir):
    lines = A.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("character_id"), F.col("l_orderkey").alias("scene_id")).agg(F.when(F.max((F.col("l_returnflag") == "N").cast("int")) == 1, "present").otherwise("mentioned").alias("kind"))


def _mentions(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("character_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("start_offset"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("mention_id"),
        F.concat("l_returnflag", "l_linestatus").alias("quote"),
    ).where("start_offset % 2 = 1")


_CAST_SQL = """WITH c AS (SELECT DISTINCT l_orderkey AS scene_id, s_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey % 7 <> 0)"""


@query("q13_scene_casts", _CAST_SQL + " SELECT scene_id, string_agg(s_name, ',' ORDER BY s_name, s_suppkey) AS members, count(*) AS n FROM c GROUP BY scene_id")
def scene_casts(spark, sf_dir):
    found = evidence.scene_casts(_appearances(spark, sf_dir), _suppliers(spark, sf_dir))
    return found.select("scene_id", F.array_join(F.transform("cast", lambda c: c["canonical_name"]), ",").alias("members"), F.size("cast").cast("long").alias("n"))


@query("q14_cast_size_filter", _CAST_SQL + ", n AS (SELECT scene_id, count(*) AS n FROM c GROUP BY scene_id) SELECT n AS cast_size, count(*) AS scenes FROM n WHERE n >= 2 GROUP BY n")
def cast_size_filter(spark, sf_dir):
    found = evidence.scene_casts(_appearances(spark, sf_dir), _suppliers(spark, sf_dir)).where(F.size("cast") >= 2)
    return found.groupBy(F.size("cast").cast("long").alias("cast_size")).agg(F.count("*").alias("scenes"))


_APP_SQL = """ap AS (SELECT l_suppkey AS character_id, l_orderkey AS scene_id, CASE WHEN max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 THEN 'present' ELSE 'mentioned' END AS kind FROM lineitem GROUP BY ALL),
me AS (SELECT l_suppkey AS character_id, l_orderkey AS scene_id, l_linenumber AS start_offset, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS mention_id, l_returnflag || l_linestatus AS quote FROM lineitem WHERE l_linenumber % 2 = 1)"""


@query(
    "q15_counters",
    f"""WITH {_APP_SQL}, m AS (SELECT character_id, count(*) AS n FROM me GROUP BY ALL), a AS (SELECT character_id, count(*) AS n, count(*) FILTER (WHERE kind = 'present') AS p FROM ap GROUP BY ALL)
SELECT s_suppkey AS character_id, coalesce(m.n, 0) AS mention_count, coalesce(a.n, 0) AS appearance_count, coalesce(p, 0) = 0 AS is_mentioned_only FROM supplier LEFT JOIN m ON m.character_id = s_suppkey LEFT JOIN a ON a.character_id = s_suppkey""",
)
def counters(spark, sf_dir):
    return evidence.character_counters(_suppliers(spark, sf_dir), _mentions(spark, sf_dir), _appearances(spark, sf_dir))


@query(
    "q15b_appearance_counters",
    f"""WITH {_APP_SQL}, m AS (SELECT character_id, scene_id, count(*) AS n, arg_min(mention_id, {{'o': start_offset, 'm': mention_id}}) AS f FROM me GROUP BY ALL)
SELECT character_id, scene_id, kind, coalesce(n, 0) AS mention_count, f AS first_mention_id FROM ap LEFT JOIN m USING (character_id, scene_id)""",
)
def appearance_counters(spark, sf_dir):
    return evidence.appearance_counters(_appearances(spark, sf_dir), _mentions(spark, sf_dir))


@query(
    "q16_first_appearance",
    f"""WITH {_APP_SQL}, f AS (SELECT character_id, arg_min(scene_id, {{'d': o_orderdate, 'k': o_orderkey}}) AS scene_id FROM ap JOIN orders ON o_orderkey = scene_id GROUP BY ALL),
q AS (SELECT character_id, scene_id, arg_min(quote, {{'o': start_offset, 'm': mention_id}}) AS quote FROM me GROUP BY ALL)
SELECT f.character_id, f.scene_id, quote FROM f LEFT JOIN q USING (character_id, scene_id)""",
)
def first_appearance(spark, sf_dir):
    scenes = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.struct("o_orderdate", "o_orderkey").alias("order_narrative_global"))
    return evidence.first_appearances(_appearances(spark, sf_dir), scenes, _mentions(spark, sf_dir)).select("character_id", "scene_id", "quote")


_ROLES = {"BUILDING": "protagonist", "MACHINERY": "antagonist", "HOUSEHOLD": "secondary", "FURNITURE": "minor"}


def _customers(spark, sf_dir):
    """Customers as characters; their orders are appearances, every third one a mere mention."""
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _ROLES.items() for x in p]), F.col("c_mktsegment")), F.lit("unknown"))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("character_id"), F.col("c_name").alias("canonical_name"), role.alias("role"))


def _customer_appearances(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("character_id"), F.col("o_orderkey").alias("scene_id"), F.when(F.col("o_orderkey") % 3 == 0, "mentioned").otherwise("present").alias("kind"))


_ROLE_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'protagonist' WHEN 'MACHINERY' THEN 'antagonist' WHEN 'HOUSEHOLD' THEN 'secondary' WHEN 'FURNITURE' THEN 'minor' ELSE 'unknown' END"


@query(
    "q17_character_list_filters",
    f"""WITH a AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS present, min(o_orderkey) AS first_scene FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS character_id, c_name AS canonical_name, {_ROLE_SQL} AS role, coalesce(n, 0) AS appearance_count, coalesce(present, 0) = 0 AS is_mentioned_only, first_scene FROM customer LEFT JOIN a ON k = c_custkey)
SELECT character_id, canonical_name, appearance_count, first_scene, row_number() OVER (ORDER BY appearance_count DESC, canonical_name, character_id) AS place FROM c WHERE role = 'protagonist' AND NOT is_mentioned_only""",
)
def character_list_filters(spark, sf_dir):
    return reads.character_list(_customers(spark, sf_dir), _customer_appearances(spark, sf_dir), role="protagonist", include_mentioned_only=False)


@query(
    "q18_character_detail",
    "SELECT c_custkey AS character_id, count(o_orderkey) AS n_appearances, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS scenes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def character_detail(spark, sf_dir):
    scenes = _customer_appearances(spark, sf_dir).withColumn("order_narrative_global", F.col("scene_id"))
    found = reads.character_detail(_customers(spark, sf_dir), scenes)
    return found.select("character_id", F.size("appearances").cast("long").alias("n_appearances"), F.array_join(F.transform("appearances", lambda a: a["scene_id"].cast("string")), ",").alias("scenes"))


@query(
    "q19_structure_summary",
    f"""WITH {A.BLOCKS}, c AS (SELECT mid, order_narrative, string_agg('s' || order_in_chapter || '@' || start_offset, ',' ORDER BY order_in_chapter) AS scenes FROM ord GROUP BY ALL),
n AS (SELECT mid, count(*) AS n FROM bl WHERE source_role IS NOT NULL AND kind <> 'separator' GROUP BY ALL)
SELECT c.mid AS manuscript_id, string_agg('c' || order_narrative || '[' || scenes || ']', ';' ORDER BY order_narrative) AS structure, count(*) AS n_chapters FROM c GROUP BY 1""",
)
def structure_summary(spark, sf_dir):
    nested = reads.structure(segmentation.with_ordinals(segmentation.raw_scenes(A.blocks(spark, sf_dir))))
    scene = lambda s: F.concat(F.lit("s"), s["order_in_chapter"].cast("string"), F.lit("@"), s["start_offset"].cast("string"))
    chapter = lambda c: F.concat(F.lit("c"), c["order_narrative"].cast("string"), F.lit("["), F.array_join(F.transform(c["scenes"], scene), ","), F.lit("]"))
    return nested.select("manuscript_id", F.array_join(F.transform("chapters", chapter), ";").alias("structure"), F.size("chapters").cast("long").alias("n_chapters"))


@query(
    "q20_top3_quotes",
    """WITH q AS (SELECT role || conv_id AS character_id, substr(text, 1, 300) AS quote, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) AS rank FROM conversations WHERE text IS NOT NULL AND text <> '')
SELECT character_id, CAST(rank AS BIGINT) AS rank, quote FROM q WHERE rank <= 3""",
)
def top3_quotes(spark, sf_dir):
    said = A.table(spark, sf_dir, "conversations").select(F.concat("role", F.col("conv_id").cast("string")).alias("character_id"), F.col("turn").alias("mention_id"), F.col("text").alias("quote"))
    return evidence.top_quotes(said, F.col("mention_id")).select("character_id", F.col("rank").cast("long").alias("rank"), F.substring("quote", 1, 300).alias("quote"))


def _old_and_new(spark, sf_dir):
    base = A.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("character_id"),
        F.col("c_name").alias("canonical_name"),
        F.array("c_mktsegment").alias("aliases"),
        F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise("minor").alias("role"),
        (F.col("c_custkey") % 8 == 0).alias("is_mentioned_only"),
        F.lit("person").alias("entity_kind"),
    )
    new = base.where("character_id % 3 = 0").withColumn("aliases", F.array(F.concat(F.col("aliases")[0], F.lit("!")))).withColumn("role", F.lit("secondary")).withColumn("is_mentioned_only", F.col("character_id") % 5 == 0).withColumn("entity_kind", F.lit("animal"))
    return base.where("character_id % 2 = 0"), new


@query(
    "q21_upsert_characters",
    """WITH b AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS alias, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'minor' END AS role, c_custkey % 8 = 0 AS m FROM customer),
o AS (SELECT * FROM b WHERE k % 2 = 0), n AS (SELECT k, name, alias || '!' AS alias, 'secondary' AS role, k % 5 = 0 AS m FROM b WHERE k % 3 = 0)
SELECT coalesce(o.k, n.k) AS character_id, coalesce(o.name, n.name) AS canonical_name, coalesce(n.alias, o.alias) AS aliases, CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND o.role = 'unknown' THEN n.role ELSE coalesce(o.role, n.role) END AS role,
CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN o.m AND n.m ELSE coalesce(o.m, n.m) END AS is_mentioned_only, CASE WHEN o.k IS NOT NULL THEN 'person' ELSE 'animal' END AS entity_kind FROM o FULL JOIN n ON o.k = n.k""",
)
def upsert_characters(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return upsert.upserted_characters(old, new).withColumn("aliases", F.array_join("aliases", ","))


@query(
    "q22_upsert_insert_only",
    """SELECT c_custkey AS character_id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
)
def upsert_insert_only(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    keep = lambda d, origin: d.select("character_id", F.lit(origin).alias("origin"))
    return upsert.inserted(keep(old, "old"), keep(new, "new"), ["character_id"])


@query(
    "q23_replace_derived",
    f"WITH {A.KEPT_EVIDENCE},{A.RELATION_MAP} SELECT {_REL} FROM rel WHERE manuscript_id IN ('m0', 'm1', 'm2') UNION ALL SELECT manuscript_id, a, b, 'stale', NULL, NULL, NULL, NULL, NULL, 0, NULL FROM (SELECT DISTINCT manuscript_id, a, b FROM kept WHERE manuscript_id NOT IN ('m0', 'm1', 'm2'))",
)
def replace_derived(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    new = evidence.relation_map(kept.where("manuscript_id in ('m0', 'm1', 'm2')"))
    pairs = kept.select("manuscript_id", "character_a_id", "character_b_id").distinct()
    fixed = {"rel_type": F.lit("stale"), "evidence_count": F.lit(0).cast("long"), **{c: F.lit(None).cast("string") for c in ("descriptor", "role_a", "role_b", "provenance", "first_evidence_id")}, "confidence": F.lit(None).cast("double")}
    old = pairs.withColumns(fixed).select(*new.columns)
    return upsert.replaced(old, new, kept.where("manuscript_id in ('m0', 'm1', 'm2')").select("manuscript_id"))


@query(
    "q24_merge_accept",
    """WITH m AS (SELECT c_custkey AS f, c_custkey - 7 AS t FROM customer WHERE c_custkey % 10 = 7),
ap AS (SELECT o_custkey AS k, o_orderkey // 8 AS scene_id, CASE WHEN max(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) = 1 THEN 'present' ELSE 'mentioned' END AS kind, count(*) AS n FROM orders GROUP BY ALL),
mv AS (SELECT coalesce(t, k) AS character_id, scene_id, kind, n, t IS NULL AS own FROM ap LEFT JOIN m ON f = k),
s AS (SELECT character_id, scene_id, arg_max(kind, {'o': own, 'p': kind = 'present'}) AS kind, sum(n) AS n FROM mv GROUP BY ALL),
g AS (SELECT character_id, count(*) AS n_scenes, count(*) FILTER (WHERE kind = 'present') AS n_present, CAST(sum(n) AS BIGINT) AS mention_count FROM s GROUP BY ALL),
p AS (SELECT c_custkey AS character_id, c_name AS canonical_name FROM customer WHERE c_custkey % 10 <> 7)
SELECT p.character_id, canonical_name, coalesce(b.c_name, '') AS aliases, coalesce(n_scenes, 0) AS n_scenes, coalesce(n_present, 0) AS n_present, coalesce(mention_count, 0) AS mention_count
FROM p LEFT JOIN g ON g.character_id = p.character_id LEFT JOIN m ON m.t = p.character_id LEFT JOIN customer b ON b.c_custkey = m.f""",
)
def merge_accept(spark, sf_dir):
    people = _customers(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))
    merges = people.where("character_id % 10 = 7").select(F.col("character_id").alias("from_id"), (F.col("character_id") - 7).alias("to_id"))
    seen = _customer_appearances(spark, sf_dir).groupBy("character_id", F.expr("scene_id div 8").alias("scene_id")).agg(F.when(F.max((F.col("kind") == "present").cast("int")) == 1, "present").otherwise("mentioned").alias("kind"), F.count("*").alias("mention_count"))
    left, _, moved = upsert.accepted(people, seen.select("character_id", F.col("scene_id").alias("mention_id")), seen, merges)
    per = moved.groupBy("character_id").agg(F.count("*").alias("n_scenes"), F.count_if(F.col("kind") == "present").alias("n_present"), F.sum("mention_count").alias("mention_count"))
    out = left.join(per, "character_id", "left").select("character_id", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "n_scenes", "n_present", "mention_count")
    return out.fillna(0, ["n_scenes", "n_present", "mention_count"])


def _candidates(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("character_a_id"), (F.col("s_suppkey") + 1).alias("character_b_id"), (F.col("s_nationkey") / 25.0).alias("confidence"),
        F.when(F.col("s_suppkey") % 3 == 0, "pending").when(F.col("s_suppkey") % 3 == 1, "accepted").otherwise("rejected").alias("status"),
        ids.merge_candidate_id(F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")).alias("candidate_id"),
    )


@query(
    "q25_merge_queue",
    """WITH c AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b, s_nationkey / CAST(25 AS DOUBLE) AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status FROM supplier)
SELECT a AS character_a_id, x.s_name AS name_a, b AS character_b_id, y.s_name AS name_b, confidence, row_number() OVER (ORDER BY confidence DESC, a) AS place FROM c JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE status = 'pending'""",
)
def merge_queue(spark, sf_dir):
    return reads.merge_queue(_candidates(spark, sf_dir), _suppliers(spark, sf_dir), "pending").select("character_a_id", "name_a", "character_b_id", "name_b", "confidence", "place")


@query(
    "q26_canonical_pair_ids",
    """WITH s AS (SELECT s_name AS x, 'Supplier#' || lpad(CAST((s_suppkey * 7) % 10 AS VARCHAR), 9, '0') AS y, 'sc' || (s_suppkey % 5) AS scene FROM supplier)
SELECT x, y, least(x, y) AS a, greatest(x, y) AS b, 'mc:' || substr(sha256(least(x, y) || '::' || greatest(x, y)), 1, 16) AS candidate_id, scene || ':re:' || substr(sha256(least(x, y) || '::' || greatest(x, y)), 1, 16) AS evidence_id FROM s""",
)
def canonical_pair_ids(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("x"), F.concat(F.lit("Supplier#"), F.lpad(((F.col("s_suppkey") * 7) % 10).cast("string"), 9, "0")).alias("y"), F.concat(F.lit("sc"), (F.col("s_suppkey") % 5).cast("string")).alias("scene"))
    a, b = ids.canonical_pair(F.col("x"), F.col("y"))
    return s.select("x", "y", a.alias("a"), b.alias("b"), ids.merge_candidate_id(F.col("x"), F.col("y")).alias("candidate_id"), ids.relation_evidence_id(F.col("scene"), F.col("x"), F.col("y")).alias("evidence_id"))


@query(
    "q27_attribute_ids",
    """SELECT p_partkey, 'p' || p_partkey || ':ae:' || substr(sha256(p_name || '::' || p_type), 1, 16) AS evidence_id, p_name || ':attr:' || p_type || ':' || substr(sha256(p_brand), 1, 16) AS attribute_id, p_brand || ':ch:' || substr(sha256(p_brand || '::' || p_name), 1, 16) AS character_id FROM part""",
)
def attribute_ids(spark, sf_dir):
    scene = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", ids.attribute_evidence_id(scene, F.col("p_name"), F.col("p_type")).alias("evidence_id"), ids.attribute_id(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("attribute_id"), ids.character_id(F.col("p_brand"), F.col("p_name")).alias("character_id")
    )


@query("q28_cache_keys", "SELECT doc_id, sha256(text || '4' || 'some/model' || '3') AS scene_key, sha256(text || lang || ',' || source || '1' || 'some/model' || '1') AS cast_key FROM documents")
def cache_keys(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", ids.response_key(F.col("text"), "4", "some/model", "3").alias("scene_key"), ids.response_key(F.col("text"), "1", "some/model", "1", F.array("source", "lang")).alias("cast_key")
    )


@query("q29_cache_hit_miss", "SELECT doc_id, NOT (doc_id % 3 = 0 OR doc_id % 5 = 0) AS hit, CASE WHEN NOT (doc_id % 3 = 0 OR doc_id % 5 = 0) THEN 'n' || doc_id END AS notes FROM documents")
def cache_hit_miss(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.sha2("text", 256), F.col("doc_id").cast("string")).alias("cache_key"))
    good = F.to_json(F.struct(F.array().cast("array<string>").alias("present_entities"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("notes")))
    store = docs.where("doc_id % 3 <> 0").select("cache_key", F.when(F.col("doc_id") % 5 == 0, "{broken").otherwise(good).alias("payload"))
    found = responses.looked_up(docs, store, EXTRACTION, F.col("response.present_entities").isNotNull())
    return found.select("doc_id", F.col("hit"), F.col("response.notes").alias("notes"))


@query(
    "q30_name_fold",
    r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[\s.,;:!?|"()*#$%&<>=-]+')) AS word FROM documents) SELECT word, lower(trim(regexp_replace(strip_accents(word), '[^\x00-\x7F]', '', 'g'))) AS folded FROM w WHERE word <> ''""",
)
def name_fold(spark, sf_dir):
    words = A.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"""[\s.,;:!?|"()*#$%&<>=-]+""")).alias("word")).where("word <> ''").distinct()
    return words.select("word", names.fold(F.col("word")).alias("folded"))


_TITLES = ("Mr. ", "Mrs ", "", "Dr. ", "Lady ")


@query(
    "q31_honorific_split_lookup",
    """WITH n AS (SELECT c_custkey AS k, ['mr', 'mrs', '', 'dr', 'lady'][(c_custkey % 5) + 1] AS honorific, lower('Customer ' || (c_custkey % 100)) AS base FROM customer),
f AS (SELECT base, honorific, min(k) AS canonical FROM n WHERE k % 7 = 0 GROUP BY ALL), b AS (SELECT base, count(*) AS forms, count(*) FILTER (WHERE honorific <> '') AS titled, min(canonical) FILTER (WHERE honorific = '') AS plain, min(canonical) AS one FROM f GROUP BY ALL)
SELECT n.k AS custkey, n.honorific, n.base, coalesce(f.canonical, CASE WHEN n.honorific <> '' AND titled = 0 THEN plain WHEN n.honorific = '' AND forms = 1 THEN one END) AS canonical FROM n LEFT JOIN f USING (base, honorific) LEFT JOIN b ON b.base = n.base""",
)
def honorific_split_lookup(spark, sf_dir):
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("c_custkey") % 5).cast("int"))
    named = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), names.split_honorific(names.fold(F.concat(title, F.lit("Customer "), (F.col("c_custkey") % 100).cast("string")))).alias("s")).select("custkey", "s.honorific", "s.base")
    forms = named.where("custkey % 7 = 0").groupBy("base", "honorific").agg(F.min("custkey").alias("canonical"))
    return resolution.lookup(named, forms).select("custkey", "honorific", "base", "canonical")


_ALIAS_CASES = (
    ("Ana", True), ("she", False), ("ella", False), ("her friend", False), ("la madre", False), ("mamma", False), ("Mr. Darcy", True), ("el anciano", False), ("the waiter", False), ("hermana de Carlos", False),
    ("Juan's mother", False), ("Beatriz Solis", True), ("un Hombre", True), ("", False), ("   ", False), ("Tía Rosa", True), ("my Sister", False), ("Señor Ruiz", True), ("of the North", True), ("boy", False),
)
_ALIAS_ROWS = ", ".join("('{}', {})".format(a.replace("'", "''"), str(v).lower()) for a, v in _ALIAS_CASES)


@query("q32_alias_validity", f"SELECT alias, valid, regexp_matches(trim(alias), '(?i)^(los|las|unos|unas|the|some|all|every|those|these|a group|el grupo|la multitud|todos|todas|varios|varias)\\b') AS collective FROM (VALUES {_ALIAS_ROWS}) v(alias, valid)")
def alias_validity(spark, sf_dir):
    rows = spark.createDataFrame([(a,) for a, _ in _ALIAS_CASES], "alias string")
    return rows.select("alias", names.is_valid_alias(F.col("alias")).alias("valid"), names.is_collective(F.col("alias")).alias("collective"))


@query(
    "q33_similarity_verdict",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, unnest(string_split(name, ' ')) AS tok FROM n), p AS (SELECT DISTINCT x.name AS a, y.name AS b FROM t x JOIN t y USING (tok) WHERE x.name <= y.name),
s AS (SELECT a, b, CASE WHEN length(a) < length(b) THEN a ELSE b END AS short, CASE WHEN length(a) < length(b) THEN b ELSE a END AS long FROM p)
SELECT a, b, CASE WHEN a = b OR contains(a, b) OR contains(b, a) THEN true WHEN contains(a, ' ') AND contains(b, ' ') AND string_split(a, ' ')[-1] = string_split(b, ' ')[-1] THEN true ELSE false END AS similar,
CASE WHEN a = b THEN true WHEN contains(a, b) OR contains(b, a) THEN NOT (contains(long, ' ') AND short = string_split(long, ' ')[-1]) WHEN contains(a, ' ') AND contains(b, ' ') AND string_split(a, ' ')[-1] = string_split(b, ' ')[-1] THEN string_split(a, ' ')[1:-2] = string_split(b, ' ')[1:-2] ELSE false END AS auto FROM s""",
)
def similarity_verdict(spark, sf_dir):
    distinct = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    tokens = distinct.select("name", F.explode(F.split("name", " ")).alias("tok"))
    pairs = tokens.select(F.col("name").alias("a"), "tok").join(tokens.select(F.col("name").alias("b"), "tok"), "tok").where("a <= b").select("a", "b").distinct()
    said = names.similarity(names.split_honorific(names.fold(F.col("a"))), names.split_honorific(names.fold(F.col("b"))))
    return pairs.select("a", "b", said.alias("s")).select("a", "b", "s.similar", "s.auto")


def _resolution_tables(spark, sf_dir):
    """Candidates, decisions and judgements from part names by fixed arithmetic; a manuscript is 25 part keys in a row."""
    parts = A.table(spark, sf_dir, "part").withColumn("words", F.split(F.initcap("p_name"), " "))
    name = F.when(F.col("p_partkey") % 7 == 0, F.element_at("words", 1)).otherwise(F.array_join("words", " "))
    first = parts.groupBy(F.floor(F.col("p_partkey") / 25).cast("string").alias("manuscript_id"), name.alias("canonical_name")).agg(F.min("p_partkey").alias("scene_order"))
    alias = F.array(F.element_at(F.split("canonical_name", " "), 1))
    candidates = first.select(
        "manuscript_id", "scene_order", F.lit(0).cast("long").alias("pos"), "canonical_name", F.when(F.col("scene_order") % 3 == 0, alias).otherwise(F.array().cast("array<string>")).alias("aliases"), F.lit("minor").alias("role"), F.lit("person").alias("entity_kind")
    )
    side = lambda c: first.select("manuscript_id", F.col("canonical_name").alias(f"name_{c}"), F.col("scene_order").alias(c))
    pairs = side("a").join(side("b"), "manuscript_id").where((F.col("name_a") < F.col("name_b")) & F.arrays_overlap(F.split("name_a", " "), F.split("name_b", " "))).withColumn("key", F.col("a") * 31 + F.col("b") * 17)
    judgements = pairs.select("manuscript_id", "name_a", "name_b", (F.col("key") % 3 != 0).alias("same_entity"), ((40 + F.col("key") % 61) / 100).alias("confidence"), F.concat(F.lit("r"), F.col("key").cast("string")).alias("rationale"))
    decisions = pairs.where("key % 11 < 2").select("manuscript_id", "name_a", "name_b", F.when(F.col("key") % 11 == 0, "accepted").otherwise("rejected").alias("status"))
    return candidates, decisions, judgements


@query(
    "q34_resolution_fold",
    """WITH RECURSIVE p AS (SELECT p_partkey, p_partkey // 25 AS m, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])) AS w FROM part),
f AS (SELECT m, CASE WHEN p_partkey % 7 = 0 THEN w[1] ELSE array_to_string(w, ' ') END AS name, min(p_partkey) AS s FROM p GROUP BY 1, 2),
pr AS (SELECT a.m, a.name AS na, b.name AS nb, a.s * 31 + b.s * 17 AS key, lower(a.name) AS x, lower(b.name) AS y FROM f a JOIN f b ON a.m = b.m AND a.name < b.name WHERE list_has_any(string_split(a.name, ' '), string_split(b.name, ' '))),
sm AS (SELECT *, CASE WHEN length(x) < length(y) THEN x ELSE y END AS short, CASE WHEN length(x) < length(y) THEN y ELSE x END AS long, contains(x, ' ') AND contains(y, ' ') AND string_split(x, ' ')[-1] = string_split(y, ' ')[-1] AS family FROM pr),
au AS (SELECT *, contains(long, short) OR family AS alike, CASE WHEN contains(long, short) THEN NOT (contains(long, ' ') AND short = string_split(long, ' ')[-1]) ELSE string_split(x, ' ')[1:-2] = string_split(y, ' ')[1:-2] END AS auto FROM sm),
sd AS (SELECT m, na, nb, CASE WHEN key % 11 = 0 THEN 'accepted' ELSE 'judged' END AS status, (40 + key % 61) / CAST(100 AS DOUBLE) AS conf, auto, 'r' || key AS why FROM au WHERE key % 11 <> 1 AND (key % 11 = 0 OR alike AND key % 3 <> 0 AND 40 + key % 61 >= 50)),
td AS (SELECT m, name, list({'known': known, 'status': status, 'conf': conf, 'auto': auto, 'why': why}) AS told FROM (SELECT m, na AS name, nb AS known, status, conf, auto, why FROM sd UNION ALL SELECT m, nb, na, status, conf, auto, why FROM sd) GROUP BY 1, 2),
c AS MATERIALIZED (SELECT f.m, f.name, f.s, CASE WHEN f.s % 3 = 0 THEN [string_split(f.name, ' ')[1]] ELSE CAST([] AS VARCHAR[]) END AS al, told, row_number() OVER (PARTITION BY f.m ORDER BY f.s) AS i FROM f LEFT JOIN td ON td.m = f.m AND td.name = f.name),
st(m, i, forms, entries, aliases, s, name, resolved, outcome, conf, why) AS (
  SELECT DISTINCT m, CAST(0 AS BIGINT), CAST([] AS STRUCT(b VARCHAR, c VARCHAR)[]), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(e VARCHAR, a VARCHAR)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM c
  UNION ALL
  SELECT m, i, list_concat(forms, list_transform(CASE WHEN outcome = 'merged' THEN list_concat(list_transform(list_filter(aliases, lambda q: q.e = entity), lambda q: q.a), al) ELSE list_concat([name], al) END, lambda v: {'b': lower(v), 'c': entity})),
    CASE WHEN outcome = 'merged' THEN entries ELSE list_append(entries, name) END, list_concat(aliases, list_transform(list_filter(al, lambda v: outcome <> 'merged' OR v <> entity), lambda v: {'e': entity, 'a': v})), s, name, coalesce(target, name), outcome,
    CASE WHEN t IS NULL AND pick.status = 'judged' THEN pick.conf END, CASE WHEN t IS NULL AND pick.status = 'judged' THEN pick.why END
  FROM (SELECT *, CASE WHEN outcome = 'merged' THEN list_filter(forms, lambda q: q.b = lower(target))[-1].c ELSE name END AS entity
  FROM (SELECT *, coalesce(t, pick.known) AS target, CASE WHEN t IS NOT NULL THEN 'merged' WHEN pick IS NULL THEN 'new' WHEN pick.status = 'accepted' OR pick.auto AND pick.conf >= 0.9 THEN 'merged' ELSE 'queued' END AS outcome
  FROM (SELECT *, CASE WHEN t IS NULL THEN list_sort(list_transform(list_filter(told, lambda q: list_contains(entries, q.known)), lambda q: {'at': list_position(entries, q.known), 'known': q.known, 'status': q.status, 'conf': q.conf, 'auto': q.auto, 'why': q.why}))[1] END AS pick
  FROM (SELECT st.m, c.i, forms, entries, aliases, c.s, c.name, c.al, c.told, coalesce(list_filter(forms, lambda q: q.b = lower(c.name))[-1].c, list_filter(forms, lambda q: q.b = lower(c.al[1]))[-1].c) AS t FROM st JOIN c ON c.m = st.m AND c.i = st.i + 1)))))
SELECT CAST(m AS VARCHAR) AS manuscript_id, s AS scene_order, CAST(0 AS BIGINT) AS pos, name AS canonical_name, resolved AS resolved_name, outcome, conf AS confidence, why AS rationale FROM st WHERE i > 0""",
)
def resolution_fold(spark, sf_dir):
    """Part names as candidates of manuscripts of 25 part keys, which bound the fold, with stored decisions and judgements."""
    found = resolution.resolved(*_resolution_tables(spark, sf_dir))
    return found.drop("linked_name", "written", "known_aliases")


def _gold_and_predicted(spark, sf_dir):
    """A work is a conversation; its gold and predicted entities are named by first words of its turns."""
    turns = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), F.col("turn"), names.fold(F.element_at(F.split("text", r"\s+"), 1)).alias("n1"), names.fold(F.coalesce(F.try_element_at(F.split("text", r"\s+"), F.lit(2)), F.lit(""))).alias("n2"))
    side = lambda k: turns.where(F.col("turn") % 2 == k).select("work", F.col("turn").alias("id"), F.array("n1", "n2").alias("names"))
    return side(0), side(1)


@query(
    "q35_detection_f1",
    r"""WITH RECURSIVE t AS (SELECT conv_id AS work, turn AS id, list_transform([w[1], coalesce(w[2], '')], lambda x: lower(regexp_replace(strip_accents(x), '[^\x00-\x7F]', '', 'g'))) AS names FROM (SELECT *, regexp_split_to_array(text, '\s+') AS w FROM conversations)),
n AS (SELECT DISTINCT work, id, unnest(names) AS name FROM t), e AS (SELECT p.work, p.id AS p, list_sort(list_distinct(list(g.id))) AS golds FROM n p JOIN n g ON g.work = p.work AND g.name = p.name WHERE p.name <> '' AND p.id % 2 = 1 AND g.id % 2 = 0 GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY work ORDER BY p) AS i FROM e), s(work, i, taken) AS (SELECT DISTINCT work, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o
  UNION ALL SELECT s.work, o.i, CASE WHEN len(list_filter(golds, lambda g: NOT list_contains(taken, g))) > 0 THEN list_append(taken, list_filter(golds, lambda g: NOT list_contains(taken, g))[1]) ELSE taken END FROM s JOIN o ON o.work = s.work AND o.i = s.i + 1),
m AS (SELECT work, max(len(taken)) AS tp FROM s GROUP BY work), c AS (SELECT work, count(*) FILTER (WHERE id % 2 = 0) AS n_gold, count(*) FILTER (WHERE id % 2 = 1) AS n_pred, coalesce(max(tp), 0) AS tp FROM t LEFT JOIN m USING (work) GROUP BY work),
r AS (SELECT work, CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred WHEN n_gold = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN n_gold > 0 THEN CAST(tp AS DOUBLE) / n_gold WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END AS re FROM c)
SELECT work, round(CAST(pr AS DOUBLE), 9) AS precision, round(CAST(re AS DOUBLE), 9) AS recall, CASE WHEN pr + re = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(2 * pr * re / (pr + re) AS DOUBLE), 9) END AS f1 FROM r""",
)
def detection_f1(spark, sf_dir):
    """Turns of a conversation in order take the first free turn of the other side that begins with a common word."""
    gold, predicted = _gold_and_predicted(spark, sf_dir)
    name = lambda d, c: d.select("work", F.col("id").alias(c), F.explode(F.array_distinct("names")).alias("name")).where("name <> ''")
    found = metrics.detection(gold, predicted, matching.greedy(name(predicted, "x"), name(gold, "y"), "work"), "work")
    return found.select("work", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "q36_bcubed",
    """WITH g AS (SELECT doc_id AS key, source AS g FROM documents WHERE doc_id % 11 <> 0), p AS (SELECT doc_id AS key, lang AS p FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT key, g, p FROM g FULL JOIN p USING (key)),
c AS (SELECT g, p, count(*) AS n FROM b WHERE g IS NOT NULL AND p IS NOT NULL GROUP BY ALL), ng AS (SELECT g, count(*) AS n_g FROM g GROUP BY ALL), np AS (SELECT p, count(*) AS n_p FROM p GROUP BY ALL), t AS (SELECT count(DISTINCT key) AS n FROM b),
s AS (SELECT sum(CAST(c.n AS DOUBLE) * c.n / n_p) / (SELECT n FROM t) AS pr, sum(CAST(c.n AS DOUBLE) * c.n / n_g) / (SELECT n FROM t) AS re FROM c JOIN ng USING (g) JOIN np USING (p))
SELECT round(pr, 9) AS precision, round(re, 9) AS recall, round(2 * pr * re / (pr + re), 9) AS f1 FROM s""",
)
def bcubed(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    side = lambda c, k: docs.where(F.col("doc_id") % k != 0).select(F.col("doc_id").alias("key"), F.col(c).alias("cluster"))
    found = metrics.bcubed(side("source", 11), side("lang", 7))
    return found.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "q37_silent_bad_merges",
    """WITH m AS (SELECT s_suppkey AS g, s_nationkey AS p FROM supplier), c AS (SELECT least(s_suppkey, s_suppkey + 25) AS x, greatest(s_suppkey, s_suppkey + 25) AS y FROM supplier), o AS (SELECT s_suppkey AS x, s_suppkey + 1 AS y FROM supplier)
SELECT a.g AS x, b.g AS y, a.p AS pred_id FROM m a JOIN m b ON a.p = b.p AND a.g < b.g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = a.g AND c.y = b.g) AND NOT EXISTS (SELECT 1 FROM o WHERE o.x = a.g AND o.y = b.g)""",
)
def silent_bad_merges(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    pairs = lambda k: s.select((F.col("s_suppkey") + k).alias("x"), F.col("s_suppkey").alias("y"))
    first = s.select(F.col("s_suppkey").alias("gold_id"), F.col("s_nationkey").alias("pred_id"))
    return metrics.silent_bad_merges(pairs(1), first, pairs(25)).select("x", "y", "pred_id")


_HALF_SQL = """WITH e AS (SELECT event_id, user_id % 40 AS a, 40 + event_id % 37 AS b, event_type AS rel_type, CASE WHEN event_id % 3 = 0 THEN 'extracted' ELSE 'inferred' END AS provenance FROM events),
d AS (SELECT a, b, event_id % 2 AS half, arg_min(rel_type, event_id) AS rel_type, arg_min(provenance, event_id) AS provenance FROM e WHERE event_id % 5 <> 0 GROUP BY ALL), g AS (SELECT * FROM d WHERE half = 0), p AS (SELECT * FROM d WHERE half = 1)"""


@query(
    "q38_relation_metrics",
    _HALF_SQL
    + """, gb AS (SELECT g.*, unnest([g.provenance, 'all']) AS bucket FROM g), pb AS (SELECT p.*, unnest([p.provenance, 'all']) AS bucket FROM p),
bg AS (SELECT gb.bucket, count(*) AS n_gold, count(p.rel_type) AS found, count(*) FILTER (WHERE p.rel_type = gb.rel_type) AS typed FROM gb LEFT JOIN pb p ON p.bucket = gb.bucket AND p.a = gb.a AND p.b = gb.b GROUP BY ALL),
bp AS (SELECT bucket, count(*) AS n_pred, count(g.rel_type) AS hits FROM pb LEFT JOIN g ON g.a = pb.a AND g.b = pb.b GROUP BY ALL),
s AS (SELECT bucket, CAST(hits AS DOUBLE) / n_pred AS pr, CAST(found AS DOUBLE) / n_gold AS re, CAST(typed AS DOUBLE) / found AS ty FROM bg JOIN bp USING (bucket))
SELECT bucket, round(pr, 9) AS precision, round(re, 9) AS recall, round(ty, 9) AS type_accuracy, round(2 * pr * re / (pr + re), 9) AS f1 FROM s""",
)
def relation_metrics(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("event_id % 5 <> 0")
    pairs = e.groupBy((F.col("user_id") % 40).alias("a"), (40 + F.col("event_id") % 37).alias("b"), (F.col("event_id") % 2).alias("half")).agg(F.min_by("event_type", "event_id").alias("rel_type"), F.min_by(F.when(F.col("event_id") % 3 == 0, "extracted").otherwise("inferred"), "event_id").alias("provenance"))
    found = metrics.relation_metrics(pairs.where("half = 0"), pairs.where("half = 1"))
    return found.select("bucket", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "type_accuracy", "f1")])


@query(
    "q39_attribute_metrics",
    f"""WITH {A.ATTRIBUTE_EVIDENCE}, {_SHEET}, x AS (SELECT * FROM sheet WHERE key IN ('eye_color', 'hair', 'height', 'scar', 'status')),
g AS (SELECT DISTINCT character_id, key, value_norm, attr_class FROM x WHERE manuscript_id IN ('m0', 'm1', 'm2')), p AS (SELECT DISTINCT character_id, key, value_norm, attr_class FROM x WHERE manuscript_id IN ('m3', 'm4')),
j AS (SELECT coalesce(g.attr_class, p.attr_class) AS attr_class, g.key IS NOT NULL AS ing, p.key IS NOT NULL AS inp FROM g FULL JOIN p ON g.character_id = p.character_id AND g.key = p.key AND g.value_norm = p.value_norm AND g.attr_class = p.attr_class),
b AS (SELECT unnest([attr_class, 'all']) AS bucket, ing, inp FROM j), s AS (SELECT bucket, count(*) FILTER (WHERE ing AND inp) AS tp, count(*) FILTER (WHERE ing) AS ng, count(*) FILTER (WHERE inp) AS np FROM b GROUP BY ALL),
r AS (SELECT bucket, CASE WHEN np > 0 THEN CAST(tp AS DOUBLE) / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN ng > 0 THEN CAST(tp AS DOUBLE) / ng WHEN np = 0 THEN 1.0 ELSE 0.0 END AS re FROM s)
SELECT bucket, round(CAST(pr AS DOUBLE), 9) AS precision, round(CAST(re AS DOUBLE), 9) AS recall, CASE WHEN pr + re = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(2 * pr * re / (pr + re) AS DOUBLE), 9) END AS f1 FROM r""",
)
def attribute_metrics(spark, sf_dir):
    sheet = _sheet(spark, sf_dir).where(F.col("key").isin(*GATE_KEYS)).withColumnRenamed("character_id", "character")
    found = metrics.attribute_metrics(sheet.where("manuscript_id in ('m0', 'm1', 'm2')"), sheet.where("manuscript_id in ('m3', 'm4')"))
    return found.select("bucket", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "q40_segmentation_accuracy",
    f"""WITH {A.BLOCKS}, d AS (SELECT mid, count(DISTINCT chapter_run) AS detected FROM ord GROUP BY ALL), e AS (SELECT mid, count(*) FILTER (WHERE kind = 'heading') AS expected FROM bl GROUP BY ALL)
SELECT mid AS manuscript_id, CASE WHEN expected = 0 THEN CASE WHEN coalesce(detected, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ELSE greatest(CAST(0 AS DOUBLE), 1 - CAST(abs(coalesce(detected, 0) - expected) AS DOUBLE) / expected) END AS accuracy FROM e LEFT JOIN d USING (mid)""",
)
def segmentation_accuracy(spark, sf_dir):
    rows = A.blocks(spark, sf_dir)
    found = segmentation.raw_scenes(rows).groupBy("manuscript_id").agg(F.count_distinct("chapter_run").alias("found"))
    expected = rows.groupBy("manuscript_id").agg(F.count_if(F.col("kind") == "heading").alias("expected"))
    both = expected.join(found, "manuscript_id", "left")
    return both.select("manuscript_id", ratios.accuracy(F.coalesce("found", F.lit(0)), F.col("expected")).alias("accuracy"))


@query(
    "q41_html_blocks",
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs') AS t FROM pages WHERE html IS NOT NULL),
o AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS part FROM (SELECT page_id, regexp_extract_all(t, '(?s)<(?:p|h1)>(?:[^<]|<(?:[^ph/]|/[^ph]|h[^1]|p[^>]|/p[^>]|/h[^1]))*') AS x FROM h)),
w AS (SELECT page_id, i, part[2:2] = 'h' AS heading, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(part, '^<(p|h1)>', ''), '<[^>]*>?'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ') AS raw FROM o),
u AS (SELECT page_id, i, heading, replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text FROM w WHERE raw <> '')
SELECT page_id AS id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, CASE WHEN heading THEN 'heading' WHEN regexp_full_match(text, '[*·~—#§•\-–_ \t]+') THEN 'separator' ELSE 'paragraph' END AS kind, text, CASE WHEN heading THEN CAST(1 AS INTEGER) END AS level FROM u""",
)
def html_blocks(spark, sf_dir):
    return markup.html_blocks(A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("html")))


@query(
    "q42_gate_verdict",
    """WITH s AS (SELECT quality, CAST(sum(toxic) AS DOUBLE) / count(*) AS t, CAST(count(*) FILTER (WHERE toxic = 0) AS DOUBLE) / count(*) AS c FROM labels GROUP BY quality)
SELECT quality, c >= 0.9 AND t < 0.1 AS characters, c >= 0.9 AS attributes FROM s""",
)
def gate_verdict(spark, sf_dir):
    scores = A.table(spark, sf_dir, "labels").groupBy("quality").agg((F.sum("toxic") / F.count("*")).alias("t"), (F.count_if(F.col("toxic") == 0) / F.count("*")).alias("c"))
    return scores.select("quality", (metrics.passes(detection_f1=F.col("c"), bcubed_f1=F.lit(None).cast("double")) & (F.col("t") < 0.1)).alias("characters"), metrics.passes(triple_f1=F.col("c")).alias("attributes"))
