"""Table schemas, closed vocabularies and the checks that rows must pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Closed vocabularies of the data model.
SOURCE_FORMATS = ("epub", "txt", "docx")
CHAPTER_KINDS = ("chapter", "prologue", "epilogue", "interlude", "other")
BOUNDARY_REASONS = ("chapter_start", "separator")
NON_NARRATIVE_KINDS = ("license", "toc", "cover", "frontmatter", "backmatter", "other")
BLOCK_KINDS = ("heading", "paragraph", "separator")
MENTION_KINDS = ("name", "alias", "title", "description", "pronoun_resolved")
CHARACTER_ROLES = ("protagonist", "antagonist", "secondary", "minor", "unknown")
ENTITY_KINDS = ("person", "animal")
REL_TYPES = ("family", "romantic", "friendship", "antagonism", "professional", "social", "other")
PROVENANCES = ("extracted", "inferred")
ATTRIBUTE_KEYS = ("eye_color", "hair", "height", "scar", "age", "gender", "status")
GATE_KEYS = ("eye_color", "hair", "height", "scar", "status")

BLOCK = "manuscript_id string, pos long, kind string, text string, level int, style string, source_role string"
SCENE = "scene_id string, chapter_id string, manuscript_id string, order_in_chapter int, order_narrative_global int, text string, char_count int, start_offset long, end_offset long, boundary_reason string, snippet string"
CHAPTER = "chapter_id string, manuscript_id string, order_narrative int, title string, kind string, word_count long, start_offset long, end_offset long"
CHARACTER = "character_id string, manuscript_id string, canonical_name string, aliases array<string>, role string, is_mentioned_only boolean, first_scene_id string, appearance_count long, mention_count long, entity_kind string"

EXTRACTION = (
    "mentions array<struct<surface:string,kind:string,links_to:string,quote:string>>, "
    "new_characters array<struct<canonical_name:string,aliases:array<string>,role:string,entity_kind:string,is_present_in_scene:boolean>>, "
    "present_entities array<string>, notes string"
)
RELATIONS = "evidences array<struct<character_a_id:string,character_b_id:string,rel_type:string,descriptor:string,role_a:string,role_b:string,provenance:string,confidence:double,quote:string>>, notes string"
ATTRIBUTES = "evidences array<struct<character_id:string,key:string,value_norm:string,value_quote:string,confidence:double>>, notes string"
JUDGEMENT = "same_entity boolean, confidence double, rationale string"

MENTION = "mention_id string, manuscript_id string, scene_id string, surface string, kind string, start_offset int, end_offset int, quote string"
HAS_MENTION = "manuscript_id string, character_id string, mention_id string"
RELATION_EVIDENCE = "evidence_id string, manuscript_id string, scene_id string, narrative_order int, character_a_id string, character_b_id string, rel_type string, descriptor string, role_a string, role_b string, provenance string, confidence double, quote string"
ATTRIBUTE_EVIDENCE = "evidence_id string, manuscript_id string, scene_id string, narrative_order int, character_id string, key string, value_norm string, value_quote string, confidence double"
#: Tables of the catalog: schema, the column that owns a row, and the key.
TABLES: dict[str, tuple[str, str, list[str]]] = {
    "chapter": (CHAPTER, "manuscript_id", ["chapter_id"]),
    "scene": (SCENE, "manuscript_id", ["scene_id"]),
    "character": (CHARACTER, "manuscript_id", ["character_id"]),
    "mention_node": (MENTION, "manuscript_id", ["mention_id"]),
    "has_mention": (HAS_MENTION, "manuscript_id", ["mention_id", "character_id"]),
    "relation_evidence": (RELATION_EVIDENCE, "manuscript_id", ["evidence_id"]),
    "attribute_evidence": (ATTRIBUTE_EVIDENCE, "manuscript_id", ["evidence_id"]),
}


def valid_relation(e: Column) -> Column:
    """A relation evidence that keeps the contract: closed values, confidence in [0, 1], two different characters."""
    return (
        e["rel_type"].isin(*REL_TYPES)
        & e["provenance"].isin(*PROVENANCES)
        & e["confidence"].between(0.0, 1.0)
        & (e["character_a_id"] != e["character_b_id"])
        & e["descriptor"].isNotNull()
        & e["quote"].isNotNull()
    )


def valid_attribute(e: Column) -> Column:
    return e["key"].isin(*ATTRIBUTE_KEYS) & e["confidence"].between(0.0, 1.0) & (F.trim(e["value_norm"]) != "")


def key_class(key: str | Column) -> Column:
    return F.when((F.col(key) if isinstance(key, str) else key) == "status", "stateful").otherwise("static")


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


_OFFSETS = "start_offset >= 0 and end_offset >= start_offset"
#: For each table its key, and what must hold of a row, by name.
RULES: dict[str, tuple[list[str], dict[str, str]]] = {
    "chapter": (["chapter_id"], {"kind": _one_of("kind", CHAPTER_KINDS), "order": "order_narrative >= 0", "word_count": "word_count >= 0", "offsets": _OFFSETS}),
    "scene": (["scene_id"], {"text": "text <> ''", "char_count": "char_count = length(text)", "boundary_reason": _one_of("boundary_reason", BOUNDARY_REASONS), "order": "order_in_chapter >= 0 and order_narrative_global >= 0", "offsets": _OFFSETS}),
    "non_narrative_block": (["block_id"], {"kind": _one_of("kind", NON_NARRATIVE_KINDS), "text": "text is not null"}),
    "character": (["character_id"], {"name": "canonical_name <> ''", "role": _one_of("role", CHARACTER_ROLES), "entity_kind": _one_of("entity_kind", ENTITY_KINDS)}),
    "mention_node": (["mention_id"], {"kind": _one_of("kind", MENTION_KINDS), "surface": "surface <> ''", "offsets": _OFFSETS}),
    "merge_candidate": (["candidate_id"], {"pair": "character_a_id <> character_b_id", "confidence": "confidence between 0 and 1"}),
    "relation_evidence": (["evidence_id"], {"rel_type": _one_of("rel_type", REL_TYPES), "provenance": _one_of("provenance", PROVENANCES), "confidence": "confidence between 0 and 1", "pair": "character_a_id < character_b_id"}),
    "attribute_evidence": (["evidence_id"], {"key": _one_of("key", ATTRIBUTE_KEYS), "value": "value_norm <> ''", "confidence": "confidence between 0 and 1"}),
}


def with_reasons(rows: DataFrame, rules: dict[str, str], key: list[str] | None = None) -> DataFrame:
    """Adds reasons, the names of the rules that a row breaks (a rule that is null is broken), and repeated_key of those
    whose key stands more than once, where a key is given. One pass; the key needs its rows together."""
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    if key:
        broken.append(F.when(F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1, F.lit("repeated_key")))
    return rows.withColumn("reasons", F.array_compact(F.array(*broken)))


def accepted_and_quarantined(tables: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows, unique: bool = False) -> dict[str, DataFrame]:
    """The tables with the rows that keep their rules, and quarantine: (table_name, row_key, reasons, row as JSON) of the others.

    keep writes the checked rows, so that they are made once for both. unique also checks keys, for tables of other hands.
    """
    out, bad = dict(tables), None
    for name in tables.keys() & RULES.keys():
        key, rules = RULES[name]
        told = keep(with_reasons(tables[name], rules, key if unique else None), f"checked_{name}")
        out[name] = told.where(F.size("reasons") == 0).drop("reasons")
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in tables[name].columns]))
        some = told.where(F.size("reasons") > 0).select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("row_key"), "reasons", row.alias("row"))
        bad = some if bad is None else bad.unionByName(some)
    return out if bad is None else out | {"quarantine": bad}
