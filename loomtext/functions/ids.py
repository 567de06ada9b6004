"""Content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash16(prefix: Column | None, *parts: Column) -> Column:
    """The prefix and 16 hex digits of the SHA-256 of the parts, joined by two colons."""
    digest = F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16)
    return digest if prefix is None else F.concat(prefix, digest)


def _tagged(owner: Column, tag: str) -> Column:
    return F.concat(owner, F.lit(f":{tag}:"))


def character_id(manuscript: Column, folded_name: Column) -> Column:
    return hash16(_tagged(manuscript, "ch"), manuscript, folded_name)


def mention_id(scene: Column, surface: Column, start: Column) -> Column:
    return hash16(_tagged(scene, "mn"), scene, surface, start.cast("string"))


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def merge_candidate_id(a: Column, b: Column) -> Column:
    return hash16(F.lit("mc:"), *canonical_pair(a, b))


def relation_evidence_id(scene: Column, a: Column, b: Column) -> Column:
    return hash16(_tagged(scene, "re"), *canonical_pair(a, b))


def attribute_evidence_id(scene: Column, character: Column, key: Column) -> Column:
    return hash16(_tagged(scene, "ae"), character, key)


def attribute_id(character: Column, key: Column, value: Column) -> Column:
    return hash16(F.concat(character, F.lit(":attr:"), key, F.lit(":")), value)


def response_key(text: Column, prompt: str, model: str, schema: str, cast: Column | None = None) -> Column:
    """Key of a stored model response; relation and attribute responses depend on the scene's cast as well."""
    parts = [text] if cast is None else [text, F.array_join(F.array_sort(cast), ",")]
    return F.sha2(F.concat(*parts, F.lit(prompt), F.lit(model), F.lit(schema)), 256)
