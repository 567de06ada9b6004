"""Seeding of works from frozen responses: whole or not at all, and the same rows again."""

import json

import pytest

from loomtext.errors import NotMeasured
from loomtext.operators import evidence
from loomtext.plans import ingest, layers, seed
from loomtext.sources.staging import staged
from tests.test_linking import person, said

TEXTS = {"one.txt": "CHAPTER I\n\nAna met Ben.\n\n***\n\nBen left Ana.", "two.txt": "CHAPTER I\n\nOnly Cid."}


def test_works_are_seeded_from_frozen_responses(spark, tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / name).write_text(text)
    raw = ingest.ingest(spark, str(tmp_path / "*.txt"), str(tmp_path / "staging"))
    keys = {r.text: r.cache_key for r in layers.keyed(raw["scene"], "m", "1", "1").collect()}
    new = {"Ana met Ben.": ("Ana", "Ben"), "Ben left Ana.": (), "Only Cid.": ("Cid",)}
    m1 = {t: {"mentions": [said(n) for n in ("Ana", "Ben", "Cid") if n in t], "new_characters": [person(n) for n in new[t]], "present_entities": []} for t in keys}
    frozen = [(keys[t], json.dumps(r)) for t, r in m1.items()]
    table = lambda rows: spark.createDataFrame(rows, "cache_key string, payload string")
    works = {"one.txt": ("characters", "relations"), "two.txt": ("characters",)}
    with pytest.raises(NotMeasured, match="characters"):
        seed.seeded(spark, str(tmp_path), works, table(frozen[:1]), "m")
    with pytest.raises(NotMeasured, match="relations"):
        seed.seeded(spark, str(tmp_path), works, table(frozen), "m")
    scenes = staged(layers.extractions(layers.keyed(raw["scene"], "m", "1", "1"), table(frozen)), "looked")
    layer = {k: staged(v, k) for k, v in layers.character_layer(scenes, keep=staged).items()}
    ids = {r.canonical_name: r.character_id for r in layer["character"].collect()}
    casts = evidence.scene_casts(layer["appears_in"], layer["character"])
    e = {"character_a_id": ids["Ben"], "character_b_id": ids["Ana"], "rel_type": "romantic", "descriptor": "d", "provenance": "extracted", "confidence": 0.9, "quote": "q"}
    frozen += [(r.cache_key, json.dumps({"evidences": [e]})) for r in layers.keyed(raw["scene"], "m", "1", "1", casts, 2).collect()]
    found, tables = seed.seeded(spark, str(tmp_path), works, table(frozen), "m")
    assert set(found) == set(TEXTS) and {r.manuscript_id for r in tables["manuscript"].collect()} == set(found.values())
    assert {(r.canonical_name, r.mention_count) for r in tables["character"].collect()} == {("Ana", 2), ("Ben", 2), ("Cid", 1)}
    assert [(r.manuscript_id, r.evidence_count) for r in tables["relates_to"].collect()] == [(found["one.txt"], 2)]
    assert tables["attribute"].count() == 0
