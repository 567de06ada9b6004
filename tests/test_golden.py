"""Ids, scenes and response keys that stored responses depend on, of three short works."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.functions import ids, names
from loomtext.operators import reads
from loomtext.plans import ingest, layers

#: What other stores hold of these works.
MANUSCRIPTS = {
    "attributes": "8e132b22e0f341a2bdf9fcf53668097010a63c884c3472ead53b677233c07c64",
    "relations": "c423f56d2cb1c9a507aa577fdf7e5ea0328280fd24899d3a99749469a7b8de40",
    "three-chapters": "6641bb47f853f69a44f769bdfcfa8cf32cce7477ccce5ded65be8a85906deeb4",
}
SCENES = {
    "attributes": "c0/s0:chapter_start@0, c1/s0:chapter_start@308",
    "relations": "c0/s0:chapter_start@0, c0/s1:separator@181, c1/s0:chapter_start@318, c1/s1:separator@480",
    "three-chapters": "c0/s0:chapter_start@0, c1/s0:chapter_start@149, c2/s0:chapter_start@355, c2/s1:separator@459, c2/s2:separator@577, c3/s0:chapter_start@685",
}
PEOPLE = {
    "attributes": {"Ana": "4b8a6227898688e0", "Beatriz": "8cddc0f5cef4674a", "Daniel": "826e313290ab6cec"},
    "relations": {"Ana": "629dcf3a8a79d049", "Beatriz": "0745e88932493892", "Carlos": "f3692b96a6ff1f62", "Daniel": "406fdddc50ae6594"},
}
CASTS = {"attributes": [("Ana", "Beatriz"), ("Ana", "Beatriz", "Daniel")], "relations": [("Ana", "Beatriz"), ("Ana", "Carlos"), ("Carlos", "Daniel"), ("Beatriz", "Daniel")]}
CAST_KEYS = {
    "attributes": {"44f7a45e74e87e1b7115a5ff2f1531686a35377965cc62c376cfe8808c78afd0", "690c9f0798da20365be79f849229c22b803e2c2a64fc704557b455da1896043c"},
    "relations": {
        "320579cd3eea3da5147cb7a4515a2d05405dfc0e52bdda62ebed7973dcd26f24", "43b5dc66aeb86787ad91dba00c0ffa3263bde7575ce9b88e025f974e2fc36445",
        "8e59b2151afb2849ce2ff54727c78d1241ff640c829a61a7edf83fa111e838ba", "9bf80fd91548c0c5703612aa2528e765b35ebe508c67442bd79b8ef36a5e90fa",
    },
}
MODEL = "openai/kimi-k2.5"


@pytest.fixture(scope="module")
def works(spark, tmp_path_factory):
    staging = tmp_path_factory.mktemp("staging")
    tables = ingest.ingest(spark, str(Path(__file__).parent / "fixtures" / "*.txt"), str(staging))
    named = {r.manuscript_id: Path(r.source_id).stem for r in tables["manuscript"].select("manuscript_id", "source_id").collect()}
    return tables, named


def test_manuscripts_and_scenes(works):
    tables, named = works
    assert {name: ident for ident, name in named.items()} == MANUSCRIPTS
    scenes = tables["scene"].join(reads.scene_coordinates(tables["scene"]), "scene_id").orderBy("order_narrative_global").collect()
    said = {name: ", ".join(f"{r.coordinate}:{r.boundary_reason}@{r.start_offset}" for r in scenes if named[r.manuscript_id] == name) for name in SCENES}
    assert said == SCENES


def test_people_and_keys_of_responses(spark, works):
    tables, named = works
    for name, people in PEOPLE.items():
        ident = MANUSCRIPTS[name]
        frame = spark.createDataFrame([(n,) for n in people], "name string").select("name", ids.character_id(F.lit(ident), names.fold(F.col("name"))).alias("id"))
        known = {r.name: r.id for r in frame.collect()}
        assert known == {n: f"{ident}:ch:{suffix}" for n, suffix in people.items()}
        scenes = tables["scene"].where(F.col("manuscript_id") == ident)
        rows = [(r.scene_id, [(n, known[n]) for n in CASTS[name][r.order_narrative_global]]) for r in scenes.select("scene_id", "order_narrative_global").collect()]
        casts = spark.createDataFrame(rows, "scene_id string, cast array<struct<canonical_name:string,character_id:string>>")
        assert {r.cache_key for r in layers.keyed(scenes, MODEL, "1", "1", casts, 1).collect()} == CAST_KEYS[name]
