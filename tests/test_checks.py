"""Rows that break their rules are set aside with reasons, gates fail inside the plan, counters come from the write."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext import schemas
from loomtext.operators import reads
from loomtext.plans import ingest, layers, model_path
from loomtext.schemas import EXTRACTION, SCENE
from tests.test_engine import Author
from tests.test_linking import SCENES, person, said


def test_bad_rows_go_to_the_quarantine(spark):
    good = ("m:c0:s0", "m:c0", "m", 0, 0, "One.", 4, 0, 4, "chapter_start", "One.")
    rows = [good, ("m:c0:s1", "m:c0", "m", 1, 1, "Two.", 5, 6, 2, "page_end", "Two."), ("m:c0:s2", "m:c0", "m", 2, None, "", 0, 9, 9, "separator", ""), ("m:c0:s3", "m:c0", "m", 3, 3, "x", 1, 11, 12, "separator", "x")]
    scenes = spark.createDataFrame([*rows, rows[3]], SCENE)
    other = spark.createDataFrame([(1,)], "anything int")
    out = schemas.accepted_and_quarantined({"scene": scenes, "not_known": other}, unique=True)
    assert [r.scene_id for r in out["scene"].collect()] == ["m:c0:s0"] and out["not_known"] is other
    bad = sorted((r.row_key, tuple(r.reasons), json.loads(r.row)["order_in_chapter"]) for r in out["quarantine"].where("table_name = 'scene'").collect())
    assert bad == [("m:c0:s1", ("char_count", "boundary_reason", "offsets"), 1), ("m:c0:s2", ("text", "order"), 2), ("m:c0:s3", ("repeated_key",), 3), ("m:c0:s3", ("repeated_key",), 3)]
    plain = schemas.accepted_and_quarantined({"scene": scenes})
    assert plain["scene"].count() == 3 and plain["quarantine"].count() == 2
    assert schemas.accepted_and_quarantined({"not_known": other}).keys() == {"not_known"}
    assert schemas.accepted_and_quarantined({"scene": scenes.where("false")})["quarantine"].count() == 0


def test_rules_name_columns_that_tables_have(spark, tmp_path):
    (tmp_path / "a.txt").write_text("CHAPTER I\n\nAna sings.\n\n***\n\nBen sleeps.")
    tables = ingest.ingest(spark, str(tmp_path / "*.txt"))
    assert tables["quarantine"].count() == 0 and tables["scene"].count() == 2
    works = [("m", "m:s0", 0, "Ana sings", json.dumps({"mentions": [said("Ana")], "new_characters": [person("Ana")], "present_entities": []}), True)]
    layer = layers.character_layer(spark.createDataFrame(works, SCENES).withColumn("response", F.from_json("response", EXTRACTION)))
    assert layer["quarantine"].count() == 0 and layer["mention_node"].count() == 1


@pytest.mark.parametrize("change", [{"mentions": [{**said("Ana"), "kind": "shout"}]}, {"mentions": [{**said("Ana"), "quote": None}]}, {"new_characters": [person("Ana", role="king")]}, {"new_characters": [{**person("Ana"), "entity_kind": "robot"}]}, {"mentions": None}, {"new_characters": [{**person("Ana"), "canonical_name": None}]}])
def test_a_response_outside_the_contract_is_a_miss(spark, change):
    right = {"mentions": [said("Ana")], "new_characters": [{**person("Ana"), "role": None, "entity_kind": None}], "present_entities": []}
    scene = spark.createDataFrame([("m", "s", 0, "Ana", "k1"), ("m", "s", 0, "Ana", "k2")], "manuscript_id string, scene_id string, order_narrative_global int, text string, cache_key string")
    stored = spark.createDataFrame([("k1", json.dumps(right)), ("k2", json.dumps(right | change))], "cache_key string, payload string")
    assert {r.cache_key: r.hit for r in layers.extractions(scene, stored).collect()} == {"k1": True, "k2": False}


def test_gates_fail_in_the_plan(spark):
    rows = spark.createDataFrame([("m", 1)], "manuscript_id string, n int")
    books = spark.createDataFrame([("m",), ("n",)], "manuscript_id string")
    runs = spark.createDataFrame([("m", "relations"), ("m", "characters")], "manuscript_id string, layer string")
    assert [tuple(r) for r in reads.gated(rows, books, runs, "m", "relations").collect()] == [("m", 1)]
    assert reads.gated(rows.where("false"), books, runs, "m", "relations").collect() == []  # ran and found nothing
    for ident, layer, told in (("x", "relations", "manuscript_not_found: x"), ("n", "relations", "not_extracted: n: relations"), ("m", "attributes", "not_extracted: m: attributes")):
        for given in (rows, rows.where("false")):
            plan = reads.gated(given, books, runs, ident, layer)  # no job yet
            with pytest.raises(Exception, match=told):
                plan.collect()


def test_counters_of_a_run_are_observed_on_its_write(spark, tmp_path):
    store = str(tmp_path / "store")
    scenes = spark.createDataFrame([("m", f"m:c0:s{i}", i, t, None) for i, t in enumerate(("Ana sings", "Ben sleeps", "broken scene", "Ana sings"))], "manuscript_id string, scene_id string, order_narrative_global int, text string, title string")
    keyed = layers.keyed(scenes, "m", "1", "1")
    first, again, jobs = {}, {}, spark.sparkContext.statusTracker()
    ask = lambda totals: model_path.completed(keyed, store, "extraction", EXTRACTION, layers.extraction_contract(), Author, F.array(F.lit("Known")), F.col("title"), totals=totals)
    ask(first)
    assert first == {"scenes": 4, "cache_hits": 0, "asked": 3, "answered": 2, "failed": 1}  # two scenes have one text
    ask(again)
    assert again == {"scenes": 4, "cache_hits": 3, "asked": 1, "answered": 0, "failed": 1}
    assert jobs.getActiveJobsIds() == [] and spark.sparkContext.getLocalProperty("spark.job.description") is None
