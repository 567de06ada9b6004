"""Streams leave what one batch over everything leaves: whatever the order of arrival, after a restart, and when a batch is run twice."""

import json
import random

from pyspark.sql import functions as F

from loomtext.operators import resolution
from loomtext.plans import layers
from loomtext.schemas import RELATIONS
from loomtext.sources import responses
from loomtext.streaming import evidence, registry


def rows_of(frame, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))


def test_registry_grows_like_the_fold_over_all(spark, tmp_path):
    rng = random.Random(51)
    names = ["Ana", "Mr. Vale", "Mrs. Vale", "Vale", "Dr. Vale", "Ben", "Mr. Ben", "Benedict", "Dora Vale", "the crowd"]
    every = [(f"m{m}", s, p, rng.choice(names), rng.sample([*names, "she"], rng.randint(0, 2)), "minor", "person") for m in range(5) for s in range(6) for p in range(rng.randint(1, 2))]
    candidates = spark.createDataFrame(every, resolution.CANDIDATE)
    judged = spark.createDataFrame([(f"m{m}", a, b, True, c, "why") for m in range(5) for a, b, c in (("Ben", "Benedict", 0.95), ("Vale", "Dora Vale", 0.6))], "manuscript_id string, name_a string, name_b string, same_entity boolean, confidence double, rationale string")
    decided = spark.createDataFrame([("m1", "Benedict", "Ben", "rejected"), ("m2", "Dora Vale", "Mr. Vale", "accepted")], "manuscript_id string, name_a string, name_b string, status string")
    columns = [x.split()[0] for x in f"{resolution.RESOLVED}, linked_name x, known_aliases x".split(", ")]
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    ready = registry.prepared(candidates, decided, judged).cache()
    # first scenes in order, then some in order and some late, each part after a restart from the checkpoint
    for part in ("scene_order in (0, 1)", "scene_order = 2 or manuscript_id in ('m0', 'm1') and scene_order = 4", "scene_order in (3, 5) or manuscript_id not in ('m0', 'm1') and scene_order = 4"):
        ready.where(part).repartition(3).write.mode("append").parquet(source)
        registry.resolve_stream(spark, source, target, log).awaitTermination()
    got, want = registry.resolved_so_far(spark, target), resolution.resolved(candidates, decided, judged)
    assert rows_of(got, columns) == rows_of(want, columns) and got.count() == len(every)
    generations = dict(map(tuple, spark.read.parquet(target).groupBy("manuscript_id").agg(F.max("generation")).collect()))
    assert {generations["m0"], generations["m1"]} == {1} and {generations[f"m{i}"] for i in (2, 3, 4)} == {0}


def scene(m, i):
    return (m, f"{m}:s{i}", i, ["a", "b", "c"], f"key-{m}-{i}")


def answer(*evidences):
    return json.dumps({"evidences": [{"character_a_id": a, "character_b_id": b, "rel_type": r, "descriptor": "d", "provenance": "extracted", "confidence": c, "quote": "q"} for a, b, r, c in evidences]})


def test_scenes_as_they_come(spark, tmp_path):
    rng = random.Random(52)
    scenes = [scene(m, i) for m in "xyz" for i in range(5)]
    said = {s[4]: answer(*[(*rng.sample("abc", 2), rng.choice(["family", "social"]), rng.choice([0.3, 0.6, 0.9])) for _ in range(2)]) for s in scenes}
    store, source, target, log = (str(tmp_path / x) for x in ("store", "in", "out", "log"))

    def answered(keys, payloads):
        rows = spark.createDataFrame([("relations", k, payloads[k]) for k in keys], "layer string, cache_key string, payload string").withColumn("answered_at", F.current_timestamp())
        responses.save(rows.withColumn("error", F.lit(None).cast("string")), store)

    keyed = lambda rows: spark.createDataFrame(rows, evidence.KEYED)
    rng.shuffle(scenes)
    for part in (scenes[:6], scenes[6:]):
        answered([s[4] for s in part], said)  # the second part is answered after the stream has begun
        keyed(part).coalesce(1).write.mode("append").json(source)
        evidence.evidence_stream(spark, source, store, target, log).awaitTermination()
    batch = layers.relation_tables(responses.looked_up(keyed(scenes), responses.saved(spark, store, "relations"), RELATIONS, layers.relation_contract()))
    names = ["manuscript_id", "character_a_id", "character_b_id", "rel_type", "confidence", "evidence_count", "first_evidence_id"]
    assert rows_of(evidence.relations(spark, target), names) == rows_of(batch["relates_to"], names)
    before = {t: rows_of(spark.read.parquet(f"{target}/{t}"), ["manuscript_id", "character_a_id", "confidence"]) for t in ("relation_evidence", "relates_to")}
    evidence.take(keyed(scenes[6:]), store, target)
    assert before == {t: rows_of(spark.read.parquet(f"{target}/{t}"), ["manuscript_id", "character_a_id", "confidence"]) for t in before}


def test_relations_that_are_gone_leave_and_others_stay(spark, tmp_path):
    store, target = str(tmp_path / "store"), str(tmp_path / "out")
    keyed = spark.createDataFrame([scene("x", 0), scene("y", 0)], evidence.KEYED)

    def answered(key, payload):
        responses.save(spark.createDataFrame([("relations", key, payload, None)], "layer string, cache_key string, payload string, error string").withColumn("answered_at", F.current_timestamp()), store)

    answered("key-x-0", answer(("a", "b", "family", 0.9)))
    answered("key-y-0", answer(("b", "c", "social", 0.9)))
    evidence.take(keyed, store, target)
    assert {r.manuscript_id for r in evidence.relations(spark, target).collect()} == {"x", "y"}
    answered("key-x-0", answer(("b", "a", "family", 0.2)))
    evidence.take(keyed.where("manuscript_id = 'x'"), store, target)
    assert [(r.manuscript_id, r.rel_type) for r in evidence.relations(spark, target).collect()] == [("y", "social")]
    assert evidence.relations(spark, str(tmp_path / "none")).count() == 0
