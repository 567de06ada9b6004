"""Gold against predicted layers, end to end on a small work."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.errors import InconsistentGold, NotMeasured
from loomtext.operators import metrics
from loomtext.plans import evaluation as E
from loomtext.plans import wipe
from loomtext.sources import gold as G


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("gold")
    people = [{"gold_id": f"g{i}", "canonical_name": n, "aliases": a, "mentions": [{"scene": "c0/s0", "surface": n}]} for i, (n, a) in enumerate([("Élodie", ["Elo"]), ("Marc", []), ("Nadia", [])])]
    (d / "c.json").write_text(json.dumps({"work": "w", "characters": people}, indent=1))
    (d / "r.json").write_text(json.dumps({"work": "w", "relations": [{"a": "g0", "b": "g1", "rel_type": "family", "provenance": "extracted"}, {"a": "g0", "b": "g2", "rel_type": "social", "provenance": "inferred"}]}))
    (d / "a.json").write_text(json.dumps({"work": "w", "attributes": [{"character": "g0", "key": "hair", "value_norm": "red", "class": "static"}, {"character": "g0", "key": "age", "value_norm": "9", "class": "static"}]}))
    read = lambda name, schema, field: G.gold(spark, f"{d}/{name}.json", schema, field)
    gold = read("c", G.CHARACTERS, "characters")
    found = spark.createDataFrame([("w", "p1", "elodie", [], "person"), ("w", "p2", "Marc", ["Elo"], None), ("w", "p3", "Rex", [], "animal")], "manuscript_id string, character_id string, canonical_name string, aliases array<string>, entity_kind string")
    return gold, E.people(found), read("r", G.RELATIONS, "relations"), read("a", G.ATTRIBUTES, "attributes")


def test_scores(spark, work):
    gold, predicted, relations, attributes = work
    entities = gold.select("work", F.col("gold_id").alias("ident"), F.struct("pos").alias("order"), "canonical_name", "aliases")
    score = E.detection(entities, predicted).first()
    # Greedy, not a maximum matching: Marc comes first and takes Élodie by the alias they share.
    assert (score.precision, round(score.recall, 4)) == (0.5, 0.3333)
    aligned = E.alignment(entities, predicted)
    assert [(r.gold, r.pred) for r in aligned.collect()] == [("g0", "p2")]
    pairs = spark.createDataFrame([("p1", "p2", "family", "extracted")], "character_a_id string, character_b_id string, rel_type string, provenance string")
    exact = spark.createDataFrame([("w", "g0", "p1"), ("w", "g1", "p2")], "work string, gold string, pred string")
    by = {r.bucket: r for r in E.relations(relations, pairs, exact).collect()}
    assert (by["extracted"].f1, by["extracted"].type_accuracy) == (1.0, 1.0) and by["inferred"].recall == 0.0 and by["all"].recall == 0.5
    sheet = spark.createDataFrame([("p1", "hair", "red", "static")], "character_id string, key string, value_norm string, attr_class string")
    assert {r.bucket: r.f1 for r in E.attributes(attributes, sheet, exact).collect()} == {"static": 1.0, "all": 1.0}
    assert {r.bucket: round(r.f1, 4) for r in E.attributes(attributes, sheet, exact, gate_only=False).collect()} == {"static": 0.6667, "all": 0.6667}
    scenes = spark.createDataFrame([("s0", 0, 0)], "scene_id string, order_narrative int, order_in_chapter int")
    mentions = spark.createDataFrame([("s0", " Marc ", "name", "p2"), ("s0", "he", "pronoun_resolved", "p2"), ("zz", "x", "name", "p1")], "scene_id string, surface string, kind string, character_id string")
    assert [tuple(r) for r in E.mention_clusters(mentions, scenes).collect()] == [("c0/s0::marc", "p2")]
    assert E.gold_clusters(gold).count() == 3


def test_results_are_kept_and_nothing_is_not_zero(spark, work, tmp_path):
    for day, f1 in (("20260101", 0.5), ("20260102", 0.7)):
        G.save_result(spark, str(tmp_path), "characters", "a/b.txt", day, "abc", {"f1": f1})
    assert G.last_result(spark, str(tmp_path), "characters", "a/b.txt") == {"f1": 0.7} and G.last_result(spark, str(tmp_path), "characters", "other") is None
    with pytest.raises(NotMeasured):
        G.measured(work[0].where("false"), "characters")


def test_greedy_order_is_that_of_the_lists(spark):
    """Twelve entities and more: places count as numbers, names as names, and each side takes the first that is free."""
    gold = [(f"g{i}", i, f"Name{i}", ["Shared"] if i in (2, 10, 11) else []) for i in range(13)]
    predicted = [(f"p{i}", n, [x]) for i, (n, x) in enumerate([("Ann Lee", "Shared"), ("Ann", "Shared"), ("Zoe", "Name12"), ("Bob", "Name3")])]
    g = spark.createDataFrame(gold, "ident string, pos int, canonical_name string, aliases array<string>").select(F.lit("w").alias("work"), "ident", F.struct("pos").alias("order"), "canonical_name", "aliases")
    p = E.people(spark.createDataFrame([("w", i, n, a, "person") for i, n, a in predicted], "manuscript_id string, character_id string, canonical_name string, aliases array<string>, entity_kind string"))

    def greedy(first, second):
        taken, out = set(), set()
        for i, names in first:
            hit = next((j for j, others in second if j not in taken and names & others), None)
            if hit:
                taken.add(hit)
                out.add((i, hit))
        return out

    golds = [(i, {n.lower(), *(a.lower() for a in al)}) for i, _, n, al in gold]
    preds = [(i, {n.lower(), *(a.lower() for a in al)}) for i, n, al in sorted(predicted, key=lambda x: (x[1], x[0]))]
    assert {(r.gold, r.pred) for r in E.alignment(g, p).collect()} == greedy(golds, preds) == {("g2", "p1"), ("g3", "p3"), ("g10", "p0"), ("g12", "p2")}
    assert {(r["first"], r["second"]) for r in E.matched(p, g).collect()} == greedy(preds, golds)


def test_relation_buckets(spark):
    """A prediction of another bucket is precise, but finds nothing in the gold pair's own bucket."""
    schema = "a string, b string, rel_type string, provenance string"
    rows = lambda *x: spark.createDataFrame(x, schema)
    by = {r.bucket: r for r in metrics.relation_metrics(rows(("x", "y", "family", "extracted")), rows(("x", "y", "family", "inferred"))).collect()}
    assert (by["extracted"].precision, by["extracted"].recall, by["extracted"].type_accuracy) == (0.0, 0.0, None)
    assert (by["inferred"].precision, by["inferred"].recall, by["inferred"].type_accuracy) == (1.0, 0.0, None)
    assert (by["all"].precision, by["all"].recall, by["all"].type_accuracy) == (1.0, 1.0, 1.0)
    nothing = spark.createDataFrame([], schema)
    assert {(r.bucket, r.precision, r.recall, r.f1, r.type_accuracy) for r in metrics.relation_metrics(nothing, nothing).collect()} == {(b, 1.0, 1.0, 1.0, None) for b in ("extracted", "inferred", "all")}


def test_gold_without_mentions_is_no_score_and_half_annotated_is_an_error(spark):
    schema = "work string, gold_id string, mentions array<struct<scene:string,surface:string>>"
    rows = lambda *x: spark.createDataFrame(x, schema)
    mentions = spark.createDataFrame([("s0", "Ana", "name", "p1")], "scene_id string, surface string, kind string, character_id string")
    scenes = spark.createDataFrame([("s0", 0, 0)], "scene_id string, order_narrative int, order_in_chapter int")
    assert E.resolution_scores(rows(("w", "a", None), ("w", "b", None)), mentions, scenes) is None
    with pytest.raises(InconsistentGold, match="b"):
        E.resolution_scores(rows(("w", "a", [("c0/s0", "Ana")]), ("w", "b", None)), mentions, scenes)
    assert E.resolution_scores(rows(("w", "a", [("c0/s0", "ANA ")]), ("w", "b", [])), mentions, scenes).first().f1 == 1.0
    with pytest.raises(NotMeasured, match="coordinates"):
        E.resolution_scores(rows(("w", "a", None)), mentions, scenes.where("false"))
    assert E.skipped_or_failed("no graph", None) == E.skipped_or_failed("no graph", "true") == "no graph"
    with pytest.raises(NotMeasured):
        E.skipped_or_failed("no graph", "1")


def test_wipes(spark):
    tables = {n: spark.createDataFrame([("m", f"{n}1"), ("o", f"{n}2")], "manuscript_id string, character_id string") for n in ("character", "mention", "merge_candidate", "scene")}
    tables["appears_in"] = spark.createDataFrame([("character1", "s"), ("character2", "t")], "character_id string, scene_id string")
    assert {(r.table_name, r.rows) for r in wipe.preview(tables, "m").collect()} == {("character", 1), ("mention", 1), ("merge_candidate", 1)}
    left = wipe.wiped(tables, "m")
    assert {n: d.count() for n, d in left.items()} == {"character": 1, "mention": 1, "merge_candidate": 1, "scene": 2, "appears_in": 1}
    ids = lambda **how: sorted(r.character_id for r in wipe.wiped_ids(tables["character"], "character_id", **how).collect())
    assert ids() == ids(ids=[]) == ids(prefix="") == ["character1", "character2"] and ids(ids=["character1"]) == ["character2"] and ids(prefix="char") == []
