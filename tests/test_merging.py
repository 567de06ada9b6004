"""Merges that chain, mentions of several characters, and stored layers that a second run meets."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import components, upsert
from loomtext.plans import graph, layers
from loomtext.sources.staging import staged
from tests.test_linking import looked_up, person, said


def plain_targets(merges):
    """Where ids end up, by walking over links in both directions."""
    near, gone = {}, {a for a, b in merges if a != b}
    for a, b in merges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, done = {}, set()
    for start in near:
        if start in done:
            continue
        group, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        done |= group
        root = min(group - gone or group)
        out |= {x: root for x in group if x != root}
    return out


def targets(spark, merges, **how):
    return dict(map(tuple, components.final_targets(spark.createDataFrame(merges, "from_id string, to_id string"), **how).collect()))


@pytest.mark.parametrize("small", [0, components.SMALL])
def test_chains_end_at_their_end(spark, small):
    chain, hub = [(f"n{i + 1:03}", f"n{i:03}") for i in range(40)], [(f"h{i}", "hub") for i in range(200)] + [("hub", "end")]
    cases = [("b", "a"), ("c", "b"), ("d", "c"), ("k", "l"), ("l", "m"), ("x", "y"), ("y", "x"), ("p", "r"), ("p", "q"), ("s", "s"), ("t", "s"), ("t", "s"), ("w", "w")]
    got = targets(spark, [*cases, *chain, *hub], small=small)
    assert {got.pop(a) for a, _ in chain} == {"n000"} and {got.pop(a) for a, _ in hub} == {"end"}
    assert got == {"b": "a", "c": "a", "d": "a", "k": "m", "l": "m", "y": "x", "p": "q", "r": "q", "t": "s"}  # the end of a chain need not be the least


def test_random_merges_and_none(spark):
    rng = random.Random(21)
    merges = [(f"{book}{rng.randint(0, 50):02}", f"{book}{rng.randint(0, 50):02}") for book, links in (("a", 30), ("b", 45), ("c", 80)) for _ in range(links)]
    assert targets(spark, merges, small=0) == targets(spark, merges) == plain_targets(merges)
    assert targets(spark, []) == {}


def test_components_have_the_least_label(spark):
    links = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 7: 7}


def test_accepted_chains_move_what_hangs_on_them(spark):
    people = spark.createDataFrame([(x, x.upper(), [x * 2]) for x in "abcd"] + [("e", "E", None)], "character_id string, canonical_name string, aliases array<string>")
    edges = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 1), ("e", 1)], "character_id string, mention_id int")
    seen = spark.createDataFrame([("a", 1, "mentioned", 1), ("b", 1, "present", 2), ("c", 1, "present", 3), ("d", 2, "present", 4)], "character_id string, scene_id int, kind string, mention_count long")
    merges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "from_id string, to_id string")
    left, moved, appeared = upsert.accepted(people, edges, seen, merges)
    rows = {r.character_id: r for r in left.collect()}
    assert set(rows) == {"a", "e"} and rows["a"].aliases == ["B", "C", "D", "aa", "bb", "cc", "dd"] and rows["a"].merged_from == ["b", "c", "d"] and rows["e"].aliases is None
    assert sorted(map(tuple, moved.collect())) == [("a", 1), ("a", 2), ("e", 1)]
    assert sorted(map(tuple, appeared.select("character_id", "scene_id", "kind", "mention_count").collect())) == [("a", 1, "mentioned", 6), ("a", 2, "present", 4)]


def rows_of(tables, *names):
    return {n: sorted(map(repr, (tuple(r[c] for c in sorted(tables[n].columns)) for r in tables[n].collect()))) for n in names}


def kept(tables):
    return {k: staged(v, k) for k, v in tables.items()}


STORED = ("character", "mention_node", "has_mention", "appears_in", "merge_candidate")


def test_a_layer_that_runs_again_stays_and_one_of_new_scenes_adds(spark):
    works = {"m": [("Ana met Ben. The Captain.", {"mentions": [said("Ana"), said("Captain", "Ana"), said("Captain", "Ben")], "new_characters": [person("Ana"), person("Ben", present=False)], "present_entities": []}), ("Ben.", {"mentions": [said("Ben")], "new_characters": [person("Ben", ["Benno"], role="minor")], "present_entities": ["Ben"]})]}
    layer = kept(layers.character_layer(looked_up(spark, works), keep=staged))
    assert rows_of(graph.merged_characters(layer, layer), *STORED) == rows_of(layer, *STORED)
    before = kept(layers.character_layer(looked_up(spark, {"m": works["m"][:1]}), keep=staged))
    assert {r.canonical_name: (r.role, r.mention_count, r.is_mentioned_only) for r in before["character"].collect()} == {"Ana": ("unknown", 2, False), "Ben": ("unknown", 1, True)}
    after = kept(graph.merged_characters(before, layer))
    assert rows_of(after, *STORED) == rows_of(layer, *STORED)
    assert {r.canonical_name: (r.role, r.mention_count, r.is_mentioned_only) for r in after["character"].collect()} == {"Ana": ("unknown", 2, False), "Ben": ("minor", 2, False)}
    # a decision that was made stays when the candidate comes again, and moves edges of shared mentions into one
    a, b = (next(r.character_id for r in layer["character"].collect() if r.canonical_name == n) for n in ("Ana", "Ben"))
    candidate = layer["merge_candidate"].schema
    row = lambda status: spark.createDataFrame([("mc", "m", a, b, "Ana", "Ben", 0.6, "why", status, None)], candidate)
    again = kept(graph.merged_characters(layer | {"merge_candidate": row("accepted")}, layer | {"merge_candidate": row("pending")}))
    assert [r.status for r in again["merge_candidate"].collect()] == ["accepted"]
    one = kept(graph.accepted_merges(again))
    assert [(r.canonical_name, r.mention_count, r.appearance_count) for r in one["character"].collect()] == [("Ana", 3, 2)]
    assert one["has_mention"].count() == 3 and one["mention_node"].count() == 3


def test_relations_of_touched_manuscripts_are_made_again(spark):
    kind = "manuscript_id string, scene_id string, character_a_id string, character_b_id string, evidence_id string, narrative_order long, rel_type string, provenance string, confidence double, descriptor string, role_a string, role_b string"
    e = lambda m, i, rel, c: (m, f"s{i}", "a", "b", f"{m}{i}", i, rel, "extracted", c, "d", None, None)
    from loomtext.operators import evidence

    old_rows = spark.createDataFrame([e("m", 1, "family", 0.9), e("m", 2, "social", 0.9), e("n", 1, "social", 0.9)], kind)
    old = {"relation_evidence": old_rows, "relates_to": evidence.relation_map(old_rows).withColumn("rel_type", F.concat("rel_type", F.lit(" as stored")))}
    new = spark.createDataFrame([e("m", 1, "social", 0.8), e("m", 3, "social", 0.2)], kind)
    once = graph.merged_relations(old, new, new)
    assert {(r.manuscript_id, r.rel_type, r.evidence_count) for r in once["relates_to"].collect()} == {("m", "social", 3), ("n", "social as stored", 1)}
    twice = graph.merged_relations(once, new, new)
    assert rows_of(once, "relation_evidence", "relates_to") == rows_of(twice, "relation_evidence", "relates_to")


def test_links_do_not_pass_through_the_driver(spark):
    """Staged links are small as files and large as rows, so a join by itself would broadcast them."""
    merges = spark.range(1, 4000).where("id % 5 <> 0").selectExpr("id AS from_id", "id - 1 AS to_id")
    people = spark.range(4000).selectExpr("id AS character_id", "'d' || id AS canonical_name", "array() AS aliases")
    edges = people.selectExpr("character_id", "character_id AS mention_id")
    seen = people.selectExpr("character_id", "1 AS scene_id", "'mentioned' AS kind", "1 AS mention_count")
    ends = components.final_targets(merges)
    assert {tuple(r) for r in ends.collect()} == {(i, i - i % 5) for i in range(4000) if i % 5}
    for plan in (ends, *upsert.accepted(people, edges, seen, merges)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
