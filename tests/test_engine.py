"""Sources, ingestion, evidence, tables, resolution, scores and streaming on crafted inputs."""

import io
import json
import os
import random
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext import errors
from loomtext.operators import evidence, metrics, reads, resolution, segmentation, upsert
from loomtext.plans import catalogue, ingest, layers, model_path
from loomtext.schemas import BLOCK, EXTRACTION, RELATIONS, valid_relation
from loomtext.sources import manuscripts, markup, models, responses
from loomtext.streaming.incremental import ingest_stream

STORY = """The Project Gutenberg eBook of A Story

*** START OF THE PROJECT GUTENBERG EBOOK 1 ***

A Story

CONTENTS

PROLOGUE

Before it all, there was
a house.


CHAPTER I.

Mr. Vale met Rosa at the gate.

* * *

Rosa left for  the sea.

* * *

***

CHAPTER II

CHAPTER III

Vale wrote to Rosa.\t

*** END OF THE PROJECT GUTENBERG EBOOK 1 ***

license text
"""


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "story.txt").write_bytes(b"\xef\xbb\xbf" + STORY.replace("\n", "\r\n").encode())
    return {k: v.cache() for k, v in ingest.ingest(spark, str(d)).items()}, d


def test_story(raw):
    tables, _ = raw
    scenes = sorted(tables["scene"].collect(), key=lambda s: s.order_narrative_global)
    assert [s.text for s in scenes] == ["Before it all, there was a house.", "Mr. Vale met Rosa at the gate.", "Rosa left for the sea.", "Vale wrote to Rosa."]
    assert [(s.order_narrative, s.order_in_chapter, s.boundary_reason) for s in scenes] == [(0, 0, "chapter_start"), (1, 0, "chapter_start"), (1, 1, "separator"), (2, 0, "chapter_start")]
    assert scenes[0].start_offset == 0 and all(b.start_offset == a.end_offset + 2 for a, b in zip(scenes, scenes[1:], strict=False))
    chapters = sorted(tables["chapter"].collect(), key=lambda c: c.order_narrative)
    assert [(c.title, c.kind) for c in chapters] == [("PROLOGUE", "prologue"), ("CHAPTER I", "chapter"), ("CHAPTER III", "chapter")]
    assert {(b.kind, b.detected_by) for b in tables["non_narrative_block"].collect()} == {("frontmatter", "frontmatter_position"), ("toc", "toc_heuristic")}
    assert tables["next_scene"].count() == 3 and tables["next_chapter"].count() == 2
    book = tables["manuscript"].first()
    assert (book.scene_count, book.chapter_count, book.word_count) == (4, 3, 23)


def test_saving_twice_leaves_the_same_tables(spark, raw, tmp_path):
    for _ in range(2):
        ingest.saved(spark, raw[0], str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/scene").count() == 4 and spark.read.parquet(f"{tmp_path}/manuscript").count() == 1


def test_errors_of_files(spark, tmp_path):
    for name, content, error in (("a.pdf", b"x", errors.UnsupportedFormat), ("b.txt", b" \n ", errors.InvalidFile), ("c.txt", b"***", errors.NoNarrativeContent)):
        d = tmp_path / name[0]
        d.mkdir()
        (d / name).write_bytes(content)
        with pytest.raises(error):
            ingest.ingest(spark, str(d))
    assert errors.NotExtracted.code == "not_extracted"


def test_latin1_and_no_headings(spark):
    frame = spark.createDataFrame([("x", bytearray("Año nuevo.\r\rFin".encode("latin-1")))], "manuscript_id string, content binary").withColumn("text", manuscripts.decoded("content"))
    blocks = manuscripts.text_blocks(frame)
    assert [b.text for b in blocks.orderBy("pos").collect()] == ["Año nuevo.", "Fin"]
    assert segmentation.raw_scenes(blocks).first().text == "Año nuevo.\n\nFin"


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="u"><metadata xmlns:dc="d"><dc:title> T </dc:title></metadata><manifest><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/><itemref idref="a"/></spine><guide><reference type="cover" href="c.xhtml#top"/></guide></package>')
        z.writestr("OEBPS/c.xhtml", "<html><body><p>Cover</p></body></html>")
        z.writestr("OEBPS/a b.xhtml", "<html><body><h1>Chapter <i>1</i></h1><p>One &amp; two</p><hr/><p>* * *</p><p>End<br/>here</p></body></html>")
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://w"'
    p = lambda text, style="", jc="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{f"<w:jc w:val={chr(34)}{jc}{chr(34)}/>" if jc else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('One', 'Heading2')}{p('Text')}{p('')}{p('', '', 'center')}{p('* * *', '', 'center')}{p('More')}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_zip_formats(spark):
    title, blocks = manuscripts.epub_blocks(epub())
    assert title == "T" and blocks == [("paragraph", "Cover", None, None, "cover"), ("heading", "Chapter 1", 1, None, None), ("paragraph", "One & two", None, None, None), ("separator", "***", None, None, None), ("separator", "* * *", None, None, None), ("paragraph", "End here", None, None, None)]
    _, blocks = manuscripts.docx_blocks(docx())
    assert [(b[0], b[1], b[2]) for b in blocks] == [("heading", "One", 2), ("paragraph", "Text", None), ("separator", "***", None), ("separator", "* * *", None), ("paragraph", "More", None)]
    found = spark.createDataFrame([("e.epub", bytearray(epub()), "epub"), ("d.docx", bytearray(docx()), "docx")], "manuscript_id string, content binary, format string")
    layer = ingest.raw_layer(manuscripts.blocks(found))
    assert sorted((r.source_format, r.scene_count) for r in layer["manuscript"].collect()) == [("docx", 2), ("epub", 2)]
    assert [(b.kind, b.detected_by) for b in layer["non_narrative_block"].collect()] == [("cover", "source_role")]
    assert markup.parsed("<script>x</script><p>a<p>b</p><style>q</style><h3> </h3>") == [("paragraph", "a", None), ("paragraph", "b", None)]


def test_named_references_end_with_a_semicolon():
    said = lambda text: [b[1] for b in markup.parsed(f"<p>{text}</p>")]
    assert said("a &amp;amp; b&amp &copy; &copy 1") == ["a &amp; b&amp © &copy 1"]
    assert said("&ampx; &nix; &#38; & &<b>x</b>&am") == ["&ampx; &nix; & & & x &am"]
    assert markup.parsed("<h1>R&ampD")[0][1] == "R&ampD"


def plain_pair(rows):
    """One pair's evidence in narrative order, by the rules in words."""
    weight = {}
    for r in rows:
        weight[r[0]] = weight.get(r[0], 0) + (2 if r[1] == "extracted" else 1)
    tied = [t for t in weight if weight[t] == max(weight.values())]
    pool = [r for r in rows if r[0] in tied and r[1] == "extracted"] or [r for r in rows if r[0] in tied]
    won = [r for r in rows if r[0] == pool[-1][0]]
    best = max(won, key=lambda r: r[2])
    if best[2] < 0.5:
        return None
    a, b = {r[4] for r in won if r[4]}, {r[5] for r in won if r[5]}
    clash = len(a) > 1 or len(b) > 1
    return pool[-1][0], best[3], None if clash or not a else a.pop(), None if clash or not b else b.pop(), "extracted" if any(r[1] == "extracted" for r in won) else "inferred", best[2], len(rows)


def test_relation_map_on_random_pairs(spark):
    rng = random.Random(3)
    data, expected = [], {}
    for pair in range(300):
        rows = [(rng.choice(["family", "social", "romantic"]), rng.choice(["extracted", "inferred"]), rng.choice([0.2, 0.49, 0.5, 0.8, 1.0]), f"d{i}", rng.choice([None, None, "x", "y"]), rng.choice([None, None, None, "z", "w"])) for i in range(rng.randint(1, 6))]
        expected[f"{pair:03}"] = plain_pair(rows)
        data += [("m", f"{pair:03}", "zz", f"e{pair}-{i}", i, *r) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, "manuscript_id string, character_a_id string, character_b_id string, evidence_id string, narrative_order long, rel_type string, provenance string, confidence double, descriptor string, role_a string, role_b string")
    got = {r.character_a_id: (r.rel_type, r.descriptor, r.role_a, r.role_b, r.provenance, r.confidence, r.evidence_count) for r in evidence.relation_map(frame).collect()}
    assert got == {k: v for k, v in expected.items() if v}


def test_attribute_contradictions_stay(spark):
    rows = [("m", "c", "eye_color", "blue", 0.3, "e2", 2), ("m", "c", "eye_color", "blue", 0.9, "e1", 1), ("m", "c", "eye_color", "green", 0.1, "e3", 3), ("m", "c", "status", "dead", 1.0, "e4", 4)]
    sheet = evidence.attribute_sheet(spark.createDataFrame(rows, "manuscript_id string, character_id string, key string, value_norm string, confidence double, evidence_id string, narrative_order long"))
    assert {(r.value_norm, r.confidence, r.evidence_count, r.first_evidence_id, r.attr_class) for r in sheet.collect()} == {("blue", 0.9, 2, "e1", "static"), ("green", 0.1, 1, "e3", "static"), ("dead", 1.0, 1, "e4", "stateful")}


def test_layers_from_stored_responses(spark, raw):
    scenes = raw[0]["scene"]
    ana = lambda name, aliases=(), present=True, role="unknown", kind="person": {"canonical_name": name, "aliases": list(aliases), "role": role, "entity_kind": kind, "is_present_in_scene": present}
    said = lambda surface, to=None: {"surface": surface, "kind": "name", "links_to": to, "quote": f"q {surface}"}
    by = [
        {"mentions": [], "new_characters": [ana("the waiter")], "present_entities": []},
        {"mentions": [said("Mr. Vale"), said("Rosa")], "new_characters": [ana("Mr. Vale", ["Vale", "he"], role="protagonist"), ana("Rosa"), ana("Rex", kind="animal")], "present_entities": ["Rex"]},
        {"mentions": [said("Rosa"), said("nowhere")], "new_characters": [], "present_entities": ["Rosa", "Nobody"]},
        {"mentions": [said("Vale"), said("Rosa", "Rosa")], "new_characters": [ana("Vale", present=False, role="minor")], "present_entities": []},
    ]
    keyed = layers.keyed(scenes, "m", "1", "1")
    keys = {r.order_narrative_global: r.cache_key for r in keyed.collect()}
    store = lambda rows: spark.createDataFrame(rows, "cache_key string, payload string")
    looked = layers.extractions(keyed, store([(keys[i], json.dumps(x)) for i, x in enumerate(by)]))
    assert layers.run_counters(looked).first().cache_hits == 4
    layer = {k: v.cache() for k, v in layers.character_layer(looked.cache()).items()}
    people = {r.canonical_name: r for r in layer["character"].collect()}
    assert set(people) == {"Mr. Vale", "Rosa", "Rex"}
    assert (people["Mr. Vale"].role, people["Mr. Vale"].mention_count, people["Mr. Vale"].appearance_count) == ("protagonist", 2, 2)
    assert (people["Rosa"].mention_count, people["Rosa"].appearance_count, people["Rosa"].is_mentioned_only) == (3, 3, False)
    casts = evidence.scene_casts(layer["appears_in"], layer["character"])
    vale, rosa = people["Mr. Vale"].character_id, people["Rosa"].character_id
    asked = layers.keyed(scenes, "m", "1", "1", casts, 2)
    rel = {r.order_narrative_global: r.cache_key for r in asked.collect()}
    assert set(rel) == {1, 3}
    e = lambda a, b, c: {"character_a_id": a, "character_b_id": b, "rel_type": "romantic", "descriptor": "d", "role_a": "r1", "role_b": "r2", "provenance": "extracted", "confidence": c, "quote": "q"}
    stored = store([(rel[1], json.dumps({"evidences": [e(rosa, vale, 0.4), e(vale, rosa, 0.8), e(vale, "stranger", 1.0)]})), (rel[3], json.dumps({"evidences": [e(vale, vale, 0.9)]}))])
    relations = layers.relation_layer(asked, stored)
    edge = relations["relates_to"].collect()
    assert len(edge) == 1 and edge[0].confidence == 0.8 and edge[0].evidence_count == 1
    roles = {edge[0].character_a_id: edge[0].role_a, edge[0].character_b_id: edge[0].role_b}
    assert roles == {vale: "r1", rosa: "r2"}
    attrs = layers.attribute_layer(layers.keyed(scenes, "m", "1", "1", casts, 1), store([]))
    assert attrs["attribute"].count() == 0
    assert responses.looked_up(asked, stored, RELATIONS, F.forall("response.evidences", valid_relation), force=True).where("hit").count() == 0


def test_model_answers(spark):
    class Flaky:
        def __init__(self):
            self.n = 0

        def complete_structured(self, system, user, schema):
            self.n += 1
            if user == "bad" or self.n == 1:
                raise errors.ContractViolation(user)
            return {"user": user}

    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "cache_key string, prompt string").coalesce(1)
    got = {r.cache_key: (r.payload, r.error is None) for r in models.answered(rows, "s", "x int", Flaky).collect()}
    assert got == {"1": ('{"user": "good"}', True), "2": (None, False)}


def test_resolution_cascade(spark):
    c = lambda scene, name, aliases=(): ("m", scene, 0, name, list(aliases), "unknown", "person")
    rows = [c(1, "Mr. Darcy"), c(2, "Darcy"), c(3, "Mrs. Darcy"), c(4, "Fitzwilliam Darcy"), c(5, "Elizabeth Bennet"), c(6, "Jane Bennet"), c(7, "Lizzy", ["Elizabeth Bennet"]), c(8, "the crowd"), c(9, "Georgiana Darcy"), c(10, "Elizabeth B")]
    frame = spark.createDataFrame(rows, resolution.CANDIDATE)
    plain = {r.canonical_name: (r.outcome, r.resolved_name) for r in resolution.resolved(frame).collect()}
    assert plain["Darcy"] == ("merged", "Mr. Darcy") and plain["Mrs. Darcy"] == ("new", "Mrs. Darcy") and plain["Lizzy"] == ("merged", "Elizabeth Bennet") and plain["the crowd"][0] == "filtered"
    judged = spark.createDataFrame([("m", "Mr. Darcy", "Fitzwilliam Darcy", True, 0.95, "why"), ("m", "Elizabeth Bennet", "Jane Bennet", True, 0.6, "sisters"), ("m", "Elizabeth B", "Elizabeth Bennet", True, 0.9, "same")], "manuscript_id string, name_a string, name_b string, same_entity boolean, confidence double, rationale string")
    decided = spark.createDataFrame([("m", "Georgiana Darcy", "Mr. Darcy", "accepted")], "manuscript_id string, name_a string, name_b string, status string")
    out = {r.canonical_name: (r.outcome, r.resolved_name) for r in resolution.resolved(frame, decided, judged).collect()}
    assert out["Fitzwilliam Darcy"] == ("queued", "Mr. Darcy") and out["Jane Bennet"] == ("queued", "Elizabeth Bennet")
    assert out["Georgiana Darcy"] == ("merged", "Mr. Darcy") and out["Elizabeth B"] == ("merged", "Elizabeth Bennet")
    registry = resolution.Registry()
    registry.add("A", [], "unknown", "person")
    registry.add("B", ["Bee"], "minor", "person")
    registry.absorb("A", "B")
    assert registry.find("Bee") == "A" and registry.entries == {"A": {"aliases": ["B", "Bee"], "role": "minor", "entity_kind": "person"}}


def test_tables(spark):
    kind = "candidate_id string, status string, resolved_at string"
    rows = spark.createDataFrame([("1", "pending", None), ("2", "rejected", "x")], kind)
    assert {(r.candidate_id, r.status) for r in upsert.decided(rows, "1", "accept").collect()} == {("1", "accepted"), ("2", "rejected")}
    for ident, decision, error in (("9", "accept", errors.CandidateNotFound), ("2", "reject", errors.CandidateResolved), ("1", "maybe", errors.InvalidDecision)):
        with pytest.raises(error):
            upsert.decided(rows, ident, decision)
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert sorted(map(tuple, upsert.upserted(a, b, ["k"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    assert sorted(map(tuple, upsert.inserted(a, b, ["k"]).collect())) == [(1, "old"), (2, "old"), (3, "new")]
    seen = spark.createDataFrame([("c", "s", "present")], "character_id string, scene_id string, kind string")
    later = spark.createDataFrame([("c", "s", "mentioned"), ("c", "t", "mentioned")], seen.schema)
    assert sorted(map(tuple, upsert.upserted_appearances(seen, later).collect())) == [("c", "s", "present"), ("c", "t", "mentioned")]
    books = spark.createDataFrame([("m",)], "manuscript_id string")
    assert upsert.without(books, []).count() == 1 and upsert.without(books, ["m"]).count() == 0
    runs = spark.createDataFrame([("m", "characters")], "manuscript_id string, layer string")
    reads.require(books, runs, "m", "characters")
    for ident, layer, error in (("x", "characters", errors.ManuscriptNotFound), ("m", "relations", errors.NotExtracted)):
        with pytest.raises(error):
            reads.require(books, runs, ident, layer)


def test_scores(spark):
    side = lambda rows: spark.createDataFrame(rows, "key string, cluster string")
    gold, found = [("a", "1"), ("b", "1"), ("c", "2")], [("a", "x"), ("b", "y"), ("d", "y")]
    p = (1 + 1 / 2) / 4
    r = (1 / 2 + 1 / 2) / 4
    got = metrics.bcubed(side(gold), side(found)).first()
    assert (round(got.precision, 9), round(got.recall, 9), round(got.f1, 9)) == (round(p, 9), round(r, 9), round(2 * p * r / (p + r), 9))
    edges = spark.createDataFrame([("w", 1, 5), ("w", 1, 6), ("w", 2, 5), ("w", 3, 5), ("w", 3, 6)], "work string, pred int, gold int")
    assert sorted(map(tuple, metrics.greedy_matches(edges, "work", "pred", "gold").collect())) == [("w", 1, 5), ("w", 3, 6)]


def test_stream_gives_the_tables_of_the_batch(spark, tmp_path):
    rows = [("s", 0, "heading", "CHAPTER I", 1, None, None), ("s", 1, "paragraph", "One.", None, None, None), ("s", 2, "separator", "***", None, None, None), ("s", 3, "paragraph", "Two.", None, None, None), ("t", 0, "paragraph", "Other.", None, None, None)]
    source, target = tmp_path / "in", tmp_path / "out"
    for part in (rows[:2] + rows[4:], rows[2:4]):
        spark.createDataFrame(part, BLOCK).coalesce(1).write.mode("append").json(str(source))
        ingest_stream(spark, str(source), str(target), str(tmp_path / "log")).awaitTermination()
    got = {(r.source_id, r.scene_id, r.text) for r in spark.read.parquet(str(target / "scene")).collect()}
    assert got == {(r.source_id, r.scene_id, r.text) for r in segmentation.scene_table(spark.createDataFrame(rows, BLOCK)).collect()} and len(got) == 3


def test_the_rest_imports_without_the_llm_folders():
    code = "import sys; sys.modules['loomtext.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], timeout=60).returncode == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_resolution_fold_is_the_plain_fold(spark):
    """The query, with its decisions and judgements, against a fold over plain rows; names have no titles."""
    sf = "/root/testdata/sf0.001"
    works = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        words = r.p_name.title().split(" ")
        name = words[0] if r.p_partkey % 7 == 0 else " ".join(words)
        first = works.setdefault(str(r.p_partkey // 25), {})
        first[name] = min(first.get(name, r.p_partkey), r.p_partkey)
    expected = set()
    for work, first in works.items():
        forms, known = {}, []
        for name, at in sorted(first.items(), key=lambda x: x[1]):
            aliases = [name.split()[0]] if at % 3 == 0 else []
            target = next((forms[n.lower()] for n in [name, *aliases] if n.lower() in forms), None)
            outcome, confidence, why = ("merged" if target else "new"), None, None
            for other in [] if target else known:
                x, y = sorted((name, other))
                key, xs, ys = first[x] * 31 + first[y] * 17, x.lower().split(), y.lower().split()
                if not set(xs) & set(ys):
                    continue
                if key % 11 == 0:
                    outcome, target = "merged", other
                    break
                inside = len(xs) != len(ys)
                if key % 11 == 1 or key % 3 == 0 or not (inside or xs[-1] == ys[-1]) or key % 61 < 10:
                    continue
                auto = inside and key % 61 >= 50 and min(xs, ys, key=len)[0] != max(xs, ys, key=len)[-1]
                outcome, target, confidence, why = "merged" if auto else "queued", other, (40 + key % 61) / 100, f"r{key}"
                break
            expected.add((work, at, name, target or name, outcome, confidence, why))
            canonical = forms.get((target if outcome == "merged" else name).lower())
            if canonical is None:
                canonical = name
                known.append(name)
                forms[name.lower()] = name
            for alias in aliases:
                forms[alias.lower()] = canonical
    got = {(r.manuscript_id, r.scene_order, r.canonical_name, r.resolved_name, r.outcome, r.confidence, r.rationale) for r in catalogue.QUERIES["q34_resolution_fold"](spark, sf).collect()}
    clean = lambda rows: {tuple(None if x != x else x for x in r) for r in rows}
    assert clean(got) == expected and {r[4] for r in expected} == {"new", "merged", "queued"}
    assert any(r[4] == "merged" and r[5] for r in expected)


def test_headings_of_signs_are_headings():
    from loomtext.sources.markup import parsed

    assert parsed("<h2>* * *</h2><p>* * *</p><p>x</p>") == [("heading", "* * *", 2), ("separator", "* * *", None), ("paragraph", "x", None)]
    w = 'xmlns:w="http://w"'
    paragraph = lambda style, text, extra="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = paragraph("Heading1", "—") + paragraph("Normal", "—") + paragraph("SceneSeparator", "x") + paragraph("Normal", "", '<w:jc w:val="center"/>') + paragraph("Heading2", "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    _, blocks = manuscripts.docx_blocks(out.getvalue())
    assert [b[:3] for b in blocks] == [("heading", "—", 1), ("separator", "—", None), ("separator", "x", None), ("separator", "***", None)]


def test_kinds_of_declared_roles(spark):
    rows = [("m", i, "paragraph", f"t{i}", None, None, role) for i, role in enumerate(("Title-Page", "cover", "copyright", "titlepage", "acknowledgements", "dedication", "notes", "loi"))]
    found = segmentation.non_narrative(spark.createDataFrame(rows, BLOCK)).orderBy("block_no").collect()
    assert [(r.kind, r.text.replace("\n\n", " ")) for r in found] == [("cover", "t0 t1"), ("license", "t2"), ("cover", "t3"), ("frontmatter", "t4 t5"), ("backmatter", "t6"), ("toc", "t7")]


def test_orders_of_the_character_list(spark):
    people = spark.createDataFrame([("a", "Zoe", "minor"), ("b", "Ann", "minor"), ("c", "Mia", "minor")], "character_id string, canonical_name string, role string")
    seen = spark.createDataFrame([("a", "s1", "present"), ("a", "s2", "present"), ("b", "s3", "mentioned"), ("c", "s0", "present")], "character_id string, scene_id string, kind string")
    said = lambda **how: [r.character_id for r in reads.character_list(people, seen, **how).orderBy("place").collect()]
    assert said() == said(order_by="unheard of") == said(order_by="appearances") == ["a", "b", "c"]
    assert said(order_by="first_appearance") == ["c", "a", "b"] and said(order_by="name") == ["b", "c", "a"] and said(include_mentioned_only=False) == ["a", "c"]


def test_bad_files_fail_alone_and_titles_stay(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, content in (("a.epub", epub()), ("b.epub", b"PK no zip"), ("c.docx", docx()), ("d.pdf", b"x"), ("e.txt", b" \n\t"), ("f.txt", b"CHAPTER I\n\n***"), ("g.txt", b"Just text.")):
        (d / name).write_bytes(content)
    tables = ingest.ingest(spark, str(d), str(tmp_path / "staging"))
    name = lambda r: r.source_id.rsplit("/", 1)[1]
    assert {(name(r), r.title) for r in tables["manuscript"].collect()} == {("a.epub", "T"), ("c.docx", None), ("g.txt", None)}
    assert {(name(r), r.code) for r in tables["failed"].collect()} == {("b.epub", "invalid_file"), ("d.pdf", "unsupported_format"), ("e.txt", "invalid_file"), ("f.txt", "no_narrative_content")}
    known = tables["manuscript"].where("source_format = 'txt'")
    said = {r.source_format: r for r in ingest.summaries(tables, known).collect()}
    assert (said["txt"].created, said["epub"].created, said["epub"].non_narrative_block_count, said["epub"].scene_count) == (False, True, 1, 2)
    assert all(r.created for r in ingest.summaries(tables).collect())


class Author:
    """A model that knows each scene by a word of it; it counts nothing, as each task has its own."""

    def complete_structured(self, system, user, schema):
        if "broken" in user:
            raise errors.ContractViolation("no tool call")
        scene = user.split("<scene>\n")[1]
        return {"mentions": [], "new_characters": [{"canonical_name": scene.split()[0], "aliases": [], "role": "minor", "entity_kind": "person", "is_present_in_scene": True}], "present_entities": [], "notes": user.split("\n")[0]}


class Silent:
    def complete_structured(self, system, user, schema):
        raise errors.ModelUnavailable("no network")


def test_misses_go_to_the_model_and_stay_stored(spark, tmp_path):
    store = str(tmp_path / "store")
    scenes = spark.createDataFrame([("m", f"m:c0:s{i}", i, t, f"CHAPTER {i}" if i else None) for i, t in enumerate(("Ana sings", "Ben sleeps", "broken scene", "Ana sings"))], "manuscript_id string, scene_id string, order_narrative_global int, text string, title string")
    keyed = layers.keyed(scenes, "m", "1", "1")
    ask = lambda client, **how: model_path.completed(keyed, store, "extraction", EXTRACTION, layers.extraction_contract(), client, F.array(F.lit("Known")), F.col("title"), **how)
    counts = lambda done: model_path.counters(done).first().asDict()
    assert counts(ask(None)) == {"manuscript_id": "m", "scenes": 4, "cache_hits": 0, "written": 0, "failed": 0, "skipped": 4}
    first = ask(Author).cache()
    assert counts(first) == {"manuscript_id": "m", "scenes": 4, "cache_hits": 0, "written": 3, "failed": 1, "skipped": 0}
    said = {r.order_narrative_global: r for r in first.collect()}
    assert said[2].error.startswith("contract_violation") and said[2].response is None
    assert said[1].response.notes == "Chapter: CHAPTER 1" and said[0].response.notes == 'Context: ["Known"]'
    again = ask(None)
    assert counts(again)["cache_hits"] == 3 and counts(again)["skipped"] == 1
    assert {r.canonical_name for r in layers.character_layer(again)["character"].collect()} == {"Ana", "Ben"}
    rows = spark.read.parquet(store).count()
    forced = ask(Author, force=True)
    assert counts(forced)["cache_hits"] == 0 and counts(forced)["written"] == 3 and spark.read.parquet(store).count() == rows + 3
    with pytest.raises(Exception, match="no network"):
        ask(Silent)
    assert counts(ask(None))["cache_hits"] == 3


def test_judge_is_asked_about_similar_names_with_quotes(spark):
    c = lambda scene, name: ("m", scene, 0, name, [], "minor", "person")
    rows = spark.createDataFrame([c(0, "Fitzwilliam Darcy"), c(1, "Georgiana Darcy"), c(2, "Ana"), c(3, "Darcy"), c(4, "Mrs. Hill")], resolution.CANDIDATE)
    scenes = spark.createDataFrame([("m", i, f"text {i} " * 900) for i in range(5)], "manuscript_id string, order_narrative_global int, text string")
    mentions = spark.createDataFrame([("m", "Fitzwilliam Darcy", f"quote {i} " * 100, f"id{i}", i) for i in range(5)], "manuscript_id string, canonical_name string, quote string, mention_id string, scene_order int")
    asked = {(r.name_a, r.name_b): r.prompt for r in model_path.judge_questions(rows, scenes, mentions).collect()}
    assert set(asked) == {("Fitzwilliam Darcy", "Georgiana Darcy"), ("Fitzwilliam Darcy", "Darcy"), ("Georgiana Darcy", "Darcy"), ("Georgiana Darcy", "Ana")}  # Georgi-ana
    prompt = asked["Fitzwilliam Darcy", "Darcy"]
    assert "quote 2" in prompt and "quote 3" not in prompt and "text 3" in prompt and len(prompt) < 1500 + 3 * 320 + 500

    class Judge:
        def complete_structured(self, system, user, schema):
            if "Georgiana" in user:
                raise errors.ContractViolation("x")
            return {"same_entity": True, "confidence": 0.95, "rationale": "one family"}

    told = model_path.judgements(model_path.judge_questions(rows, scenes, mentions), Judge).collect()
    assert [(r.name_a, r.name_b, r.same_entity, r.confidence) for r in told] == [("Fitzwilliam Darcy", "Darcy", True, 0.95)]
