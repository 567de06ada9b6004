"""Repeated rows, clashing columns, very long texts and labels that differ: every operator and stage has a defined result."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import boosted, decontaminate, jaccard, licenses, lm, packing, pii, quality, suffixes, toxicity, urls
from loomtext.llm.queries import vocabulary_path
from loomtext.llm.shared import written
from tests.llm.conftest import SCHEMA, prose, rows_of

CLASHES = ("tid", "key", "root", "n", "row", "whole", "kept", "item_id", "component_id", "label", "block", "spans", "words", "_tid")


@pytest.fixture(scope="module")
def twice(spark):
    rng = random.Random(70)
    texts = [prose(rng, rng.randint(25, 90)) for _ in range(12)] + [None, "", "one two"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    return docs, docs.unionAll(docs), texts


def both(one, two, key="doc_id"):
    """Rows of the table and of the table twice; each row of the first stands twice in the second."""
    a, b = (sorted(map(repr, (tuple(r) for r in d.collect()))) for d in (one, two))
    return a, b, sorted([*a, *a])


def test_rows_judged_alone_are_judged_twice(spark, twice):
    docs, doubled, texts = twice
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(0, 1, 1), (0, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    rules = quality.learnt_from(docs, labels)
    assert rules == quality.learnt_from(docs, labels.orderBy(F.desc("quality"))) == quality.learnt_from(docs, labels.orderBy("quality"))
    for f in (lambda d: quality.judged(d, rules), lambda d: toxicity.scored(d, toxicity.trained(docs, labels)).select("doc_id", "score")):
        _, b, want = both(f(docs), f(doubled))
        assert b == want
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.net/es/1", "http://b.org/x", None, "http://c.com/y"])], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "tokens", "set_id", "mined", "rule")})
    _, b, want = both(urls.judged(pages), urls.judged(pages.unionAll(pages)))
    assert b == want


def test_rows_judged_together_count_as_often_as_they_stand(spark, twice):
    docs, doubled, texts = twice
    rows = lm.scored(doubled, order=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_hits, r.log_micro))
    assert len(rows) == 2 * len(texts) and all(len(x) == 2 and x[0] == x[1] for x in by.values())
    assert all(x[0][1] == max(0, x[0][0] - 2) for x in by.values())  # the other row has every trigram
    gone = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.without_repeats(doubled).collect()}
    assert gone == {(i, len(t or ""), len(t or "") if len(t or "") >= 400 else 0) for i, t in enumerate(texts)}
    pieces = packing.pack_documents(doubled, vocabulary_path()).collect()
    assert len(pieces) == 2 * packing.pack_documents(docs, vocabulary_path()).count() and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_stages_with_repeated_rows_and_clashing_columns(spark, twice, tmp_path):
    docs, doubled, texts = twice
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, texts[0])], "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, counts = doubled.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        doubled = written(stage(spark, doubled, str(tmp_path)), name)
        counts.append(doubled.count())
        assert doubled.columns == columns
    assert counts == [24, 12, 11, 11]  # both rows of a kept text pass the rules; then one row of each text stays


def test_a_very_long_text(spark):
    rng = random.Random(71)
    text = prose(rng, 150_000)
    docs = spark.createDataFrame([(1, text), (2, text[:500_000]), (3, "short")], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.stats(docs).collect()}
    assert found[1].n_words == len(text.split()) and found[1].n_repeat_words == 0
    cut = {r.doc_id: r.n_removed for r in suffixes.without_repeats(docs).collect()}
    assert cut == {1: 500_000, 2: 500_000, 3: 0}
    assert {r.doc_id: r.n_words for r in lm.scored(docs).collect()}[1] == len(text.split())


def test_a_very_long_text_in_the_other_operators(spark):
    """One text of a megabyte, one that is half of it, a short one: personal data, benchmark passages, licenses, packing, joins, scores."""
    rng = random.Random(72)
    text, item = prose(rng, 150_000), prose(rng, 60)
    long = f"{text} write to a.b@example.org or {item} now. {text[:1000]}"
    docs = spark.createDataFrame([(1, long), (2, text[:500_000]), (3, "short and b@c.de")], "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    kinds = {r.doc_id: (r.n_email, r.n_ip) for r in pii.digest(pii.found(docs)).collect()}
    assert kinds == {1: (1, 0), 2: (0, 0), 3: (1, 0)}
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, benchmark, k=5, least=0.8).collect()} >= {1}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()} == {2, 3}
    assert licenses.scanned(docs).where("doc_id in (1, 2)").select("doc_id").distinct().count() in (0, 2)  # with or without a row, but whole
    pieces = packing.pack_documents(docs, vocabulary_path()).where("doc_id = 1").collect()
    assert sorted(p.piece for p in pieces) == list(range(len(pieces))) and all(p.length == 1024 for p in pieces if p.piece) and len(pieces) > 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs, k=3, percent=90).collect()}
    assert got[1][0] > 149_000 and {d: c for d, (_, c) in got.items()} == {1: 1, 2: 2, 3: 3}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    for scores in (toxicity.scored(docs, toxicity.trained(docs, labels)), boosted.scored(docs, boosted.trained(docs, labels))):
        assert {r.doc_id: 0 <= r.score <= 1 for r in scores.collect()} == {1: True, 2: True, 3: True}


def test_ties_in_packing_and_scores(spark):
    """Texts of one length and equal texts: places stay gapless, equal texts have equal scores, whatever the order of rows."""
    docs = spark.createDataFrame([(i, "same words here again " * 40) for i in range(60)], "doc_id long, text string")
    placed = packing.pack_documents(docs, vocabulary_path()).collect()
    by = {}
    for p in placed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(at == sum(n for _, n in sorted(x)[:i]) for x in by.values() for i, (at, _) in enumerate(sorted(x))) and max(sum(n for _, n in x) for x in by.values()) <= 1024
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for model in (toxicity, boosted):
        one, two = (model.scored(d, model.trained(d, labels)).collect() for d in (docs, docs.orderBy(F.desc("doc_id"))))
        assert len({r.score for r in one}) == 1 and {r.score for r in one} == {r.score for r in two}


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
