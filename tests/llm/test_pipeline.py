"""The pipeline's stages, each judged on its own input, against plain versions."""

import os
import random

import pytest

import corpus_pipeline
from loomtext.llm import pii
from loomtext.llm.queries import ORACLES, QUERIES, vocabulary_path
from loomtext.llm.shared import written
from tests.llm.conftest import SCHEMA, prose, rows_of
from tests.llm.test_group_operators import plain_components
from tests.llm.test_text_operators import plain_stats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    d = tmp_path_factory.mktemp("sf")
    items = [prose(rng, 25), prose(rng, 40)]
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    texts += texts[:5] + [t + " more" for t in texts[5:9]]
    texts += [prose(rng, 30) + " " + items[0] + " " + prose(rng, 30), items[1], "mail a@b.org or 4539 1488 0343 6467 " + prose(rng, 30), None, "", "short text"]
    texts += [" ".join(w + "###" for w in prose(rng, 40).split()) for _ in range(25)] + ["again and again " * 30]
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, items


def test_every_stage(spark, tables):
    d, texts, items = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "personal_data", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), name)
        seen[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns

    def bad(t):
        n, _, _, _, repeated = plain_stats(t)
        return n < 20 or 100 * repeated > 30 * n

    kept = {i for i, t in enumerate(texts) if not bad(t) and "###" not in (t or "")}
    assert {r.doc_id for r in seen["quality_rules"]} == kept
    order = sorted(kept)
    groups = plain_components([texts[i] for i in order], 5, 80)
    first = {i for j, i in enumerate(order) if groups[j][1] == j}
    assert {r.doc_id for r in seen["jaccard_join"]} == first and len(first) < len(kept)
    clean = {i for i in first if not any(item in texts[i] for item in items)}
    assert {r.doc_id for r in seen["decontamination"]} == clean and len(clean) == len(first) - 2
    after = {r.doc_id: r for r in seen["personal_data"]}
    assert after.keys() == clean and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
    assert all(r.text == texts[i] for i, r in after.items() if not pii.spans_of(texts[i]))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    tokens = {}
    for r in seen["best_fit_packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in after.items()}
    assert corpus_pipeline.run(spark, d).count() == len(seen["best_fit_packing"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    said = c.execute(ORACLES[name])
    order = [d[0] for d in said.description]
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(said.fetchall())
