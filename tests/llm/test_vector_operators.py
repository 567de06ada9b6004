"""Clusters, codes and the quality classifier against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import boosted, hamerly, segmentcodes
from loomtext.llm.shared import released, shared_dir, written
from tests.llm.conftest import SCHEMA, prose, rows_of

VECTORS = "vec_id long, embedding array<float>, label int"


def rows_near(rng, n, dims, centres, spread):
    middle = [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(centres)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in middle[i % centres]], i % 3 if i % 7 else None) for i in range(n)]


def odd(dims):
    """Rows that are left out, whatever the operator."""
    return [(900, None, 1), (901, [0.5] * (dims - 1) + [None], 1), (902, [float("nan")] + [0.5] * (dims - 1), 1), (903, [0.5] * (dims - 1) + [float("-inf")], None)]


def whole(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(rows, scale, k, rounds, seed):
    kept = [(i, whole(v, scale)) for i, v, _ in rows]
    ranked = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ranked[:k]]
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if c in own else old for c, old in enumerate(centroids)]
    out = [(i, c := nearest(v), distance(v, centroids[c])) for i, v in kept]
    total = sum(d for _, _, d in out)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sum(e for _, x, e in out if x == c), total, digest[c]) for i, c, d in out]


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_are_lloyds(spark, spread):
    rng = random.Random(3)
    rows = rows_near(rng, 220, 8, 6, spread)
    rows += [(None, rows[0][1], 1), (None, rows[5][1], 1), (3, rows[9][1], 2), rows[4], rows[4]]  # no id, an id twice, a row three times
    table = spark.createDataFrame(rows + odd(8) + [(904, [0.1] * 7, 1), (905, [0.1] * 9, 1), (906, [], 1)], VECTORS).withColumns({c: F.lit(0) for c in ("v", "cluster", "upper", "lower", "distance", "n", "sums")})
    trace = []
    got = hamerly.clustered(table.repartition(5), dims=8, scale=64, k=6, rounds=3, seed=1, trace=trace).drop("measured")
    assert in_order(map(tuple, got.collect())) == in_order(lloyd(rows, 64, 6, 3, 1))
    assert len(trace) == 4
    if spread < 0.1:
        assert trace[-1] < len(rows) / 3  # bounds decide for most once centroids have settled


def test_clusters_of_few_equal_or_no_vectors(spark):
    clustered = lambda rows, **how: in_order(map(tuple, hamerly.clustered(spark.createDataFrame(rows, VECTORS), dims=2, **how).drop("measured").collect()))
    assert clustered([]) == clustered(odd(2)) == []
    few = [(i, [i / 4, 0.0], None) for i in range(3)]
    assert clustered(few) == in_order(lloyd(few, 64, 16, 3, 1))
    equal = [(i, [0.5, -0.5], 1) for i in range(40)]
    assert {r[1] for r in clustered(equal, k=4)} == {0} and clustered(equal, k=4) == in_order(lloyd(equal, 64, 4, 3, 1))
    with pytest.raises(Exception, match="beyond"):
        clustered([(1, [1e30, 0.0], 1)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 5]), st.sampled_from([1, 30, 3000]))
def test_bounds_hold_while_centroids_move(seed, k, reach):
    rng = np.random.default_rng(seed)
    v, centroids = rng.integers(-reach, reach + 1, (60, 4)), rng.integers(-reach, reach + 1, (k, 4))
    cluster, upper, lower = np.zeros(60, np.int64), np.full(60, np.inf), np.full(60, -np.inf)
    for step in range(5):
        hamerly.assign(v, centroids, cluster, upper, lower)
        d = hamerly.squared(v, centroids)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(60), cluster])
        d = d.astype(float)
        d[np.arange(60), cluster] = np.inf
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1))).all()
        moved = centroids + rng.integers(-(reach // 10 + step % 2), reach // 10 + step % 2 + 1, centroids.shape)
        upper, lower = hamerly.moved_bounds(cluster, upper, lower, np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(float)))
        centroids = moved


def plain_codes(rows, parts, entries, rounds, scale):
    kept = sorted(((i, whole(v, scale), label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(p, cut(v, p)), []).append(cut(v, p))
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        codes = [nearest(p, cut(v, p)) for p in range(parts)]
        coded.append((i, label, "".join(f"{c:02x}" for c in codes), sum(distance(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    return [(i, label, code, e, sum(x for _, other, _, x in coded if other == label), sha) for i, label, code, e in coded]


@pytest.mark.parametrize(("dims", "spread"), [(16, 0.02), (24, 1.0)])
def test_codes_against_plain_ones(spark, dims, spread):
    rng = random.Random(4)
    rows = rows_near(rng, 150, dims, 9, spread)
    rows += [(None, rows[0][1], 1), (3, rows[9][1], 2), rows[4], rows[4]]
    table = spark.createDataFrame(rows + odd(dims), VECTORS).withColumns({c: F.lit(0) for c in ("v", "code", "part", "entry", "sums", "of_label", "error")})
    got = segmentcodes.encoded(table.repartition(4), parts=4, entries=6, rounds=3, scale=4096)
    assert in_order(map(tuple, got.drop("measured").collect())) == in_order(plain_codes(rows, 4, 6, 3, 4096))
    if spread < 0.1:
        assert got.agg(F.avg("measured")).first()[0] < 4 * 6 / 2  # most entries are out by their bounds


def test_codes_of_few_equal_odd_or_no_vectors(spark):
    encoded = lambda rows, **how: segmentcodes.encoded(spark.createDataFrame(rows, VECTORS), parts=2, rounds=2, **how).drop("measured")
    assert encoded([]).count() == encoded(odd(4)).count() == 0
    few = [(i, [i / 4, 0.0, 1.0, -i / 8], 7) for i in range(3)]
    assert in_order(map(tuple, encoded(few).collect())) == in_order(plain_codes(few, 2, 16, 2, 4096))
    equal = [(i, [0.5, 0.25, 0.5, 0.25], None) for i in range(20)]
    assert {(r.code, r.error, r.label_error) for r in encoded(equal).collect()} == {("0000", 0, 0)}
    other = encoded([(0, [1.0], 1), (1, [], 1), *((i, [1.0, 2.0, 3.0, float(i)], 1) for i in range(2, 6)), (9, [1.0] * 6, 1)])
    assert {r.vec_id for r in other.where("code is null and error is null").collect()} == {0, 1, 9} and other.where("code is not null").count() == 4
    with pytest.raises(ValueError, match="256"):
        encoded(few, entries=300)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 11), st.sampled_from([1, 50, 10**6]))
def test_segment_bounds_lose_no_entry(seed, width, reach):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-reach, reach + 1, (40, width)), rng.integers(-reach, reach + 1, (7, width))
    entries[3] = entries[1]
    code, d, measured = segmentcodes.Codebook(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and 40 <= measured <= 280


def plain_statistics(text):
    words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    n, low = len(words), ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    size = lambda w: len(w.encode())
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    some = lambda a, b: a / b if b else 0.0
    count = lambda chars: sum(text.count(c) for c in chars)
    upper, lower_case = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    wide, bytes_ = sum(size(c) for c in text if ord(c) > 127), size(text)

    def again(k):
        grams = [tuple(low[i : i + k]) for i in range(n - k + 1)] if n >= k else ([tuple(low)] if n else [])
        return some(len(grams) - len(set(grams)), len(grams))

    return [
        math.log1p(n), math.log1p(bytes_), some(sum(map(size, words)), n), max(map(size, words), default=0), some(upper, upper + lower_case + wide), some(sum("0" <= c <= "9" for c in text), bytes_),
        some(count("#*$%&|<>{}=\\^~_@"), n), some(count("!?"), n), some(count(".,;:"), n), some(wide, bytes_), some(count(" \t\n\v\f\r"), bytes_),
        math.log1p(len(lines)), some(n, len(lines)), some(len(lines) - len(set(lines)), len(lines)), some(len(set(low)), n), some(max(map(low.count, low), default=0), n), some(sum(a == b for a, b in zip(low[1:], low, strict=False)), n),
        again(3), again(8), some(sum(size(w) < 3 for w in words), n), some(sum(size(w) > 1 and all("A" <= c <= "Z" for c in w) for w in words), n),
    ]


def test_statistics_against_plain_ones(texts):
    every = [*(t or "" for t in texts), "\n\n a\n\na\n", "x\n", "\nx", "A B AB ab\nAB"]
    got = boosted.statistics([t.encode() for t in every])
    assert got.shape == (len(every), len(boosted.STATISTICS))
    for row, text in zip(got, every, strict=True):
        assert row == pytest.approx(plain_statistics(text)), text[:60]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1 \n\té,#!"), max_size=30), min_size=1, max_size=6))
def test_statistics_do_not_depend_on_neighbours(texts):
    got = boosted.statistics([t.encode() for t in texts])
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(plain_statistics(text))


def test_flat_trees_are_walked_like_nodes():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 5))
    x[:, 4] = rng.integers(0, 3, 500)  # few values, many ties
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] == 1)).astype(float)
    forest = boosted.fitted(x, y, trees=25, depth=3)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > t[i] else 1)
            total += v[i - len(f)]
        return total

    assert forest.margin(x) == pytest.approx([walk(r) for r in x])
    assert (forest.score(x) > 0.5).mean() == pytest.approx(y.mean(), abs=0.03) and ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_first_split_is_the_best_one():
    """The root of the first tree against every split of every column, tried one by one."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 9, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    y[x[:, 1] > 5] = 1.0
    forest = boosted.fitted(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / 202
    first, second = y - p, np.full(200, p * (1 - p))
    gain = lambda m: first[m].sum() ** 2 / (second[m].sum() + 1)
    tried = {(f, t + 0.5): gain(x[:, f] <= t) + gain(x[:, f] > t) for f in range(3) for t in range(8)}
    assert max(tried, key=tried.get) == (forest.feature[0, 0], forest.threshold[0, 0])


def test_classifier_finds_low_quality_and_keeps_the_rest(spark):
    rng = random.Random(10)
    good = [prose(rng, rng.randint(30, 120)) for _ in range(160)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:20]] + [" ".join([rng.choice(["buy", "now"])] * 60) for _ in range(20)]
    texts = [*good, *bad, None, "", " \n\t", prose(rng, 60_000)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).withColumns({c: F.lit(1) for c in ("x", "h", "quality", "score")})
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(200)] + [(0, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    forest = boosted.trained(docs, labels, trees=30)
    got = {r.doc_id: r.score for r in boosted.scored(docs, forest).collect()}
    assert got.keys() == set(range(len(texts))) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i < 160) for i in held) and got[203] >= 0.3
    assert got[200] == got[201]
    upside = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = boosted.trained(docs, upside, trees=30)
    assert (other.value == forest.value).all() and (other.threshold == forest.threshold).all()  # held-out labels are not learnt from
    twice = sorted((r.doc_id, r.score) for r in boosted.scored(docs.unionAll(docs), forest).collect())
    assert twice == sorted([*got.items(), *got.items()])


def test_classifier_without_rows_or_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = boosted.trained(empty, none)
    assert boosted.scored(empty, forest).count() == 0
    docs = spark.createDataFrame(rows_of(["a b", None]), SCHEMA)
    assert {r.score for r in boosted.scored(docs, forest).collect()} == {0.5}
    one = boosted.trained(docs, spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    assert len({r.score for r in boosted.scored(docs, one).collect()}) == 1


def test_only_own_tables_are_released(spark, tmp_path):
    import os

    spark.range(3).write.parquet(f"{tmp_path}/t")
    released(spark.read.parquet(f"{tmp_path}/t"))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    own = written(spark.range(3).toDF("x"), "own")
    folder = [f for f in os.listdir(shared_dir(spark)) if f.startswith("own-")]
    released(own)
    assert len(folder) == 1 and folder[0] not in os.listdir(shared_dir(spark))
