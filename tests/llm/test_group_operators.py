"""Repeated strings, the Jaccard join, components, toxicity and URL rules against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import jaccard, shared, suffixes, toxicity, urls
from loomtext.llm.components import components
from tests.llm.conftest import SCHEMA, prose, rows_of
from tests.llm.test_text_operators import WORD, low


def plain_removal(texts, size=400):
    data = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for t in data:
        for i in range(len(t) - size + 1):
            count[t[i : i + size]] += 1
    out = {}
    for d, t in enumerate(data):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[d] = (len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def removed(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(frame).collect()}


def test_repeated_strings(docs, texts, empty):
    assert removed(docs) == plain_removal(texts)
    assert suffixes.without_repeats(empty).count() == 0


def test_repeated_strings_at_every_edge(spark):
    """Copies of 399 to 401 bytes, overlapping ones, periods, and pieces shared by different sets of documents."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b, c = letters(401), letters(700), letters(2500)
    texts = [letters(50) + a[:399] + letters(30), a[:399], letters(20) + a, a + letters(10), a[1:], b, letters(3) + b[150:650] + letters(9), b[100:560] + "é" + c[300:1200], c, c[:1000] + letters(1) + c[1001:], c[600:] + c[:600], "xy" * 500, "xyz" * 200, "q" * 401, "q" * 400]
    texts += [c[i * 7 : i * 7 + 900] + letters(40) for i in range(12)]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    assert removed(frame) == plain_removal(texts)


def test_what_is_removed_and_what_is_left(spark):
    """Spans and the bytes left, of texts cut in a character, whole copies, short and null texts; the digests are of the same."""
    rng = random.Random(35)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b = letters(399), letters(900)
    texts = [letters(60) + a + "é" + letters(20), a + "è" + letters(30), letters(10) + b[:500] + "#" * 70 + b[500:], b, b, "short", None, ""]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    whole = {r.doc_id: (bytes(r.kept), [(x.s, x.e) for x in r.spans]) for r in suffixes.kept_texts(frame).collect()}
    told = {r.doc_id: r.spans for r in suffixes.without_repeats(frame).collect()}
    plain = plain_removal(texts)
    assert {i: (n, sum(e - s for s, e in whole[i][1]), len(whole[i][1]), hashlib.sha256(whole[i][0]).hexdigest()) for i, (n, *_) in plain.items()} == plain
    assert whole[0][1] == [(60, 460)] and whole[2][1] == [(10, 510), (580, 980)] and whole[3] == whole[4] == (b"", [(0, 900)]) and whole[5] == (b"short", [])
    assert told == {i: ",".join(f"{s}:{e}" for s, e in spans) for i, (_, spans) in whole.items()}


def plain_components(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def joined(frame, k, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(frame, k, percent).collect()}


def test_jaccard_join(docs, texts, empty):
    assert joined(docs, 3, 90) == plain_components(texts, 3, 90)
    assert jaccard.joined(empty).count() == 0 and jaccard.representatives(empty).count() == 0


def test_jaccard_join_of_chains_and_large_groups(spark):
    """Chains of small edits, pairs around the threshold, and a group with one root and several components."""
    rng = random.Random(21)
    texts = []
    for n in (11, 12, 20, 21, 40, 100, 150):
        w = prose(rng, n).split()
        for step in range(8):
            texts.append(" ".join(w))
            w = list(w)
            w[rng.randrange(len(w))] = f"new{step}"
    w = prose(rng, 120).split()
    texts += [" ".join([*w[:110], *(f"t{i}x{j}" for j in range(i % 14))]) for i in range(90)]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    for k, percent in ((3, 90), (5, 80)):
        assert joined(frame, k, percent) == plain_components(texts, k, percent)
    kept = {r.doc_id for r in jaccard.representatives(frame).collect()}
    assert kept == {c for _, c in plain_components(texts, 5, 80).values()}


def test_null_ids_and_ids_with_two_texts(spark):
    """Rows without an id are linked, stay where no other stands for them, and one id may have two texts."""
    rng = random.Random(33)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    data = [(1, a), (2, near(a, "x")), (2, b), (None, c), (None, near(c, "y")), (None, d), (4, near(d, "z")), (5, ""), (5, e), (None, None), (None, e)]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in data], "doc_id long, text string, tid int, key int").repartition(3)
    kept = jaccard.representatives(docs)
    said = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(said) == len(set(said)) == 7
    assert {x for x in said if x[1] not in (c, near(c, "y"))} == {(1, a), (2, b), (4, near(d, "z")), (5, ""), (5, e), (None, None)}
    both = spark.createDataFrame([(None, a), (None, near(a, "x")), (3, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.joined(both).collect()} == {(None, None), (3, 3)} and jaccard.representatives(both, 3, 90).count() == 2
    low_link = spark.createDataFrame([(None, a), (6, near(a, "x")), (7, near(a, "y"))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.joined(low_link).collect()} == {6}


def test_repeated_strings_without_ids(spark):
    rng = random.Random(34)
    texts = [prose(rng, 40) + prose(random.Random(1), 150) + prose(rng, n) for n in (30, 50)]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(frame).collect())
    assert got == sorted(plain_removal(texts).values()) and all(0 < x[1] < x[0] for x in got)


def test_roots_never_miss():
    """Two sets at the threshold share enough roots whatever elements differ and whichever the order calls frequent."""
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        for n in (9, 10, 15, 31, 64, 200, 1000):
            for trial in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                lost = (2 * n * (100 - percent) // (100 + percent)) // 2
                b = np.unique(np.concatenate([a[rng.permutation(n)[lost:]], rng.integers(0, 1 << 63, lost if trial % 2 else 0, dtype=np.uint64) * np.uint64(2)]))
                known = np.unique(np.concatenate([a[rng.random(len(a)) < 0.5], b[rng.random(len(b)) < 0.3]])) if trial % 3 else a[:0]
                how = jaccard.Roots(percent, known, rng.integers(5, 9, len(known)))
                both = len(np.intersect1d(a, b))
                assert 100 * both < percent * (len(a) + len(b) - both) or len(np.intersect1d(how.of(a), how.of(b))) >= jaccard.least_shared(min(len(a), len(b))), (percent, n)


def test_sketches_rule_out_long_sets_and_no_link(spark):
    """Long sets that share a fifth fill a bitmap of 2048 bits: the sketches tell them apart, and lose no pair at the threshold."""
    rng = np.random.default_rng(12)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    rows, pairs, want = [], [], set()

    def put(*sets):
        for h in map(np.unique, sets):
            rows.append((len(rows), len(h), bytearray(jaccard.sketch(h).tobytes()), bytearray(h.tobytes())))
        pairs.append((len(rows) - 2, len(rows) - 1))
        return pairs[-1]

    for n in (3, 40, 1000, 6000, 40_000):
        base = draw(n)
        for lost in (0, n // 20, n // 9, n // 5):
            a, b = base, np.concatenate([base[lost:], draw(n // 50)])
            at = put(a, b)
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                want.add(at)
    for _ in range(40):
        both = draw(1000)
        put(np.concatenate([both, draw(4000)]), np.concatenate([both, draw(4200)]))
    sets = spark.createDataFrame(rows, "key long, n long, sketch binary, hashes binary")
    frame = spark.createDataFrame(pairs, "a long, b long")
    left = {tuple(r) for r in jaccard.near(frame, sets, 80).collect()}
    assert want <= left and len(want) >= 12 and not any(a >= 40 for a, _ in left)
    assert {tuple(r) for r in jaccard.linked(frame, sets, 80).collect()} == want


def test_join_leaves_no_sets_behind(spark, docs, tmp_path, monkeypatch):
    """Tables of roots and sets, the largest that the join writes, are gone before its result is made."""
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    found = jaccard.representatives(docs)
    names = [p.name for p in tmp_path.iterdir()]
    assert not [x for x in names if x.startswith(("jaccard-sets", "jaccard-under", "jaccard-held", "jaccard-searched", "tree-"))]
    assert sum(x.startswith("jaccard-docs") for x in names) == 1 and 0 < found.count() < docs.count()


def test_spanning_links_connect_what_is_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(80)[: 76 + i % 4]], rng.integers(0, 1 << 62, i % 30, dtype=np.uint64)])) for i in range(60)]
    key, label = np.arange(60) * 7 - 100, np.arange(60) % 11
    for split in (0, 25):
        sides = [(i, j) for i in range(60) for j in range(60) if (i < j and not split) or (i < split <= j)]
        need = [(i, j) for i, j in sides if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
        told = jaccard.spanning_links(key, label, sets, split, 90)
        assert {tuple(sorted(x)) for x in told} <= {(int(key[i]), int(key[j])) for i, j in need}

        def parts(links):
            part = label.copy()
            for i, j in links:
                part[part == part[j]] = part[i]
            return {frozenset(np.flatnonzero(part == p).tolist()) for p in part}

        back = {int(k): i for i, k in enumerate(key)}
        assert parts(need) == parts([(back[a], back[b]) for a, b in told]) and len(told) < 11


def test_company_keeps_whoever_may_be_linked(spark, monkeypatch):
    """Rows of a root with a size within the threshold stay, hot roots and roots in several tasks whole."""
    rng = random.Random(5)
    rows = [(rng.randrange(60), k, rng.choice([20, 21, 30, 33, 60, 66, 90, 400])) for k in range(300)]
    rows += rows[:20] + [(999, 1000 + i, 10 + 40 * i) for i in range(30)]
    frame = spark.createDataFrame(rows, "root long, key long, n long").repartition(5)
    near = {r for r in rows if any(o[0] == r[0] and o is not r and 10 * min(o[2], r[2]) >= 9 * max(o[2], r[2]) for o in rows)}
    got = {tuple(r) for r in jaccard.company(frame, 90).collect()}
    want = {r for r in near if sum(o[1] == r[1] for o in near) >= jaccard.least_shared(-(-r[2] * 90 // 100))}
    assert want <= got and got - want <= set(rows[:20]) and not any(r[0] == 999 and r[2] < 300 for r in got)  # a row that stands there twice may stay


def test_company_of_common_and_large_roots(spark, monkeypatch):
    """Rows of a common root, or of one with more rows than a task compares, all stay, each once."""
    monkeypatch.setattr(jaccard, "WHOLE", 20)
    rows = [(7, i, 10 + 40 * i) for i in range(400)] + [(8, 1000 + i, 50) for i in range(3)] + [(9, 2000, 10), (9, 2001, 500)]
    common = [(5, 2000, 10), (5, 2001, 500), (5, 2001, 500)]
    frame = lambda x: spark.createDataFrame(x, "root long, key long, n long").repartition(3)
    monkeypatch.setattr(jaccard, "least_shared", lambda n: F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = [tuple(r) for r in jaccard.company(frame(rows * 2), 90, frame(common)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == {r for r in rows if r[0] in (7, 8)} | set(common)


def test_trees_of_large_roots(spark, monkeypatch):
    """Near copies of which few are linked with one another: leaves of a few sets, all paired through the trees."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "LEAF_SHINGLES", 1500)
    rng = random.Random(77)
    w = prose(rng, 150).split()
    texts = []
    for i in range(90):
        x = list(w)
        for at in rng.sample(range(0, 150, 15), rng.randint(1, 4)):
            x[at] = f"e{rng.randrange(3)}"
        texts.append(" ".join(x[: 150 - i % 5]))
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = plain_components(texts, 3, 90)
    assert joined(frame, 3, 90) == want and 3 < len({c for _, c in want.values()}) < 80
    assert joined(frame.unionAll(frame), 3, 90) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, 500 + i) for i in range(50)] + [(-3, -9), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == root.keys()
    groups = defaultdict(set)
    for n in root:
        groups[find(n)].add(got[n])
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_learns_from_some_and_finds_the_rest(spark, docs, empty):
    rng = random.Random(17)
    bad = ["vilewort", "grumbleslug", "nastiness", "vilefolk"]
    data, labels = [], []
    for i in range(700):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        data.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame(rows_of(data), SCHEMA)
    field = toxicity.trained(frame, spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity.scored(frame, field).withColumn("held", toxicity.held_out()).collect()}
    assert all(out[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    held = [(out[i].score >= 0.5, t == 1) for i, _, t in labels if out[i].held]
    assert len(held) > 90 and sum(a == b for a, b in held) / len(held) > 0.97
    text = data[0].encode()
    spans = {text[s.start : s.end].decode().strip(".,") for s in out[0].spans if s.p > 0.5}
    assert spans and spans <= set(bad)
    some = toxicity.scored(docs, field).collect()
    assert len(some) == docs.count() and all(0 <= r.score <= 1 for r in some)
    nothing = toxicity.trained(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(empty, nothing).count() == 0 and {r.predicted for r in toxicity.scored(docs, nothing).select((F.col("score") >= 0.5).alias("predicted")).collect()} == {False}


def test_toxicity_labels_that_differ(spark):
    """Of several labels the toxic one counts, whatever their order; capitals from À to Þ are lowered in place."""
    rng = random.Random(19)
    data = [prose(rng, 30) + (" vilewort vilewort" if i % 4 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(rows_of(data), SCHEMA)
    sure = [(i, int(i % 4 == 0)) for i in range(300)]
    both = [*[(i, 0) for i in range(0, 300, 4)], *sure]
    fields = [toxicity.trained(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (sure, both, both[::-1])]
    assert len(fields[0].keys) and all((f.keys == fields[0].keys).all() and np.allclose(f.weights, fields[0].weights) for f in fields[1:])
    text = "ÀÉÞ×ß straße ÄÖÜ 日本 É"
    assert toxicity.lower_latin(text.encode()).decode() == "àéþ×ß straße äöü 日本 é" and toxicity.lower_latin(b"") == b""


def test_marginals_are_those_of_the_whole_chain():
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0), -2.0, 0.3, -0.4, 1.1)
    places, emitted, n = np.array([1, 2, 6]), np.array([2.5, 1.0, 3.0]), 9
    gain = np.zeros(n)
    gain[places] = emitted
    total, hit = 0.0, np.zeros(n)
    for path in range(1 << n):
        s = [path >> i & 1 for i in range(n)]
        x, before = 0.0, 0
        for i, y in enumerate(s):
            x += (gain[i] - 2.0) * y + (0.3 if (before, y) == (0, 1) else -0.4 if (before, y) == (1, 0) else 1.1 if y else 0.0)
            before = y
        p = np.exp(x)
        total += p
        hit += p * np.array(s)
    assert np.allclose(field.marginals(places, emitted, n), (hit / total)[places], atol=1e-9)


def test_field_gradient_is_that_of_the_likelihood():
    """Central differences of the log-likelihood by enumeration, on short segments with padding."""
    rng = np.random.default_rng(5)
    keys, x = 3, np.full((4, toxicity.WINDOW, toxicity.features_count()), 3, np.int32)
    x[:, :5, 0] = rng.integers(0, 4, (4, 5))
    real = np.zeros((4, toxicity.WINDOW), bool)
    real[:, :5] = True
    real[3, 4] = False
    tags = (rng.random((4, toxicity.WINDOW)) < 0.4) * real.astype(float)
    params = rng.normal(size=keys + 4)

    def value(p):
        w, (bias, enter, leave, stay), out = np.append(p[:keys], 0), p[keys:], 0.0
        for i in range(4):
            n = int(real[i].sum())
            emit = w[x[i, :n]].sum(1) + bias

            def score(s):
                before, total = 0, 0.0
                for k, y in enumerate(s):
                    total += emit[k] * y + (enter if (before, y) == (0, 1) else leave if (before, y) == (1, 0) else stay if y else 0.0)
                    before = y
                return total

            out += score(tags[i, :n].astype(int)) - np.log(sum(np.exp(score([m >> k & 1 for k in range(n)])) for m in range(1 << n)))
        return out / 4

    numeric = [(value(params + e) - value(params - e)) / 2e-5 for e in 1e-5 * np.eye(keys + 4)]
    assert np.allclose(toxicity._likelihood(params, x, tags, real, keys), numeric, atol=1e-6)


URLS = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q#f", "ftp://b.net/es/y", "http://b.net/fr", "http://b.net/fr/z", "//no.scheme/en", None, "", "http://x.com", "http://x.com/?a", "https://example.com/de/", "http://notexample.com/en/", "http://com/", "x://[::1]:8/p"]


def plain_rule(host, path):
    best = None
    for h, p, v in urls.BASE_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_urls(spark):
    rng = random.Random(2)
    many = URLS + [f"http://{rng.choice(['spam', 'ok', 'www'])}.{rng.choice(['example.com', 'b.net', 'c.org'])}/{rng.choice(['en', 'es', 'de'])}/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(many)], "page_id long, url string, tokens int")
    rows = {r.page_id: r for r in urls.judged(pages).collect()}
    assert len(rows) == len(many)
    for i, u in enumerate(many):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule = plain_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule[0]), u
        assert rows[i].verdict == rule[1] if rule else rows[i].verdict in ("allow", "block")
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_mined(rows, support, confidence, groups=1):
    """All token sets of (tokens, label, group) rows by enumeration; the rules as {(tokens, label): confidence}."""
    count, hit = defaultdict(int), defaultdict(int)
    for tokens, label, group in rows:
        for n in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), n):
                for g in ("*", group):
                    count[part, g] += 1
                    hit[part, label, g] += 1
    good = {(p, lab): k / count[p, "*"] for (p, lab, g), k in hit.items() if g == "*" and k >= support * len(rows) and k >= confidence * count[p, "*"]}
    all_groups = {g for _, _, g in rows}
    good = {r: c for r, c in good.items() if groups == 1 or sum(count[r[0], g] > 0 and hit[(*r, g)] >= confidence * count[r[0], g] for g in all_groups) >= groups}
    return {r: c for r, c in good.items() if not any(o != r and o[1] == r[1] and set(o[0]) < set(r[0]) for o in good)}


def test_url_rules_are_those_of_enumeration(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        x = [t for t in "abcdef" if rng.random() < 0.45]
        bad = ("a" in x and "b" in x) or "f" in x and rng.random() < 0.97
        rows.append((x, "block" if bad else "allow", rng.choice("uvw") if "c" in x else "u"))
    frame = spark.createDataFrame(rows, "tokens array<string>, label string, group string")
    for groups in (1, 2, 3):
        found = {(tuple(r["items"]), r.label): r.confidence for r in urls.mined_rules(frame, 0.03, 0.9, groups).collect()}
        want = plain_mined(rows, 0.03, 0.9, groups)
        assert found.keys() == want.keys() and all(abs(found[r] - want[r]) < 1e-9 for r in want) and len(want) > 0
    assert urls.mined_rules(frame.limit(0), 0.03, 0.9).count() == 0


def test_url_verdicts_with_and_without_labels(spark):
    """Unlabelled paths of a blocked domain stay allowed; given labels decide, ties go to the rule of the lowest id."""
    hosts = [f"http://h{i}.net/{p}/x" for i in range(12) for p in ("es", "fr", "en", "de")] + [f"http://h{i}.com/en/x" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    said = {r.page_id: (r.rule, r.verdict) for r in urls.judged(pages).collect()}
    assert all(said[i] == (("net/es/", "block") if "/es/" in u else ("net/fr/", "block") if "/fr/" in u else ("com/", "allow") if ".com" in u else (None, "allow")) for i, u in enumerate(hosts))
    labels = spark.createDataFrame([(i, "block" if "/de/" in u else "allow") for i, u in enumerate(hosts) if "/fr/" not in u], "page_id long, label string")
    told = {r.page_id: (r.rule, r.verdict) for r in urls.judged(pages, labels).collect()}
    assert all(told[i][1] == "block" for i, u in enumerate(hosts) if "/de/" in u) and all(told[i][1] == "allow" for i, u in enumerate(hosts) if "net/en/" in u)
    tie = spark.createDataFrame([(7, ["a"], "block", 0.9, 0.5), (5, ["b"], "allow", 0.9, 0.5)], "rule_id long, items array<string>, label string, confidence double, support double")
    asked = spark.createDataFrame([(1, ["a", "b"])], "page_id long, tokens array<string>")
    assert urls.verdicts(asked, tie, "none").first().mined == "allow"


def test_url_rules_match_by_index(spark):
    pages = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "c", "a"]), (4, [])], "page_id long, tokens array<string>")
    rules = spark.createDataFrame([(10, ["a", "b"], "block", 0.9, 0.5), (11, ["c"], "allow", 0.95, 0.1)], "rule_id long, items array<string>, label string, confidence double, support double")
    assert {r.page_id: r.mined for r in urls.verdicts(pages, rules, "none").collect()} == {1: "block", 2: "none", 3: "allow", 4: "none"}
    labelled = spark.createDataFrame([(["x", "y"], "block")] * 30 + [(["x"], "allow")] * 30 + [(["z"], "allow")] * 20, "tokens array<string>, label string")
    found = {(tuple(r["items"]), r.label) for r in urls.mined_rules(labelled, 0.05, 0.9).collect()}
    assert found == {(("y",), "block"), (("z",), "allow")}


def test_fixed_paths_of_many_words_are_one_item(spark):
    """Forty words that always come together are mined as one; words that come together nearly always stay apart."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    long = "/".join(words)
    hosts = [f"http://a{i}.org/{long}/{i}" for i in range(30)] + [f"http://b{i}.org/x/{i}" for i in range(270)]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    parts = urls.with_parts(pages).withColumn("tokens", urls.tokens()).withColumn("label", F.when(F.col("page_id") < 30, "block").otherwise("allow"))
    found = {(tuple(r["items"]), r.label) for r in urls.mined_rules(parts, 0.05, 0.9).collect()}
    assert (("p=" + min(words),), "block") in found and not any(len(items) > 1 for items, label in found if label == "block")
    assert {r.page_id for r in urls.judged(pages, parts.select("page_id", "label"), 0.05).where("verdict = 'block'").collect()} == set(range(30))
    assert urls.judged(pages).where("verdict = 'block'").count() == 0


def test_a_rule_needs_a_share_of_the_rows_or_enough_of_them(spark):
    rows = spark.createDataFrame([(["x"], "block")] * 12 + [(["z"], "allow")] * 988, "tokens array<string>, label string")
    found = lambda **how: {r.label for r in urls.mined_rules(rows, 0.05, 0.9, **how).collect()}
    assert found() == {"allow"} and found(enough=12) == {"allow", "block"} and found(enough=13) == {"allow"}


def test_rules_of_one_half_judge_the_other(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.{d}/{p}/x") for i, (d, p) in enumerate((d, p) for _ in range(40) for d in ("net", "com") for p in ("es", "fr", "en"))], "page_id long, url string")
    got = {(r.label, r.mined): r.pages for r in urls.held_out_counts(pages).collect()}
    assert got.keys() == {("block", "block"), ("allow", "allow")}
