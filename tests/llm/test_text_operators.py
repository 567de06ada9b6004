"""LM scores, personal data, quality rules, decontamination, licenses and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, licenses, lm, packing, pii, quality
from loomtext.llm.queries import vocabulary_path
from tests.llm.conftest import SCHEMA, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_lm_scores(docs, texts, spark, empty):
    said = [WORD.findall(low(t)) for t in texts]
    one, two = Counter(w for s in said for w in s), Counter(p for s in said for p in zip(s, s[1:], strict=False))
    total = sum(map(len, said))
    expected = {}
    for i, s in enumerate(said):
        own, pairs, micro, hits = Counter(s), Counter(zip(s, s[1:], strict=False)), 0, 0
        for k, w in enumerate(s):
            p = max(one[w] - own[w], 0.5) / max(total - len(s), 1)
            if k:
                both = two[s[k - 1], w] - pairs[s[k - 1], w]
                p, hits = (both / (one[s[k - 1]] - own[s[k - 1]]), hits + 1) if both > 0 else (0.4 * p, hits)
            micro += round(math.log(p) * 1e6)
        expected[i] = (len(s), hits, micro)
    got = {r.doc_id: (r.n_words, r.n_hits, r.log_micro) for r in lm.scored(docs).collect()}
    assert got.keys() == expected.keys()
    for i, (n, hits, micro) in expected.items():
        assert got[i][:2] == (n, hits) and abs(got[i][2] - micro) <= n
    assert lm.scored(empty).count() == 0
    assert {r.n_words for r in lm.scored(docs.where("doc_id < 3")).collect()} == {0}


def test_lm_scores_of_order_three(docs, texts):
    """Two backoff steps, against counts kept one by one."""
    said = [WORD.findall(low(t)) for t in texts]
    grams = [[Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in said] for n in (1, 2, 3)]
    whole = [sum(g, Counter()) for g in grams]
    total, expected = sum(map(len, said)), {}
    for i, s in enumerate(said):
        others = lambda g, i=i: whole[len(g) - 1][g] - grams[len(g) - 1][i][g]

        def p(g, i=i, s=s, others=others):
            if len(g) == 1:
                return max(others(g), 0.5) / max(total - len(s), 1)
            return others(g) / others(g[:-1]) if others(g) > 0 else 0.4 * p(g[1:])

        each = [tuple(s[max(0, k - 2) : k + 1]) for k in range(len(s))]
        expected[i] = (len(s), sum(len(g) == 3 and others(g) > 0 for g in each), sum(round(math.log(p(g)) * 1e6) for g in each))
    got = {r.doc_id: (r.n_words, r.n_hits, r.log_micro) for r in lm.scored(docs, order=3).collect()}
    assert got.keys() == expected.keys() and any(hits for _, hits, _ in expected.values())
    for i, (n, hits, micro) in expected.items():
        assert got[i][:2] == (n, hits) and abs(got[i][2] - micro) <= n


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        odd = sum(int(x) for x in d[-1::-2]) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])
        if 13 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-_ 0123456789()é\n", max_size=60) | st.from_regex(r"(a@b\.c|1\.22\.256\.4|4[ -]?539 1488 0343 6467|\+1 \(555\) 123-4567|[ab.@]{3}){1,4}", fullmatch=True))
def test_base_spans_are_the_patterns(text):
    assert [s[:3] for s in pii.base_spans(text)] == plain_base(text)


def test_added_spans_need_evidence():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("my iban is GB82 WEST 1234 5698 7654 32 thanks") == ["iban"]
    assert kinds("code GB82 WEST 1234 5698 7654 33 thanks") == []
    assert kinds("ssn: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188aa"') == ["secret"]
    assert pii.spans_of("a" * 200_000 + "@" * 1000 + "1" * 200_000) == []


def test_secrets_of_any_length_and_with_padding():
    rng = random.Random(19)
    key = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(500)) + "a1"
    for secret in ("c2VjcmV0a2V5MTIzNDU2Nzg5MTIzNA==", "c2VjcmV0a2V5MTIzNDU2Nzg5MTIzNDU=", key[:128], key[:129], key, key + "=="):
        for text in (f"token: {secret} end", f"api_key={secret}", f'password "{secret}"'):
            at = text.index(secret)
            assert [s[:3] for s in pii.spans_of(text)] == [("secret", at, at + len(secret))], text
            assert pii._scrubbed(text) == text.replace(secret, "<SECRET>")
    assert pii.spans_of("my_service_token_name_v2=on") == [] and pii.spans_of(key) == []
    assert pii.spans_of("token " + "Ab1+" * 5 + "=" * 200_000 + "x") == []


def test_pii_query_and_redaction(spark, empty):
    data = [(1, "write to a.b@c.org or +44 20 7946 0958 é", "x"), (1, "write to a.b@c.org or +44 20 7946 0958 é", "x"), (2, None, "x"), (3, "", "x")]
    frame = spark.createDataFrame(data, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.digest(pii.found(frame)).collect()))
    base = "email:9:18,phone:22:38"
    assert got[0] == got[1] == (1, 1, 0, 0, 1, hashlib.sha256(base.encode()).hexdigest(), base)
    assert got[2][5] == got[3][5] == hashlib.sha256(b"").hexdigest()
    clean = {(r.doc_id, r.text, r.n_chars, r.spans) for r in pii.redacted(frame).collect()}
    assert clean == {(1, "write to <EMAIL> or <PHONE> é", 29, "x"), (2, None, None, "x"), (3, "", 0, "x")}
    assert pii.digest(pii.found(empty)).count() == 0


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_stats(docs, texts, empty, spark):
    rng = random.Random(3)
    part = prose(rng, 12)
    more = [part + " x " + part + " y " + prose(rng, 5) + " " + part, "a " * 50, "# $ & x|y <z>\nq\nq\n \n", "w " * 9, "abcdefgh " + prose(rng, 9000) + " " + part + " " + part]
    frame = spark.createDataFrame(rows_of(more), SCHEMA)
    for f, source in ((docs, texts), (frame, more)):
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(f, []).collect()}
        assert got == {i: plain_stats(t) for i, t in enumerate(source)}
    assert quality.judged(empty, []).count() == 0 and quality.filtered(empty, []).count() == 0
    assert quality.learnt_from(empty, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_quality_rules_are_learnt_and_take_effect(spark, docs):
    rng = random.Random(9)
    good = [prose(rng, rng.randint(40, 90)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(60)]
    frame = spark.createDataFrame(rows_of(good + bad), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learnt_from(frame, labels)
    assert rules
    kept = {r.doc_id for r in quality.filtered(frame, rules).collect()}
    assert kept == set(range(150))
    assert quality.filtered(docs, []).columns == docs.columns


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (20, 35, 50, 3)]
    edited = items[2].split()
    edited[49] = "other"
    texts = [prose(rng, 60) + " " + items[0].upper() + " " + prose(rng, 60), " ".join(edited), prose(rng, 200), items[1][: len(items[1]) // 2], None, "", "see " + items[3] + " now", items[0]]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.leaks(frame, bench).collect()}
    assert set(got) == {(0, 0), (1, 2), (6, 3), (7, 0)}
    assert got[0, 0] == (1.0, 60, 20) and got[7, 0] == (1.0, 0, 20) and 0.8 <= got[1, 2][0] < 1
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(frame, bench.where("false")).count() == 0


def test_leaks_are_dropped_by_id_and_text(spark):
    rng = random.Random(14)
    item, a, b = prose(rng, 30), prose(rng, 60), prose(rng, 60)
    frame = spark.createDataFrame([(None, a + " " + item), (None, a), (1, item), (1, b), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.without_leaks(frame, bench).collect()} == {(None, a), (1, b), (2, None)}


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    """Weights count the whole benchmark: many items share parts, and near copies stand around the threshold."""
    rng = random.Random(15)
    parts = [prose(rng, 12) for _ in range(6)]
    items = [" ".join([rng.choice(parts), prose(rng, 12), rng.choice(parts)]) for _ in range(40)]
    texts = []
    for item in items:
        for edits in (1, 2):
            w = item.split()
            for x in rng.sample(range(len(w)), edits):
                w[x] = f"new{x}"
            texts.append(prose(rng, 20) + " " + " ".join(w))
    frame = spark.createDataFrame(rows_of(texts), SCHEMA).coalesce(2)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in decontaminate.leaks(frame, bench, least=0.5).collect())
    one = found()
    monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", 11)
    assert len(one) > 20 and found() == one


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    flips = set(decontaminate.neighbours(decontaminate.RADIUS).tolist())
    assert len(flips) == 1 + 16 + 120
    x = rng.integers(0, 1 << 64, (300, decontaminate.WORDS), dtype=np.uint64)
    y = np.unpackbits(x.view(np.uint8), axis=1)
    for row in y:
        row[rng.permutation(256)[: decontaminate.RADIUS]] ^= 1
    y = np.packbits(y, axis=1).view(np.uint64)
    assert (np.bitwise_count(x ^ y).sum(axis=1) == decontaminate.RADIUS).all()
    apart = decontaminate.blocks_of(x) ^ decontaminate.blocks_of(y)
    assert all(any(int(b) in flips for b in row) for row in apart)
    other = decontaminate.blocks_of(x[:-1]) ^ decontaminate.blocks_of(x[1:])
    assert np.mean([any(int(b) in flips for b in row) for row in other]) < 0.1


def plain_leaks(texts, items, k, least):
    """Best similarity of each document and item over all windows of the item's size."""
    words = lambda t: WORD.findall(low(t or ""))
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    own = {i: grams(w, min(k, len(w))) for i, t in items if (w := words(t))}
    df = Counter(g for x in own.values() for g in set(x))
    weight = lambda g: round(1000 * math.log(1 + len(own) / df.get(g, 1)))
    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, x in items:
            n = len(words(x))
            theirs = Counter(own.get(i, []))
            for at in range(len(w) - n + 1 if n else 0):
                ours = Counter(grams(w[at : at + n], min(k, n)))
                if ours.keys() & theirs.keys():
                    s = sum((ours & theirs)[g] * weight(g) for g in ours) / sum(c * weight(g) for g, c in (ours | theirs).items())
                    if s >= least and s > out.get((d, i), (0, 0))[0]:
                        out[d, i] = (s, at)
    return out


def test_leaks_against_all_windows(spark):
    """Nothing is found that is not there, and of pairs around the threshold nine in ten at least; copies and ties always."""
    rng = random.Random(40)
    items = [(i, prose(rng, rng.choice([3, 12, 40, 80, 120]))) for i in range(24)] + [(50, None), (51, ""), (52, "one two")]
    texts = [None, "", "one two", items[3][1] + " x " + items[3][1]]
    for i, item in items[:24]:
        for edits in (0, 1, 1, 2, 2, 3):
            w = item.split()
            for x in rng.sample(range(len(w)), min(edits, len(w) - 1)):
                w[x] = f"new{x}"
            texts.append(prose(rng, rng.randint(0, 30)) + " " + " ".join(w) + " " + prose(rng, 20))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).withColumns({c: F.lit(1) for c in ("item_id", "similarity", "tid", "words")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.leaks(docs, bench).collect()}
    want = plain_leaks(texts, items, 5, 0.8)
    assert found.keys() <= want.keys() and len(want) > 50
    exact = {k for k, (s, _) in want.items() if s == 1}
    assert exact <= found.keys() and len(found) >= 0.9 * len(want) and len(found.keys() - exact) >= 0.9 * len(want.keys() - exact)
    assert all(abs(found[k][0] - want[k][0]) < 1e-9 and found[k][1] == want[k][1] for k in exact) and found[3, 3][1] == 0
    twice = decontaminate.leaks(docs.unionAll(docs), bench).count()
    assert twice == 2 * len(found)


def test_licenses(spark, docs, empty):
    rng = random.Random(8)
    mit = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 100)["MIT"]
    cut = mit.split()
    cut[3] = "gratis,"
    texts = [prose(rng, 300) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(rng, 100), prose(rng, 700) + " " + mit, "x " + " ".join(cut) + " y", "Released under the MIT License.", prose(rng, 50), None, "", "Licensed under"]
    texts += ["…Licensed under the Apache License, Version 2.0 and more…", "it is «licensed under the apache license version 2.0.»", "(Released under the MIT License)", prose(rng, 4000) + " " + dict(licenses.TEMPLATES)["ISC"] + prose(rng, 9000)]
    texts += ["Released under the MIT License. " + prose(rng, 40) + " released under the MIT license."]  # a tie: the first window
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    expected = set()
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", low(t))] for i in range(len(w) - 4)}
    for i, t in enumerate(texts):
        for j, (_, template) in enumerate(licenses.TEMPLATES):
            if len(grams(t or "") & grams(template)) >= 0.8 * len(grams(template)):
                expected.add((i, j))
    got = licenses.scanned(frame).collect()
    assert {(r.doc_id, r.template) for r in got} == expected and len(got) == len(expected)
    assert {r.start_word for r in got if r.doc_id in (3, 10, 12)} == {0} and {8, 9, 10, 11, 12} <= {i for i, _ in expected}
    twice = licenses.scanned(frame.unionAll(frame)).collect()
    assert sorted(map(tuple, twice)) == sorted([*map(tuple, got), *map(tuple, got)])
    assert licenses.scanned(docs).count() == 0 and licenses.scanned(empty).count() == 0 and licenses.scanned(frame, ()).count() == 0


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    rows = packing.pack_documents(docs, vocabulary_path()).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert packing.pack_documents(empty, vocabulary_path()).count() == 0


def test_packing_exchanges_between_partitions(spark):
    rng = random.Random(2)
    lengths = [rng.choice([100, 300, 500, 513, 700, 1024]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = packing.packed(items, partition_items=256).collect()
    assert len(rows) == 3000 and len({r.item for r in rows}) == 3000
    import numpy as np

    _, _, fill = packing.best_fit(np.array(lengths), 1024)
    assert len({r.sequence_id for r in rows}) <= len(fill) * 1.02


@pytest.mark.parametrize("kinds, n, size, partition_items", [([25], 9000, 1024, 8192), ([291, 179, 179], 2000, 1024, 512), ([1], 900, 1000, 20), ([], 0, 1024, 8192)])
def test_packing_ends(spark, monkeypatch, kinds, n, size, partition_items):
    """One length only, a mix that no bound certifies, and partitions of less than a sequence."""
    import numpy as np

    rounds, rows_in = [], []

    def counted(df, name):
        assert len(rounds) < 12, "the rounds do not end"
        out = written(df, name)
        rounds.append(name)
        rows_in.append(out.count())
        return out

    written = packing.written
    monkeypatch.setattr(packing, "written", counted)
    rng = random.Random(2)
    lengths = [rng.choice(kinds) for _ in range(n)]
    rows = packing.packed(spark.createDataFrame(list(enumerate(lengths)), "item long, length long"), size, partition_items).collect()
    assert sorted(r.item for r in rows) == list(range(n))
    assert all(b < a for a, b in zip(rows_in, rows_in[1:], strict=False))
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, lengths[r.item]))
    for parts in full.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))] and sum(x for _, x in parts) <= size
    assert len(full) <= len(packing.best_fit(np.array(lengths, np.int64), size)[2]) * 1.02


def test_equal_lengths_are_certified():
    import numpy as np

    for n, least in ((19, 53), (25, 40), (27, 37), (1, 1024)):
        lengths = np.full(8192, n)
        assert packing.bins_bound(lengths, 1024) == -(-8192 // least) == len(packing.best_fit(lengths, 1024)[2])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_are_bounds(lengths):
    import numpy as np

    def least(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for i in range(len(bins)):
            if bins[i] + rest[0] <= 20 and bins[i] not in bins[:i]:
                best = min(best, least(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]]))
        return min(best, least(rest[1:], [*bins, rest[0]]))

    _, _, fill = packing.best_fit(np.array(lengths), 20)
    assert packing.bins_bound(np.array(lengths), 20) <= least(sorted(lengths, reverse=True), []) <= len(fill)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'stremvl 12\n\t.,é߀½", max_size=25), max_size=6))
def test_pretokens_give_the_tokenizer_ids(batch):
    from loomtext.llm.pretokens import encoder

    coder = encoder(vocabulary_path())
    assert [x.tolist() for x in coder.encode(batch)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


@pytest.mark.parametrize("text", ["I'm we've they're 'song", "  x", "a \n b", "'s's", "x''s", "日本 a's", " a b"])
def test_pretokens_examples(text):
    from loomtext.llm.pretokens import encoder

    coder = encoder(vocabulary_path())
    assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_recognised(spark):
    """Texts with the content of the vocabulary's added token, beside others, against an untouched tokenizer."""
    from tokenizers import Tokenizer

    from loomtext.llm.pretokens import encoder

    plain = Tokenizer.from_file(vocabulary_path())
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids
    texts = ["end of one <|endoftext|> start of next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "日本 <|endoftext|>", "<|endoftext|", "< |endoftext|>", "no mark at all", ""]
    assert 50256 in ids(texts[0]) and len(ids(texts[0])) == 8
    assert [x.tolist() for x in encoder(vocabulary_path()).encode(texts)] == [ids(t) for t in texts]
    long = "word " * 3000 + texts[0]
    rows = packing.pack_documents(spark.createDataFrame(rows_of([*texts, long]), SCHEMA), vocabulary_path()).collect()
    for i, t in enumerate([*texts, long]):
        own, said = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece), [*ids(t), 2]
        assert sum(r.length for r in own) == len(said)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in said[r.start : r.start + r.length])) for r in own]


def test_lm_hashes_travel_whole():
    rng = np.random.default_rng(4)
    for values in ([0], [7, 8, 9], [0, (1 << 64) - 1], rng.integers(0, 1 << 64, 5000, dtype=np.uint64)):
        key = np.unique(np.array(values, np.uint64))
        assert (lm.unpacked(lm.packed(key)) == key).all()
    assert len(lm.packed(np.arange(100, dtype=np.uint64))) == 9 + 99
