"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals become document scores.

Tokens are words; their features are the word, its first 4, 5, 6 and 8 bytes and its last 4 bytes. Labels say which
documents are toxic, not which words: a token is labelled toxic when it stands in a toxic document and has a feature
that toxic documents have far more often than others. On those tags the field is trained by gradient ascent on the
conditional likelihood with exact forward-backward sums, over a bounded sample of labelled documents.

Only tokens with a feature of the lexicon carry evidence. Between them a run of g other tokens is the g-th power of one
2 x 2 matrix, so forward-backward over a whole text costs a step for each token with evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import own_id, written
from loomtext.llm.textnum import LOWER, Words, as_long, byte_hasher, text_slices

PREFIXES, SUFFIX = (4, 5, 6, 8), 4
WINDOW = 24  # tokens of a training segment
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}*#$%&|<>-_=+~/", np.uint8))


def lower_latin(text: bytes) -> bytes:
    """UTF-8 text with the capitals from À to Þ in lower case; its length stays."""
    if b"\xc3" not in text:
        return text
    a = np.frombuffer(text, np.uint8).copy()
    at = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)) + 1
    a[at] += 0x20
    return a.tobytes()


def token_features(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of texts and six feature hashes for each. Punctuation around a word does not count."""
    words = Words([lower_latin(t) for t in texts], lower=True)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        start += _PUNCTUATION[words.buf[start]] & (end - start > 1) if len(start) else 0
        end -= _PUNCTUATION[words.buf[end - 1]] & (end - start > 1) if len(end) else 0
    hasher = byte_hasher(LOWER[words.buf])
    spans = [(start, end), *((start, np.minimum(start + n, end)) for n in PREFIXES), (np.maximum(end - SUFFIX, start), end)]
    return words, np.stack([hasher.of(a, b) ^ np.uint64(0x1F123BB5 * (i + 1)) for i, (a, b) in enumerate(spans)], axis=1)


@dataclass
class Field:
    """keys: sorted feature hashes; weights: of each for the toxic state; bias and moves of that state; calibration."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    enter: float
    leave: float
    stay: float
    scale: tuple[float, float, float] = (-3.0, 2.0, 2.0)

    def evidence(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens with a feature of the lexicon, and for each the sum of weights."""
        if not len(self.keys) or not len(features):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        has = self.keys[at] == features
        places = np.flatnonzero(has.any(axis=1))
        return places, np.where(has[places], self.weights[at[places]], 0.0).sum(axis=1)

    def marginals(self, places: np.ndarray, emitted: np.ndarray, n: int) -> np.ndarray:
        """Probability of the toxic state at each place, of a text of n tokens."""
        step = np.array([[1.0, np.exp(self.enter + self.bias)], [np.exp(self.leave), np.exp(self.stay + self.bias)]])
        values, vectors = np.linalg.eig(step)
        inverse = np.linalg.inv(vectors)

        def over(gap: int) -> np.ndarray:
            power = (vectors * (values / values.max()) ** gap) @ inverse
            return power.real / max(power.real.max(), 1e-300)

        gain = np.exp(np.clip(emitted, -30, 30))
        m = len(places)
        ahead, behind = np.zeros((m, 2)), np.ones((m, 2))
        f = np.array([1.0, 0.0])  # before the first token
        for k in range(m):
            f = f @ over(int(places[k] - (places[k - 1] if k else -1)))
            f = f * (1.0, gain[k])
            f = f / f.sum()
            ahead[k] = f
        b = over(int(n - 1 - places[-1])) @ np.ones(2)
        for k in range(m - 1, -1, -1):
            behind[k] = b / b.sum()
            if k:
                b = over(int(places[k] - places[k - 1])) @ (behind[k] * (1.0, gain[k]))
        both = ahead * behind
        return both[:, 1] / both.sum(axis=1)

    def score(self, marginals: np.ndarray) -> float:
        c0, c1, c2 = self.scale
        x = c0 + (c1 * np.log1p(marginals.sum()) + c2 * marginals.max() if len(marginals) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _likelihood(params: np.ndarray, x: np.ndarray, tags: np.ndarray, real: np.ndarray, n_keys: int) -> np.ndarray:
    """Gradient of the conditional log-likelihood of tagged segments, a segment's mean.

    x: for each token up to six lexicon indices (n_keys: none); real: which tokens exist.
    """
    weights = np.append(params[:n_keys], 0.0)
    bias, enter, leave, stay = params[n_keys:]
    emit = weights[x].sum(axis=2) + bias
    move = np.array([[0.0, enter], [leave, stay]])
    s, t = tags.shape
    a = np.zeros((t, s, 2))
    b = np.zeros((t, s, 2))
    first = np.stack([np.zeros(s), emit[:, 0] + enter], axis=1)
    a[0] = first
    for i in range(1, t):
        now = np.logaddexp(a[i - 1][:, :1] + move[0], a[i - 1][:, 1:] + move[1]) + np.stack([np.zeros(s), emit[:, i]], axis=1)
        a[i] = np.where(real[:, i : i + 1], now, a[i - 1])
    for i in range(t - 2, -1, -1):
        after = b[i + 1] + np.stack([np.zeros(s), emit[:, i + 1]], axis=1)
        now = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
        b[i] = np.where(real[:, i + 1 : i + 2], now, b[i + 1])
    total = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
    p = np.exp(a[:, :, 1] + b[:, :, 1] - total).T * real
    diff = (tags - p) * real
    grad = np.zeros(n_keys + 1)
    np.add.at(grad, x.ravel(), np.repeat(diff.ravel(), x.shape[2]))
    moves = np.zeros(3)
    y = tags.astype(bool)
    for i in range(t):
        before = np.zeros(s, bool) if i == 0 else y[:, i - 1]
        r = real[:, i]
        if i == 0:
            expect = (np.exp(first[:, 1] + b[0][:, 1] - total), np.zeros(s), np.zeros(s))
        else:
            after = b[i] + np.stack([np.zeros(s), emit[:, i]], axis=1)
            pair = lambda u, v: np.exp(a[i - 1][:, u] + move[u, v] + after[:, v] - total)  # noqa: B023, E731
            expect = (pair(0, 1), pair(1, 0), pair(1, 1))
        seen = (~before & y[:, i], before & ~y[:, i], before & y[:, i])
        moves += [float(((o - e) * r).sum()) for o, e in zip(seen, expect, strict=True)]
    return np.concatenate([grad[:n_keys], [diff.sum()], moves]) / s


def _fit(x: np.ndarray, tags: np.ndarray, real: np.ndarray, n_keys: int, rounds: int = 120) -> np.ndarray:
    """Adam with a small pull to 0."""
    params = np.concatenate([np.full(n_keys, 0.5), [-4.0, -0.5, 0.0, 0.5]])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, rounds + 1):
        g = _likelihood(params, x, tags, real, n_keys) - 1e-4 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return params


def _calibrated(values: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the labels on log1p(sum) and maximum of the marginals, by Newton steps."""
    x = np.column_stack([np.ones(len(values)), values])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        w = w + np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * w)
    return tuple(float(c) for c in w)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000) -> Field:
    """A field from at most most_labelled labelled documents (those of the least hash of doc_id, held-out ones never).

    What the driver trains on has a bound that follows from it: two features and three segments for each labelled
    document. Labels with a null are not used; of several labels of one document or one text the toxic one counts.
    Without toxic documents the lexicon is empty and every score the same.
    """
    most_keys, segments = 2 * most_labelled, 3 * most_labelled
    some = labels.select("doc_id", "toxic").dropna().where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = written(own_id(docs).join(F.broadcast(some), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).repartition(24), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                words, features = token_features(texts)
                toxic = batch.column("toxic").slice(a, b - a).to_numpy(zero_copy_only=False) == 1
                order = np.lexsort((features.T.ravel(), np.tile(words.text, features.shape[1])))
                key, of = features.T.ravel()[order], np.tile(words.text, features.shape[1])[order]
                once = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])) if len(key) else np.zeros(0, bool)
                key, back = np.unique(key[once], return_inverse=True)
                hit = toxic[of[once]]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(np.bincount(back, hit, len(key)).astype(np.int64)), pa.array(np.bincount(back, ~hit, len(key)).astype(np.int64))], ["key", "pos", "neg"])

    sizes = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = sizes["pos"] + 1.0, sizes["n"] - sizes["pos"] + 1.0
    ratio = F.log((F.col("pos") + 0.5) / pos) - F.log((F.col("neg") + 0.5) / neg)
    lexicon = (
        sample.select("toxic", "text").mapInArrow(count, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where("pos >= 3").withColumn("ratio", ratio).withColumn("z", F.col("ratio") / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
        .where("z >= 3 and ratio >= 1").orderBy(F.desc("z"), "key").limit(most_keys).toPandas()
    )
    lexicon["hash"] = lexicon["key"].to_numpy(np.int64).view(np.uint64)
    lexicon = lexicon.sort_values("hash")
    keys = lexicon["hash"].to_numpy(np.uint64)
    seed = ((lexicon["ratio"] >= 3) & (lexicon["z"] >= 4)).to_numpy(bool)
    if not len(keys) or not seed.any():
        return Field(keys[:0], np.zeros(0), -4.0, 0.0, 0.0, 0.0)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Non-overlapping segments with evidence, and the first of each document: lexicon indices of each token."""
        none = len(keys)
        for batch in batches:
            for a, _, texts in text_slices(batch.column("text")):
                words, features = token_features(texts)
                at = np.minimum(np.searchsorted(keys, features), none - 1)
                index = np.where(keys[at] == features, at, none).astype(np.int32)
                rows, toxic = [], []
                labels_in = batch.column("toxic").to_pylist()
                for j in range(len(texts)):
                    own = index[words.first_word[j] : words.first_word[j] + words.n_words[j]]
                    some = (own < none).any(axis=1)
                    for s in range(0, len(own), WINDOW):
                        if s == 0 or some[s : s + WINDOW].any():
                            rows.append(own[s : s + WINDOW].ravel().tolist())
                            toxic.append(labels_in[a + j])
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "x"])

    got = sample.select("toxic", "text").mapInArrow(segment, "toxic int, x array<int>").orderBy(F.xxhash64("x"), "x").limit(segments).toPandas()
    x = np.full((len(got), WINDOW, features_count()), len(keys), np.int32)
    real = np.zeros((len(got), WINDOW), bool)
    for i, row in enumerate(got["x"]):
        n = len(row) // features_count()
        x[i, :n] = np.asarray(row, np.int32).reshape(n, -1)
        real[i, :n] = True
    tags = (np.append(seed, False)[x].any(axis=2) & real & (got["toxic"].to_numpy() == 1)[:, None]).astype(float)
    params = _fit(x, tags, real, len(keys))
    field = Field(keys, params[: len(keys)], *(float(p) for p in params[len(keys) :]))
    p = F.transform("spans", lambda s: s["p"])
    found = _tagged(sample, field, ["toxic"]).select("toxic", F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("sum"), F.coalesce(F.array_max(p), F.lit(0.0)).alias("most")).toPandas()
    field.scale = _calibrated(np.column_stack([np.log1p(found["sum"]), found["most"]]), found["toxic"].to_numpy(float))
    return field


def features_count() -> int:
    return len(PREFIXES) + 2


SPANS = "array<struct<start:int,end:int,p:double>>"


def _tagged(docs: DataFrame, field: Field, more: list[str]) -> DataFrame:
    """doc_id, `more`, score, and the tokens of marginal 0.01 and up: bytes [start, end) in the text and p."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                words, features = token_features(texts)
                places, emitted = field.evidence(features)
                cut = np.searchsorted(places, np.append(words.first_word, len(words.start)))
                scores, spans = [], []
                for j in range(len(texts)):
                    own = slice(cut[j], cut[j + 1])
                    if cut[j] == cut[j + 1]:
                        scores.append(field.score(emitted[:0]))
                        spans.append([])
                        continue
                    p = field.marginals(places[own] - words.first_word[j], emitted[own], int(words.n_words[j]))
                    scores.append(field.score(p))
                    spans.append([{"start": int(words.start[i] - words.text_start[j]), "end": int(words.end[i] - words.text_start[j]), "p": float(q)} for i, q in zip(places[own], p, strict=True) if q >= 0.01])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in more), pa.array(scores), pa.array(spans, kind)], ["doc_id", *more, "score", "spans"])

    kinds = dict(docs.dtypes)
    columns = "".join(f"{c} {kinds[c]}, " for c in more)
    return docs.select("doc_id", *more, "text").mapInArrow(scan, f"doc_id long, {columns}score double, spans {SPANS}")


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score from 0 to 1, and the offending spans of every document.

    A null or empty text has no token and gets the score of a text without evidence. Repeated rows each give a row;
    columns other than doc_id and text are not looked at.
    """
    return _tagged(own_id(docs), field, [])
