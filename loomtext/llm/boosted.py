"""Quality classifier: gradient-boosted trees on histograms of document statistics, traversed as flat arrays.

Statistics of whole texts are computed in Arrow tasks, many texts at once. Training rows are binned at quantiles; each tree is
grown level by level from histograms of first and second derivatives by node, statistic and bin. All trees become
three arrays (statistic and threshold of every inner node, value of every leaf, in heap order), which travel with the
tasks; scoring walks all rows of a batch down all trees with one array operation a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import own_id, written
from loomtext.llm.textnum import LOWER, Words, byte_hasher, shingles, text_slices

#: What each column of statistics() is.
STATISTICS = (
    "log_words", "log_bytes", "mean_word", "longest_word", "upper_share", "digit_share", "symbols_a_word", "marks_a_word",
    "stops_a_word", "other_share", "blank_share", "log_lines", "words_a_line", "repeated_lines", "distinct_words", "top_word", "same_as_before",
    "repeated_threes", "repeated_eights", "short_words", "capital_words",
)
_KIND = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]) | (np.arange(256) >= 128),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}=\\^~_@", np.uint8)),
    "mark": np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8)),
    "stop": np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8)),
    "other": np.arange(256) >= 128,
    "blank": np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8)),
}


def _repeats(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: how many keys stand in it a second time or later, and how often its most frequent key stands."""
    if not len(keys):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    first = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))
    runs = np.diff(np.append(np.flatnonzero(first), len(k)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[first], runs)
    return np.bincount(t[~first], minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row for each text with its STATISTICS; a text without words has zeros but for its bytes and blanks."""
    n = len(texts)
    words = Words(texts)
    buf, start, end, of = words.buf, words.start, words.end, words.text
    sums = {k: np.append(0, np.cumsum(is_[buf])) for k, is_ in _KIND.items()}
    count = {k: (s[words.text_end] - s[words.text_start]).astype(float) for k, s in sums.items()}
    n_bytes = (words.text_end - words.text_start).astype(float)
    n_words = words.n_words.astype(float)
    length = end - start
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    per_word = lambda x: np.bincount(of, x, minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of, length)
    lower = byte_hasher(LOWER[buf]).of(start, end)
    again, top = _repeats(lower, of, n)
    before = np.append(False, (lower[1:] == lower[:-1]) & (of[1:] == of[:-1])) if len(lower) else np.zeros(0, bool)
    grams = {}
    for k in (3, 8):
        keys, owner, _ = shingles(lower, of, words.n_words, words.first_word, k)
        grams[k] = share(_repeats(keys, owner, n)[0], np.bincount(owner, minlength=n))

    ends = np.union1d(np.flatnonzero(buf == 10), words.text_end)  # a line ends at a break or with its text
    begins = np.append(0, ends[:-1] + 1)
    line_text = np.searchsorted(words.text_end, ends)
    inside = np.searchsorted(start, ends) > np.searchsorted(start, begins)  # lines with a word
    line_again, _ = _repeats(byte_hasher(buf).of(begins[inside], ends[inside]), line_text[inside], n)
    n_lines = np.bincount(line_text[inside], minlength=n).astype(float)
    capital = _KIND["upper"][buf[start]] & (sums["upper"][end] - sums["upper"][start] == length) & (length > 1) if len(start) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(n_words), np.log1p(n_bytes), share(per_word(length), n_words), longest, share(count["upper"], count["letter"]), share(count["digit"], n_bytes),
        share(count["symbol"], n_words), share(count["mark"], n_words), share(count["stop"], n_words), share(count["other"], n_bytes), share(count["blank"], n_bytes),
        np.log1p(n_lines), share(n_words, n_lines), share(line_again, n_lines), share(n_words - again, n_words), share(top, n_words), share(per_word(before), n_words),
        grams[3], grams[8], share(per_word(length < 3), n_words), share(per_word(capital), n_words),
    ])


@dataclass
class Forest:
    """Trees of one depth in heap order: node i has the children 2 i + 1 (at most the threshold) and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees are walked at once, a level at a time."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        out = np.empty(len(x))
        offset = np.arange(trees) * inner
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.zeros((len(part), trees), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                at = node + offset
                node = 2 * node + 1 + (part[row, feature[at]] > threshold[at])
            out[a : a + 4096] = self.base + self.value[np.arange(trees)[None], node - inner].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between values of the column: at its quantiles, or between all values where they are few."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
    return (values[1:] + values[:-1]) / 2


def fitted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Forest:
    """Boosting of the logistic loss. penalty: added to second derivatives; least: their sum that a child must have."""
    inner, leaves = 2**depth - 1, 2**depth
    n, width = x.shape
    rate_of_ones = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    cuts = [_cuts(x[:, f], bins) for f in range(width)] if n else []
    if not n or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    per = max(len(c) for c in cuts) + 1
    cell = binned + np.arange(width) * per
    usable = np.zeros((width, per), bool)
    for f, c in enumerate(cuts):
        usable[f, : len(c)] = True
    out = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    margin = np.full(n, base)
    gain_of = lambda g, h: g * g / (h + penalty)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first, second = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, begin = 2**level, 2**level - 1
            place = ((node - begin)[:, None] * (width * per) + cell).ravel()
            hist = [np.bincount(place, np.repeat(d, width), nodes * width * per).reshape(nodes, width, per) for d in (first, second)]
            g, h = (x_.sum(axis=2)[:, :1, None] for x_ in hist)
            gl, hl = (x_.cumsum(axis=2) for x_ in hist)
            gr, hr = g - gl, h - hl
            gain = np.where(usable & (hl >= least) & (hr >= least), gain_of(gl, hl) + gain_of(gr, hr) - gain_of(g, h), 0.0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):
                f, b = divmod(int(best[i]), per)
                out.feature[t, begin + i], out.threshold[t, begin + i] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        out.value[t] = rate * np.bincount(leaf, first, leaves) / (np.bincount(leaf, second, leaves) + penalty)
        margin += out.value[t, leaf]
    return out


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _with_statistics(docs: DataFrame, more: tuple[str, ...]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in more), pa.array(list(statistics(texts)), pa.list_(pa.float64()))], [*more, "x"])

    return docs.select(*more, "text").mapInArrow(scan, "".join(f"{c} {kinds[c]}, " for c in more) + "x array<double>")


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, **how) -> Forest:
    """A forest from at most most_labelled labelled documents, those of the least hash of doc_id and never held-out ones.

    Labels with a null are not used; of several labels of one document the lowest quality counts, and repeated rows of a document
    count once for each text. Statistics of the sample reach the driver, no text: of at most 2 x most_labelled texts. Without
    labels, or with one kind only, every document has the same score.
    """
    some = labels.select("doc_id", "quality").dropna().where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    some = written(some, "quality-labels")
    sample = own_id(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.min("quality").alias("quality"))
    rows = _with_statistics(sample, ("doc_id", "h", "quality")).orderBy("doc_id", "h").limit(2 * most_labelled).toPandas()
    x = np.array(rows["x"].to_list(), float).reshape(len(rows), len(STATISTICS))
    return fitted(x, (rows["quality"].to_numpy() == 1).astype(float), **how)


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score, from 0 to 1, of every document.

    A null text counts as an empty one, whose statistics are zeros, and has their score. Repeated rows each give a row; columns
    other than doc_id and text are not looked at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(forest.score(statistics(texts)))], ["doc_id", "score"])

    return own_id(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, "doc_id long, score double")
