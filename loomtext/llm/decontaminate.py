"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, weighted-shingle similarity.

A window of as many words as an item is fingerprinted by SimHash of 256 bits over its weighted shingles. Fingerprints are
cut into blocks of 16 bits. Two within the radius of 47 differ in at most 2 bits of some block, so an index that holds each
block of an item with all its neighbours of up to 2 bits finds every item whose fingerprint is near; a random
fingerprint meets an item there with a probability of 3 in 100. At a similarity of 0.8 fingerprints differ in 39 bits on
average, so the radius retrieves nine in ten pairs that just reach it and more of the others. Candidates are then compared
exactly: sum of weights in both over sum of weights in either, as multisets. Windows that share no shingle with any item have similarity 0, so fingerprints are made only around shared
shingles, and only of the sizes of items that have one of them; this loses nothing. Weights are those of the whole
benchmark, in however many blocks it is held.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import of_rows, own_id, text_id
from loomtext.llm.textnum import Words, as_long, mix, shingles, text_slices

WORDS = 4  # of a fingerprint, 64 bits each
BLOCKS = 16  # of a fingerprint, 16 bits each
RADIUS = 47
ITEMS_A_BLOCK, BYTES_A_BLOCK = 4_000, 8_000_000  # of the benchmark, held by each task at a time
RUN = 8_192  # shingles fingerprinted at a time


def _fingerprints(h: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of `size` shingles, a row of 64-bit values."""
    bits = np.unpackbits(np.stack([mix(h ^ np.uint64(0xABCDEF + 977 * i)) for i in range(WORDS)], axis=1).view(np.uint8).reshape(len(h), -1), axis=1)
    signed = (bits.astype(np.int32) * 2 - 1) * weight[:, None].astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64 * WORDS), np.int64), np.cumsum(signed, axis=0, dtype=np.int64)])
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1).view(np.uint64)


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """The BLOCKS blocks of each fingerprint."""
    return np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), BLOCKS)


def neighbours(radius: int) -> np.ndarray:
    """What to flip in a block to get all that some block of a fingerprint within the radius can be."""
    near = radius // BLOCKS
    return np.array([sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(16), n)], np.uint16)


class Index:
    """The items of a benchmark block: their shingles and weights, and blocks of fingerprints by item length."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, radius: int, common: tuple[np.ndarray, np.ndarray, int] | None = None) -> None:
        """common: sorted shingles that two or more items of the benchmark have, in how many, and the number of items
        with words; None if these items are the whole benchmark."""
        self.k, self.radius = k, radius
        words = Words([(t or "").encode() for _, t in items], lower=True)
        hashes = words.hashes()
        own = {}
        for j in range(len(items)):
            n = int(words.n_words[j])
            if n:
                own[j] = self._grams(hashes[words.first_word[j] : words.first_word[j] + n], min(k, n))
        self.ids = [items[j][0] for j in own]
        self.size = [int(words.n_words[j]) for j in own]
        self.known, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(g) for g in own.values())]), return_counts=True)
        self.common, times, total = common or (self.known[df > 1], df[df > 1], len(own))
        unit = lambda d: round(1000 * math.log(1 + total / d))
        kinds, back = np.unique(times, return_inverse=True)
        self.weights = np.array([unit(d) for d in kinds.tolist()], np.int64)[back]
        self.other = unit(1)  # of a shingle of one item, or of none
        self.counts = [Counter(g.tolist()) for g in own.values()]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        flips = neighbours(radius)
        for size in sorted(set(self.size)):
            at = np.array([i for i, s in enumerate(self.size) if s == size])
            prints = np.concatenate([_fingerprints(g, self.weight(g), len(g)) for g in (list(own.values())[i] for i in at)])
            tables = []
            for block in blocks_of(prints).T:
                value = (block[:, None] ^ flips).ravel()
                order = np.argsort(value, kind="stable")
                tables.append((value[order], (order // len(flips)).astype(np.int32)))
            self.by_size[size] = (at, prints, tables)
        sizes: dict[int, set[int]] = {}
        for g, n in zip(own.values(), self.size, strict=True):
            for x in g.tolist():
                sizes.setdefault(x, set()).add(n)
        self.sizes_of = [tuple(sizes[x]) for x in self.known.tolist()]
        self.short = sorted({s for s in self.size if s < k})
        self.longest = max(self.size, default=0)

    @staticmethod
    def _grams(words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        return shingles(words, np.zeros(n, np.int64), np.array([n]), np.array([0]), k)[0] ^ np.uint64(k)

    def weight(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, h), max(len(self.common) - 1, 0))
        return np.where(self.common[at] == h, self.weights[at], self.other) if len(self.common) else np.full(len(h), self.other)

    def similarity(self, item: int, window: np.ndarray, weight: np.ndarray) -> float:
        theirs, ours = self.counts[item], Counter(window.tolist())
        of = dict(zip(window.tolist(), weight.tolist(), strict=True))
        both = sum(of[x] * min(n, theirs.get(x, 0)) for x, n in ours.items())
        keys = list(theirs)
        total = sum(of[x] * n for x, n in ours.items()) + int(self.weight(np.array(keys, np.uint64)) @ np.array([theirs[x] for x in keys])) - both
        return both / total

    def matches(self, words: np.ndarray, sizes: set[int], least: float) -> dict[int, tuple[float, int, int]]:
        """Of one zone of words: for each item of these sizes found, similarity, first word and words of its best window."""
        best: dict[int, tuple[float, int, int]] = {}
        for size in sorted(sizes):
            items, prints, tables = self.by_size[size]
            k = min(self.k, size)
            if len(words) < size:
                continue
            h = self._grams(words, k)
            run = size - k + 1
            weight = self.weight(h)
            for first in range(0, len(h) - run + 1, RUN):
                windows = _fingerprints(h[first : first + RUN + run - 1], weight[first : first + RUN + run - 1], run)
                pairs = []
                for own, (values, order) in zip(blocks_of(windows).T, tables, strict=True):
                    lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
                    n = hi - lo
                    w = np.repeat(np.arange(len(own)), n)
                    pairs.append(w * len(items) + order[np.repeat(lo, n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)])
                found = np.unique(np.concatenate(pairs))
                w, i = found // len(items), found % len(items)
                near = np.bitwise_count(windows[w] ^ prints[i]).sum(axis=1) <= self.radius
                for a, b in zip((w[near] + first).tolist(), i[near].tolist(), strict=True):
                    s = self.similarity(int(items[b]), h[a : a + run], weight[a : a + run])
                    have = best.get(int(items[b]))
                    if s >= least and (have is None or s > have[0]):
                        best[int(items[b])] = (s, a, size)
        return best


def _zones(hits: np.ndarray, n_words: int, reach: int) -> Iterator[tuple[int, int]]:
    start, end = None, 0
    for p in hits.tolist():
        if start is not None and p - reach > end:
            yield start, end
            start = None
        start = max(0, p - reach) if start is None else start
        end = min(n_words, p + reach)
    if start is not None:
        yield start, end


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each document for each item found in it.

    Words are lower-cased in A-Z and split at space, tab and the controls up to CR; items with fewer words than k are
    one shingle, items and documents without words (null and empty texts too) match nothing. Ties go to the first
    window. Repeated documents each give their rows. The benchmark is held in blocks of about ITEMS_A_BLOCK items and
    BYTES_A_BLOCK bytes, one pass over the documents for each; what is broadcast is a block and, with several, the
    shingles (16 bytes each) that two or more items of the whole benchmark have. Other columns are not looked at.
    """
    return _leaks(docs, benchmark, k, least, radius).drop("tid")


def _leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of leaks(), with tid of the document's text."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_A_BLOCK), -(-size // BYTES_A_BLOCK))
    common = docs.sparkSession.sparkContext.broadcast(_common(benchmark, k) if blocks > 1 else None)
    out = None
    for block in range(blocks):
        mine = benchmark.select("item_id", "text")
        if blocks > 1:
            mine = mine.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        found = _scan(docs, items, common, k, least, radius)
        out = found if out is None else out.unionAll(found)
    return out


def _common(benchmark: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What Index takes as common, counted once over the whole benchmark."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                words = Words(texts, lower=True)
                hashes = words.hashes()
                cuts = [(int(a), int(n)) for a, n in zip(words.first_word, words.n_words, strict=True) if n]
                for a, n in cuts:
                    yield pa.RecordBatch.from_arrays([pa.array([None, *as_long(np.unique(Index._grams(hashes[a : a + n], min(k, n)))).tolist()], pa.int64())], ["h"])

    said = benchmark.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(grams, "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = said.where("h is null or n > 1").toArrow()
    h, n = found.column("h").combine_chunks(), found.column("n").to_numpy()
    item = h.is_null().to_numpy(zero_copy_only=False)
    keys = h.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], n[~item][order], int(n[item].sum())


def _scan(docs: DataFrame, items, common, k: int, least: float, radius: int) -> DataFrame:
    schema = "doc_id long, tid long, item_id long, similarity double, start_word int, n_words int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items.value, k, radius, common.value)
        for batch in batches:
            ids, tids = batch.column("doc_id").to_pylist(), batch.column("tid").to_pylist()
            rows = []
            for a, _, texts in text_slices(batch.column("text")):
                words = Words(texts, lower=True)
                hashes = words.hashes()
                shared = np.zeros(len(hashes), bool)
                sizes_at: dict[int, set[int]] = {}
                for n in [k, *index.short]:
                    whole = np.flatnonzero(words.text[: len(hashes) - n + 1] == words.text[n - 1 :]) if len(hashes) >= n else []
                    if len(whole) and len(index.known):
                        h = Index._grams(hashes, n)[whole]
                        at = np.minimum(np.searchsorted(index.known, h), len(index.known) - 1)
                        same = index.known[at] == h
                        shared[whole[same]] = True
                        for p, x in zip(whole[same].tolist(), at[same].tolist(), strict=True):
                            sizes_at.setdefault(p, set()).update(index.sizes_of[x])
                hits = np.flatnonzero(shared)
                for j in np.unique(words.text[hits]).tolist():
                    first, n = int(words.first_word[j]), int(words.n_words[j])
                    own = hits[words.text[hits] == j] - first
                    best: dict[int, tuple[float, int, int]] = {}
                    for x, y in _zones(own, n, index.longest):
                        sizes = set().union(*(sizes_at[first + p] for p in own[(own >= x) & (own < y)].tolist()))
                        for item, (s, p, size) in index.matches(hashes[first + x : first + y], sizes, least).items():
                            if item not in best or s > best[item][0]:
                                best[item] = (s, p + x, size)
                    rows += [(ids[a + j], tids[a + j], index.ids[item], s, p, size) for item, (s, p, size) in sorted(best.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tid", "item_id", "similarity", "start_word", "n_words"])

    return own_id(docs).withColumn("tid", text_id()).mapInArrow(scan, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    return of_rows(docs, _leaks(docs, benchmark, **how).select("doc_id", "tid").distinct(), "left_anti").select(*docs.columns)
