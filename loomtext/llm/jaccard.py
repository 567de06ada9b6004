"""Exact n-gram Jaccard join with signature trees.

Documents with the same shingle set are one class. Classes that may be linked stand under common roots: in one order of
all shingles, two sets within the threshold share c of their first n - ceil(threshold * n) + c, and roots are these
shingles. The order is by frequency, rare ones first, so that a passage that many documents share is no root of theirs.
A class that shares too few roots with classes of its size has no link.

Each class is first compared with the least of its size under its roots. What that leaves in different components is
searched:

* a root of up to LEAF classes is one leaf: pairs that bitmaps and sizes can't rule out are compared exactly;
* a larger root is a tree: leaves of bounded size, above them ranges of sizes. Nodes hold the OR of token
  bitmaps and the ranges of sizes and labels. A dual traversal pairs ranges, then leaves, and drops pairs whose largest
  possible overlap misses the threshold or that lie in one component. Two leaves that remain are compared exactly in one
  task, which joins what it links and tells a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.components import components
from loomtext.llm.shared import of_rows, own_id, released, text_id, written
from loomtext.llm.textnum import Words, as_long, mix, shingles, text_slices

BITS = 2048
WORDS = BITS // 64
LEAF = 64
LEAF_SHINGLES = 100_000  # of a leaf of a large root, all its classes together
SHARED = 50  # shingles for which linked sets share one root more
FREQUENT = 5  # log2 of the least count of a shingle that the order knows as frequent
WHOLE = 4_096  # rows of a root whose sizes a task compares
COMMON = 12  # log2 of the count from which a shingle as a root is known to be one of more rows than that
PLACES = 1 << 20  # words of bits that are broadcast at most, 16 MB
MOST_FREQUENT = 1 << 20  # shingles the order knows at most; the others count as rare
RUN = 4_000_000  # shingles a task counts together
SLICE = 500_000  # bytes of texts that are hashed together


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text and hash, and each text's first place and count."""
    words = Words(texts, lower=True)
    h, of, _ = shingles(words.hashes(), words.text, words.n_words, words.first_word, k)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
        h, of = h[new], of[new]
    n = np.bincount(of, minlength=len(texts)).astype(np.int64)
    return h, np.cumsum(n) - n, n


def set_keys(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for the empty set."""
    sums = np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(11))))
    return np.where(n > 0, mix(sums[first + n] - sums[first] + n.astype(np.uint64)), np.uint64(0))


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in different sets, sorted, and the log2 of how often; at most MOST_FREQUENT, the commonest.

    A task counts runs of RUN shingles and tells those it met twice or more; all tasks' counts are added up. What this
    overlooks counts as rare: that costs time, no link, as any one order of shingles gives the same links.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def met_again() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            count = np.diff(np.append(first, len(every)))
            again = count > 1
            return pa.RecordBatch.from_arrays([pa.array(as_long(every[first[again]])), pa.array(count[again])], ["shingle", "count"])

        for batch in batches:
            for _, _, texts in text_slices(batch.column("text"), SLICE):
                h, first, n = shingle_sets(texts, k)
                keys = set_keys(h, first, n).tolist()
                new = np.zeros(len(keys), bool)
                for i, key in enumerate(keys):
                    new[i] = key not in seen
                    seen.add(key)
                held.append(h[np.repeat(new, n)])
                size += len(held[-1])
                if size > RUN:
                    yield met_again()
                    held, size, seen = [], 0, set()
        yield met_again()

    counts = own_id(docs).mapInArrow(scan, "shingle long, count long").groupBy("shingle").agg(F.floor(F.log2(F.sum("count"))).cast("int").alias("power")).where(F.col("power") >= FREQUENT)
    counts = written(counts, "jaccard-frequent")
    least, total = 64, 0
    for power, n in sorted(counts.groupBy("power").count().collect(), reverse=True):
        total += n
        if total > MOST_FREQUENT:
            break
        least = power
    told = counts.where(F.col("power") >= least).toArrow()
    token, power = told.column("shingle").to_numpy().view(np.uint64), told.column("power").to_numpy()
    order = np.argsort(token)
    return token[order], power[order]


def least_shared(n: Column | int) -> Column | int:
    """Roots that two linked sets have in common at least, the smaller of n shingles."""
    return 1 + F.floor(n / SHARED) if isinstance(n, Column) else 1 + n // SHARED


class Roots:
    """The roots of a set, for a threshold of percent / 100: its first shingles in the order of frequency, so many that
    linked sets share least_shared() of them."""

    def __init__(self, percent: int, frequent: np.ndarray, power: np.ndarray) -> None:
        self.percent, self.frequent, self.power = percent, frequent, power

    def of(self, h: np.ndarray) -> np.ndarray:
        """Roots of one set, given sorted by hash."""
        return np.concatenate(self.parted(h))

    def parted(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rare ones among them, and the COMMON ones."""
        n = len(h)
        most = n - -(-n * self.percent // 100) + least_shared(n)
        if not len(self.frequent):
            return h[:most], h[:0]
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        rank = np.where(self.frequent[at] == h, self.power[at], 0)
        first = np.argsort(rank, kind="stable")[:most]
        common = rank[first] >= COMMON
        return h[first[~common]], h[first[common]]


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tid of its text, n, key of its set, and the roots, rare and common, of a set's first document in a task; for the
    others null."""
    frequent, power = frequent_shingles(docs, k)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, seen = Roots(percent, frequent, power), set()
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE):
                h, first, n = shingle_sets(texts, k)
                keys = as_long(set_keys(h, first, n))
                roots = []
                for i, key in enumerate(keys.tolist()):
                    if not n[i] or key in seen:
                        roots.append((None, None))
                        continue
                    seen.add(key)
                    roots.append(tuple(as_long(x) for x in how.parted(h[first[i] : first[i] + n[i]])))
                rare, common = (pa.array([r[j] for r in roots], pa.list_(pa.int64())) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("tid").slice(a, b - a), pa.array(n), pa.array(keys), rare, common], ["doc_id", "tid", "n", "key", "roots", "common"])

    return own_id(docs).withColumn("tid", text_id()).mapInArrow(scan, "doc_id long, tid long, n long, key long, roots array<long>, common array<long>")


def company(stands: DataFrame, percent: int, common: DataFrame | None = None) -> DataFrame:
    """root, key and n of the rows (root, key, n) of sets that may be linked, under roots that they may share.

    stands: rows of rare roots; common: of common ones.

    A set stays under a root if another of a size within the threshold stands there too, and stays at all if it stays
    under as many roots as linked sets share at least. Rows of rare roots are dealt by root once, and a task compares the
    sizes of each root it has; the rows of a common root, or of one of more than WHOLE rows, all stay. Rows that stay are dealt by
    set once, to be counted.
    """

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(x: pa.Table, loose: bool) -> list[pa.RecordBatch]:
            return x.append_column("loose", pa.array(np.full(x.num_rows, loose))).combine_chunks().to_batches()

        def with_neighbours(x: pa.Table) -> list[pa.RecordBatch]:
            root, key, n = (x.column(c).to_numpy() for c in ("root", "key", "n"))
            order = np.lexsort((key, n, root))
            r, k, m = root[order], key[order], n[order]
            once = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
            order, r, m = order[once], r[once], m[once]
            near = (r[1:] == r[:-1]) & (100 * m[:-1] >= percent * m[1:])
            return told(x.take(pa.array(order[np.append(False, near) | np.append(near, False)])), False)

        held: pa.Table | None = None
        large = None  # a root of which more than WHOLE rows went by
        for batch in batches:
            new = pa.Table.from_batches([batch])
            if large is not None:
                again = new.column("root").to_numpy() == large
                if again.any():
                    yield from told(new.filter(pa.array(again)), True)
                    new = new.filter(pa.array(~again))
                if not new.num_rows:
                    continue
                large = None
            held = new if held is None else pa.concat_tables([held, new])
            root = held.column("root").to_numpy()
            other = np.flatnonzero(root != root[-1]) if len(root) else np.zeros(0, np.int64)
            if len(other):
                yield from with_neighbours(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
            if held.num_rows > WHOLE:
                large = held.column("root")[0].as_py()
                yield from told(held, True)
                held = None
        if held is not None and held.num_rows:
            yield from with_neighbours(held)

    met = stands.repartition("root").sortWithinPartitions("root").mapInArrow(sized, "root long, key long, n long, loose boolean")
    met = written(met if common is None else met.unionByName(common.withColumn("loose", F.lit(True))), "jaccard-held")
    held = met.where("not loose").select("root", "key", "n").unionByName(met.where("loose").select("root", "key", "n").distinct())
    counted = held.withColumn("roots", F.count(F.lit(1)).over(Window.partitionBy("key")))
    kept = written(counted.where(F.col("roots") >= least_shared(F.ceil(F.col("n") * percent / 100))).select("root", "key", "n"), "jaccard-under")
    released(met)
    return kept


def maybe_asked(rows: DataFrame, at: Column, asked: DataFrame, c: str) -> DataFrame:
    """The rows whose hash `at` is in column c of asked, and few others, found before they are shuffled: by a bit for each
    hash in PLACES words."""
    place = lambda h: F.pmod(F.shiftright(h, 6), F.lit(PLACES))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    marks = asked.groupBy(place(F.col(c)).alias("_place")).agg(F.bit_or(bit(F.col(c))).alias("_bits"))
    return rows.withColumn("_place", place(at)).join(F.broadcast(marks), "_place").where(F.col("_bits").bitwiseAND(bit(at)) != 0).drop("_place", "_bits")


def sketch(h: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits for each hash, a power of two; folding the wider of two makes both as wide."""
    flags = np.zeros(1 << max(6, (4 * len(h) - 1).bit_length()), np.uint8)
    flags[(h % np.uint64(len(flags))).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def class_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """key, n, bitmap, sketch and sorted hashes for rows (doc_id, tid, key)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE):
                h, first, n = shingle_sets(texts, k)
                keys = as_long(set_keys(h, first, n))
                asked = batch.column("key").slice(a, b - a).to_numpy()
                bits, sketches, hashes, kept = [], [], [], []
                for i in np.flatnonzero(keys == asked).tolist():
                    if int(keys[i]) in seen:
                        continue
                    seen.add(int(keys[i]))
                    own = h[first[i] : first[i] + n[i]]
                    flags = np.zeros(BITS, np.uint8)
                    flags[(own % np.uint64(BITS)).astype(np.int64)] = 1
                    bits.append(np.packbits(flags).view(np.int64))
                    sketches.append(sketch(own).tobytes())
                    hashes.append(own.tobytes())
                    kept.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(n[kept]), pa.array(bits, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(hashes, pa.binary())], ["key", "n", "bits", "sketch", "hashes"])

    likely = maybe_asked(own_id(docs), text_id(), reps, "tid")
    once = of_rows(likely.select("doc_id", "text"), reps.select("doc_id", "tid", "key"), "inner").select("key", "text")
    return once.mapInArrow(mark, "key long, n long, bits array<long>, sketch binary, hashes binary")


def _bit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)


def _most_overlap(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound on common elements: each bit that only one side has is an element the other lacks."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(-1), nb - np.bitwise_count(b & ~a).sum(-1))


def _reach(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (na + nb - overlap)


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that sketches can't rule out. Long sets fill bitmaps of BITS, so that these hardly rule
    out any of them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m, n in zip(batch.column("sa"), batch.column("sb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (np.bitwise_or.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
                keep.append(bool(_reach(_most_overlap(m, n, x, y), m, n, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.hint("merge").join(a, "a").join(b.hint("merge"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(compare, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, by comparing the sets of those that sketches leave."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(100 * overlap >= percent * (len(both) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(near(pairs, sets, percent), "jaccard-near")
    sets = maybe_asked(sets, F.col("key"), pairs.select(F.explode(F.array("a", "b")).alias("key")), "key")
    a = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    return pairs.hint("merge").join(a, "a").join(b.hint("merge"), "b").select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long")


def small_root_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels under roots of up to LEAF classes (root, key, n, label, bits) that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours at growing distances, for all roots of a batch at once."""

        def pairs(x: pa.Table) -> pa.RecordBatch:
            root, key, n, label = (x.column(c).to_numpy() for c in ("root", "key", "n", "label"))
            bits, found = _bit_rows(x.column("bits")), [np.zeros((2, 0), np.int64)]
            for d in range(1, len(key)):
                i = np.flatnonzero(root[:-d] == root[d:])
                if not len(i):
                    break
                i = i[(label[i] != label[i + d]) & (100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d]))]
                i = i[_reach(_most_overlap(n[i], n[i + d], bits[i], bits[i + d]), n[i], n[i + d], percent)]
                found.append(np.stack([np.minimum(key[i], key[i + d]), np.maximum(key[i], key[i + d])]))
            a, b = np.concatenate(found, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            root = held.column("root").to_numpy()
            other = np.flatnonzero(root != root[-1]) if len(root) else np.zeros(0, np.int64)
            if len(other):
                yield pairs(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield pairs(held)

    return members.repartition("root").sortWithinPartitions("root").mapInArrow(run, "a long, b long").distinct()


def _nodes(rows: DataFrame, *by: str) -> DataFrame:
    """OR of bitmaps, ranges of sizes and labels, and the most elements that a member has beyond its bits."""
    ors = F.array(*[F.bit_or(F.col("bits")[i]) for i in range(WORDS)]).alias("bits")
    return rows.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("l1").alias("l1"), F.max("l2").alias("l2"), F.max("slack").alias("slack"), ors)


def _meet(percent: int) -> Column:
    """Whether members of the nodes p and q can be linked and are not yet: common elements have their bits in both ORs."""
    p, q = (lambda c, s=s: F.col(f"{s}.{c}") for s in ("p", "q"))
    most = F.least(p("slack"), q("slack")) + F.aggregate(F.zip_with(p("bits"), q("bits"), lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0).cast("long"), lambda s, x: s + x)
    sized = (100 * p("hi") >= percent * q("lo")) & (100 * q("hi") >= percent * p("lo"))
    apart = ~((p("l1") == p("l2")) & (p("l1") == q("l1")) & (q("l1") == q("l2")))
    return sized & apart & (100 * most >= percent * F.greatest(p("lo"), q("lo")))


def spanning_links(key: np.ndarray, label: np.ndarray, sets: list[np.ndarray], split: int, percent: int) -> list[tuple[int, int]]:
    """Links between members before and from split on (all with each other, if split is 0) that join what labels keep
    apart: enough to connect all that is linked, one for each joining."""
    n = np.array([len(s) for s in sets], np.int64)
    left, right = (np.arange(split), np.arange(split, len(n))) if split else (np.arange(len(n)),) * 2
    token, back = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(len(n)), n)
    often = np.bincount(back) > 1
    column = np.cumsum(often) - 1
    who, back = who[often[back]], column[back[often[back]]]
    order = np.argsort(back, kind="stable")
    who, back = who[order], back[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for c in range(0, int(often.sum()), step):
        i, j = np.searchsorted(back, (c, c + step))
        flags = np.zeros((len(n), step), np.float32)
        flags[who[i:j], back[i:j] - c] = 1
        overlap += flags[left] @ flags[right].T
    overlap = np.rint(overlap).astype(np.int64)
    link = _reach(overlap, n[left][:, None], n[right][None, :], percent)
    _, part = np.unique(label, return_inverse=True)
    out = []
    for i in range(len(left)):
        at = right[link[i]]
        others, first = np.unique(part[at], return_index=True)
        for p, f in zip(others.tolist(), first.tolist(), strict=True):
            if p != part[left[i]]:
                out.append((int(key[left[i]]), int(key[at[f]])))
                part[part == p] = part[left[i]]
    return out


def leaf_links(x: pa.Table, y: pa.Table | None, percent: int) -> pa.Table:
    """Spanning links inside a leaf or between two."""
    found = []
    if x.num_rows and (y is None or y.num_rows):
        both = x if y is None else pa.concat_tables([x, y])
        sets = [np.frombuffer(h, np.uint64) for h in both.column("hashes").to_pylist()]
        found = spanning_links(both.column("key").to_numpy(), both.column("label").to_numpy(), sets, 0 if y is None else x.num_rows, percent)
    return pa.table([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


class Trees:
    """The trees of large roots, from rows (root, key, size, shingles)."""

    def __init__(self, members: DataFrame, sets: DataFrame, percent: int) -> None:
        self.percent = percent
        asked = maybe_asked(sets.select("key", "n", "bits", "hashes"), F.col("key"), members, "key")
        self.sets = sets = written(asked.join(members.select("key").distinct().hint("merge"), "key", "left_semi"), "tree-sets")
        leaves = F.greatest(F.ceil(F.col("shingles") / LEAF_SHINGLES), F.ceil(F.col("size") / (8 * LEAF)))
        sized = members.join(sets.select("key", "n", "bits"), "key")
        self.members = written(sized.select("root", "key", "n", "bits", F.floor(F.log(F.col("n").cast("double")) * 20).cast("int").alias("range"), F.pmod(F.xxhash64("key"), leaves).alias("leaf")), "tree-members")

    def pairs(self, labels: DataFrame) -> DataFrame:
        """root, (range, leaf) x and y of the leaves that a dual traversal leaves to compare."""
        held = self.members.join(labels, "key", "left").select("root", "range", "leaf", F.col("n").alias("lo"), F.col("n").alias("hi"), *[F.coalesce("label", "key").alias(c) for c in ("l1", "l2")], (F.col("n") - F.aggregate("bits", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))).alias("slack"), "bits")
        leaves = written(_nodes(held, "root", "range", "leaf"), "tree-leaves")
        ranges = written(_nodes(leaves, "root", "range"), "tree-ranges")
        meet = F.col("p.root") == F.col("q.root")
        above = ranges.alias("p").join(ranges.alias("q"), meet & (F.col("p.range") <= F.col("q.range"))).where(_meet(self.percent)).select("p.root", F.col("p.range").alias("x"), F.col("q.range").alias("y"))
        p = above.withColumnRenamed("x", "range").join(leaves, ["root", "range"]).alias("p")
        found = p.join(leaves.alias("q"), meet & (F.col("p.y") == F.col("q.range"))).where((F.col("p.range") < F.col("q.range")) | (F.col("p.leaf") <= F.col("q.leaf"))).where(_meet(self.percent))
        return found.select("p.root", F.struct(F.col("p.range"), F.col("p.leaf")).alias("x"), F.struct(F.col("q.range"), F.col("q.leaf")).alias("y"))

    def links(self, labels: DataFrame, alone: bool) -> DataFrame:
        """Spanning links inside leaves (alone) or between two."""
        met = written(self.pairs(labels).where((F.col("x") == F.col("y")) == F.lit(alone)), "tree-pairs")
        whole = self.members.select("root", F.struct("range", "leaf").alias("node"), "key").join(self.sets.select("key", "hashes"), "key").join(labels, "key", "left").select("root", "node", "key", F.coalesce("label", "key").alias("label"), "hashes")

        def side(c: str):
            return met.join(whole.withColumnRenamed("node", c), ["root", c]).select(*[F.col(x).alias(x) for x in ("root", "x", "y", "key", "label", "hashes")]).groupBy("root", "x", "y")

        percent, schema = self.percent, "a long, b long"
        if alone:
            return side("x").applyInArrow(lambda x: leaf_links(x, None, percent), schema)
        return side("x").cogroup(side("y")).applyInArrow(lambda x, y: leaf_links(x, y, percent), schema)


def _least() -> tuple[Column, Column]:
    """The least doc_id of a group and the text it has there; a text without an id only where no row has one."""
    return F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("tid", "doc_id"), F.min("tid")).alias("tid")


def _labelled(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, tid, n and key of every document; key, label of its component, doc_id and tid of every class."""
    own = written(classes(docs, k, percent), "jaccard-docs")
    every = written(own.where("n > 0").groupBy("key").agg(*_least()), "jaccard-classes")
    step = math.log(100 / percent) if percent < 100 else 1.0
    stands = lambda roots: own.where(F.col(roots).isNotNull()).select(F.explode(roots).alias("root"), "key", "n")
    under = company(stands("roots"), percent, stands("common")).withColumn("size_step", F.floor(F.log(F.col("n").cast("double")) / step))
    rooted, own = own, written(own.select("doc_id", "tid", "n", "key"), "jaccard-docs")
    released(rooted)
    sets = written(class_sets(docs, every.join(under.select("key").distinct(), "key", "left_semi"), k), "jaccard-sets")
    least = under.groupBy("root", "size_step").agg(F.min("key").alias("b"))
    stars = under.join(least, ["root", "size_step"]).where("key <> b").groupBy(F.col("key").alias("a"), "b").agg(F.count("*").alias("shared"))
    links = written(linked(stars.groupBy("a").agg(F.max_by("b", "shared").alias("b")), sets, percent), "jaccard-links")
    labels = components(links)

    named = under.join(labels.withColumnRenamed("node", "key"), "key", "left").select("root", "key", "n", F.coalesce("label", "key").alias("label"))
    spread = named.groupBy("root").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("size"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("xor"))
    searched = written(spread.where("l1 <> l2").groupBy("size", "sum", "xor").agg(F.min("root").alias("root"), F.min("shingles").alias("shingles")), "jaccard-searched")  # of roots with the same members one
    small = named.join(searched.where(F.col("size") <= LEAF).select("root"), "root").join(sets.select("key", "bits"), "key")
    links = links.unionAll(written(linked(written(small_root_pairs(small, percent), "jaccard-pairs"), sets, percent), "jaccard-links"))
    labels = components(links)
    large = searched.where(F.col("size") > LEAF)
    if not large.isEmpty():
        trees = Trees(under.join(large.select("root", "size", "shingles"), "root").select("root", "key", "size", "shingles"), sets, percent)
        for alone in (True, False):
            links = links.unionAll(written(trees.links(labels.withColumnRenamed("node", "key"), alone), "jaccard-links"))
            labels = components(links)
        released(trees.sets)
        released(trees.members)
    for done in (under, sets, searched):
        released(done)

    return own, every.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", "tid", F.coalesce("label", "key").alias("label"))


def joined(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; links are exact, none is lost.

    Words are lower-cased in A-Z only and split at space, tab and the controls up to CR. With fewer words than k the
    whole sequence is the one shingle; without words, or with a null text, the set is empty and linked with nothing.
    Copies and repeated rows share a class. An empty table gives an empty one. Columns other than doc_id and text
    are not looked at. Sets are told apart by 64-bit keys. A component without any doc_id has a null component_id.
    """
    own, least = _labelled(docs, k, percent)
    ids = written(least.join(least.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("key", "component_id"), "jaccard-ids")
    return own.join(ids, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the least doc_id, all columns kept.

    Texts of one doc_id in different components each stay; a null doc_id represents where no other does. Documents
    without words are linked with nothing: one row a doc_id stays.
    """
    own, least = _labelled(docs, k, percent)
    first = least.groupBy("label").agg(*_least()).select("doc_id", "tid").unionAll(own.where("n = 0").groupBy("doc_id").agg(F.min("tid").alias("tid")))
    # Joined by columns without nulls, so that the rows of one text of one id are together already when repeats are dropped.
    key = {"_rep_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_rep_none": F.col("doc_id").isNull()}
    asked = first.select(*[c.alias(n) for n, c in key.items()], F.col("tid").alias("_rep_tid"))
    kept = docs.withColumns(key | {"_rep_tid": text_id()}).join(asked.hint("merge"), [*key, "_rep_tid"], "left_semi")
    return kept.dropDuplicates([*key, "_rep_tid"]).select(*docs.columns)


def oracle(k: int = 3, percent: int = 90) -> str:
    """The rows of joined() in SQL, for tables small enough that sets which share a shingle can all be paired."""
    return rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END)) AS sh FROM d),
k AS MATERIALIZED (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s GROUP BY sh HAVING len(sh) > 0),
u AS MATERIALIZED (SELECT rep, n, unnest(sh) AS x FROM k),
e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN doc_id ELSE least(rep, coalesce(m.least, rep)) END AS component_id FROM s LEFT JOIN k ON k.sh = s.sh LEFT JOIN m ON m.a = k.rep"""
