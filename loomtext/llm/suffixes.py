"""Exact repeated byte strings by anchors sampled by content and hashes of ever smaller ranges of windows.

Which windows of `size` bytes also start elsewhere? Positions are sampled by content: in every window the k-byte string
of least hash is its anchor, so equal windows have their anchor at the same distance. The first groups are those of the
k-byte strings. Spark then groups by hash, for each anchor, the string that all windows of a range share (its core) and the one
that they cover together (its hull), for ranges of ever fewer distances, so at ever longer common strings. This stands in
for prefix doubling: no offsets double, and no pairs of ranks are sorted.

* a core that stands nowhere else is unique: its windows are too, and it drops out;
* a hull that stands elsewhere is past the threshold: all its windows are repeated, and it is settled. One member of
  its group stays, as a witness for others;
* the other ranges are split into the cells of the next round, whose cores and hulls are hashed anew.

The last ranges are single windows, so the result is exact, up to collisions of hashes: of 128 bits for windows, and of
64 bits for whole texts, which are told apart by xxhash64. Only ranks, positions
and the texts of documents that still have open ranges move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import of_rows, own_id, written
from loomtext.llm.textnum import Hasher, as_long, byte_hasher, mix, text_slices

SAMPLE = 200  # bytes of the strings that are sampled
CELLS = (32, 4, 1)  # distances in a range, round by round
SEGMENT = 4_000_000
_POSITION = np.uint64((1 << 23) - 1)
_SECOND = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and tid, a 64-bit hash that stands for the text."""
    return own_id(docs).withColumn("tid", F.xxhash64("text"))


def anchors(buf: np.ndarray, first: Hasher, start: np.ndarray, size: int, k: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run of windows with one anchor, and the rank of its k bytes.

    start says for each place of the buffer whether a window may start there.
    """
    w = size - k + 1
    ranks = first.fixed(k)
    n = len(buf) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    key = (ranks & ~_POSITION) | np.arange(len(ranks), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _POSITION).astype(np.int64)
    i = np.flatnonzero(start[:n])
    if not len(i):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = at[i]
    new = np.append(True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(i)) - 1
    return p[lo], i[lo], i[hi], ranks[p[lo]]


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, its text's id, bytes and SHA-256."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "tid", "n_bytes", "sha"])

    return _keyed(docs).mapInArrow(scan, "doc_id long, tid long, n_bytes long, sha string")


def _first_ranks(docs: DataFrame, size: int) -> DataFrame:
    """tid, p, lo, hi, core, h1, h2 of every run of windows. Of equal texts, a task looks at two: enough to be repeated."""
    schema = "tid long, p int, lo int, hi int, core long, h1 long, h2 long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("tid").to_pylist()
            for first, last, texts in text_slices(batch.column("text"), SEGMENT // 2):
                parts: list[tuple[int, int, bytes]] = []  # text id, offset in the text, bytes
                for tid, t in zip(ids[first:last], texts, strict=True):
                    if len(t) < size:
                        continue
                    seen[tid] = seen.get(tid, 0) + 1
                    if seen[tid] <= 2:
                        parts += [(tid, s, t[s : s + SEGMENT + size - 1]) for s in range(0, len(t) - size + 1, SEGMENT)]
                groups, total = [[]], 0
                for x in parts:
                    if total + len(x[2]) > SEGMENT + size and groups[-1]:
                        groups.append([])
                        total = 0
                    groups[-1].append(x)
                    total += len(x[2])
                for group in groups:
                    if group:
                        yield ranked(group)

    def ranked(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        buf = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        sizes = np.array([len(x[2]) for x in group])
        end = np.cumsum(sizes)
        begin = end - sizes
        start = np.zeros(len(buf), bool)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            start[b : e - size + 1] = True
        first, second = byte_hasher(buf), Hasher(_SECOND[buf])
        p, lo, hi, core = anchors(buf, first, start, size)
        of = np.searchsorted(end, lo, "right")
        shape = mix(((p - lo) * 1024 + (hi - lo)).astype(np.uint64))
        h1, h2 = first.of(lo, hi + size) ^ shape, second.of(lo, hi + size)
        move = np.array([x[1] for x in group])[of] - begin[of]
        columns = [np.array([x[0] for x in group], np.int64)[of], *((x + move).astype(np.int32) for x in (p, lo, hi)), as_long(core), as_long(h1), as_long(h2)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tid", "p", "lo", "hi", "core", "h1", "h2"])

    return _keyed(docs).mapInArrow(scan, schema)


def _cell_ranks(todo: DataFrame, texts: DataFrame, cell: int, size: int) -> DataFrame:
    """The ranges of each (p, lo, hi, d0, d1, weight), cut into cells of so many distances, with their ranks."""
    schema = "tid long, p int, lo int, hi int, a int, b int, weight int, core long, h1 long, h2 long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, items in zip(batch.column("tid").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("items").to_pylist(), strict=True):
                yield ranked(tid, text, items)

    def ranked(tid: int, text: bytes, items: list[dict]) -> pa.RecordBatch:
        p, lo, hi, d0, d1, weight = (np.array([x[c] for x in items], np.int64) for c in ("p", "lo", "hi", "d0", "d1", "weight"))
        least, most = np.maximum(d0, p - hi) // cell, np.minimum(d1, p - lo) // cell
        n = most - least + 1
        of = np.repeat(np.arange(len(n)), n)
        c = least[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        p, lo, hi, weight = p[of], lo[of], hi[of], weight[of]
        x, y = c * cell, c * cell + cell - 1  # the cell's distances, and those of them that are this range's own
        a, b = np.maximum(x, p - hi), np.minimum(y, p - lo)
        buf = np.frombuffer(text, np.uint8)
        first, second = byte_hasher(buf), Hasher(_SECOND[buf])
        core = first.of(p - x, p - y + size) ^ mix((c * 1024 + cell).astype(np.uint64))
        h1, h2 = first.of(p - b, p - a + size) ^ mix((a * 1024 + b + (1 << 30)).astype(np.uint64)), second.of(p - b, p - a + size)
        columns = [np.full(len(p), tid), *(v.astype(np.int32) for v in (p, lo, hi, a, b, weight)), as_long(core), as_long(h1), as_long(h2)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["tid", "p", "lo", "hi", "a", "b", "weight", "core", "h1", "h2"])

    return texts.join(todo.hint("merge"), "tid").select("tid", "text", "items").mapInArrow(scan, schema)


def _mixed(groups: DataFrame, name: str) -> DataFrame:
    """Of groups of equal hulls (core, weight, tid, p, lo, hi, d0, d1), those whose core others share while not all are settled."""
    shared = written(groups.groupBy("core").agg(F.count("*").alias("n"), F.min("weight").alias("least")).where("n > 1 and least = 1").select("core"), name)
    return groups.join(shared, "core", "left_semi").select("tid", F.struct("p", "lo", "hi", "d0", "d1", F.least("weight", F.lit(2)).cast("int").alias("weight")).alias("item"))


def texts_of(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """tid and text for rows (tid, doc_id), once each."""
    return of_rows(_keyed(docs), owners.select("doc_id", "tid"), "inner").dropDuplicates(["tid"]).select("tid", "text")


def repeated(docs: DataFrame, own: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """tid and [s, e) of runs of bytes covered by windows that stand elsewhere too (runs may overlap), and tid and text
    of every text that has such runs or may have them.

    Only positions whose first rank is shared go beyond the first step. Ids never decide a broadcast here: texts move
    by a sorted merge at any size.
    """
    every = written(_first_ranks(docs, size), "suffix-runs")
    again = written(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "suffix-again")
    runs = written(every.join(again.hint("merge"), "core", "left_semi"), "suffix-runs-again")
    where = F.min(F.struct("tid", "p", "lo", "hi"))
    hulls = written(runs.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("core").alias("core"), where.alias("x")).select("h1", "h2", "weight", "core", "x.*"), "suffix-hulls")
    settled = runs.join(hulls.where("weight > 1").select("h1", "h2"), ["h1", "h2"]).select("tid", F.col("lo").alias("s"), (F.col("hi") + size).alias("e"))
    out = [written(settled, "suffix-settled")]
    open_ = written(_mixed(hulls.withColumns({"d0": F.lit(0), "d1": F.lit(size)}), "suffix-cores"), "suffix-open")
    touched = open_.select("tid").unionAll(out[0].select("tid")).distinct()
    owners = own.groupBy("tid").agg(F.min("doc_id").alias("doc_id")).join(touched, "tid", "left_semi")
    texts = written(texts_of(docs, owners), "suffix-texts")
    for cell in CELLS:
        ranks = written(_cell_ranks(open_.groupBy("tid").agg(F.collect_list("item").alias("items")), texts, cell, size), f"suffix-ranks-{cell}")
        where = F.min(F.struct("tid", "p", "lo", "hi", "a", "b"))
        hulls = written(ranks.groupBy("h1", "h2").agg(F.sum("weight").alias("weight"), F.min("core").alias("core"), F.min("weight").alias("some"), where.alias("x")).select("h1", "h2", "weight", "core", "some", "x.tid", "x.p", "x.lo", "x.hi", F.col("x.a").alias("d0"), F.col("x.b").alias("d1")), f"suffix-hulls-{cell}")
        settled = ranks.where("weight = 1").join(hulls.where("weight > 1 and some = 1").select("h1", "h2"), ["h1", "h2"])
        out.append(written(settled.select("tid", (F.col("p") - F.col("b")).alias("s"), (F.col("p") - F.col("a") + size).alias("e")), "suffix-settled"))
        if cell > 1:
            open_ = written(_mixed(hulls, f"suffix-cores-{cell}"), f"suffix-open-{cell}")
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found, texts


def cut_texts(docs: DataFrame, own: DataFrame, size: int) -> DataFrame:
    """tid, n_removed, n_spans, spans (maximal removed runs [s, e) of bytes, in order) and kept, the bytes left, of every text that loses bytes."""
    found, texts = repeated(docs, own, size)
    ranges = found.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            spans = [_merged(r) for r in batch.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], kind)], ["tid", "n_removed", "n_spans", "spans"])

    cut = written(ranges.mapInArrow(merge, "tid long, n_removed long, n_spans long, spans array<struct<s:int,e:int>>"), "suffix-cut")
    one = own.groupBy("tid").agg(F.min("n_bytes").alias("n_bytes"))
    partly = written(one.join(cut, "tid").where("n_removed < n_bytes").select("tid", "spans"), "suffix-partly")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, left, total = [], [], 0
            for tid, text, spans in zip(batch.column("tid").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                starts, ends = [0, *(x["e"] for x in spans)], [*(x["s"] for x in spans), len(text)]
                ids.append(tid)
                left.append(b"".join(text[s:e] for s, e in zip(starts, ends, strict=True)))
                total += len(left[-1])
                if total > SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(left, pa.binary())], ["tid", "kept"])
                    ids, left, total = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(left, pa.binary())], ["tid", "kept"])

    kept = texts.join(partly.hint("merge"), "tid").select("tid", "text", "spans").mapInArrow(rest, "tid long, kept binary")
    return cut.join(kept, "tid", "left").withColumn("kept", F.coalesce("kept", F.lit("").cast("binary")))


def kept_texts(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, kept (the bytes left, which may cut a character) and spans ([s, e) of the bytes removed) of every document."""
    cut = cut_texts(docs, _own(docs, size), size).select("tid", "kept", "spans")
    none = F.array().cast("array<struct<s:int,e:int>>")
    return _keyed(docs).join(cut, "tid", "left").select("doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"), F.coalesce("spans", none).alias("spans"))


def _own(docs: DataFrame, size: int) -> DataFrame:
    if size <= SAMPLE:
        raise ValueError(f"strings of more than {SAMPLE} bytes only")
    return written(_documents(docs), "suffix-documents")


def without_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start:end in bytes, comma-joined) of every document.

    Every byte covered by a string of `size` bytes that also starts elsewhere, in any document or the same, is removed;
    strings are judged on the input. A null text is empty; an empty text has nothing to remove. Texts shorter than
    `size`, which must be over SAMPLE, stay whole. Repeated rows are copies of each other. Columns other than doc_id and text are not looked at.
    The columns are digests of what kept_texts() gives whole, made of the same cut texts.
    """
    own = _own(docs, size)
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.s, x.e)), ",")
    done = written(cut_texts(docs, own, size).select("tid", "n_removed", "n_spans", listed.alias("spans"), F.sha2("kept", 256).alias("kept_sha")), "suffix-done")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(done, "tid", "left").select("doc_id", "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
