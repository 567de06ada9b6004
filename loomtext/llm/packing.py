"""Best-fit packing with certified bin counts.

Documents become token pieces; pieces that fill a sequence stand alone and the others are packed by best fit
decreasing, partition by partition. Dual feasible functions bound from below how many sequences a partition needs.
A certified partition (its count equals the bound) gives up only its emptiest sequence, since rounding up once a
partition is the one loss left; a partition with a gap gives up all its looser sequences. What is given up is dealt
out anew to fewer partitions and packed again, until one partition is left. A round that would give up more than three
quarters of its items gives up the emptiest sequence of each partition alone, so that every round shrinks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.pretokens import encoder
from loomtext.llm.shared import own_id, written
from loomtext.llm.textnum import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise every whole text and cut those over `size` ids; the first piece takes the remainder.

    A null or empty text is the one piece [end_id]. Repeated rows are packed as often as they stand there: item
    numbers rows, not doc_id. Columns other than doc_id and text are not looked at.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(vocabulary)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, docs_in = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices([len(t) for t in texts], 1_000_000):
                rows = []
                for doc_id, ids in zip(docs_in[a:b], coder.encode(texts[a:b]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = list(range(len(ids) % size or size, len(ids), size)) if len(ids) > size else []
                    for k, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(ids)], strict=True)):
                        rows.append((doc_id, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), item))
                        item += 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    return own_id(docs).mapInArrow(encode, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: bin and offset of each length, and the fill of each bin."""
    bin_of, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit c is set when a bin with c free places exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = some >> n
        if above:
            c = n + ((above & -above).bit_length() - 1)
            b = free[c].pop()
            if not free[c]:
                some &= ~(1 << c)
        else:
            b, c = len(fill), size
            fill.append(0)
        bin_of[i], offset[i] = b, size - c
        fill[b] = size - c + n
        free[c - n].append(b)
        some |= 1 << (c - n)
    return bin_of, offset, np.array(fill, np.int64)


def bins_bound(lengths: np.ndarray, size: int) -> int:
    """The best lower bound of two families of dual feasible functions over these lengths."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    bound = -(-int(count @ x) // size)
    for e in np.flatnonzero(count[: size // 2 + 1]).tolist():  # lengths over size - e count whole, those under e not at all
        value = np.where(x > size - e, size, np.where(x < e, 0, x))
        bound = max(bound, -(-int(count @ value) // size))
    most = size // int(lengths.min()) if len(lengths) else 0  # of the shortest length in a sequence: equal lengths are bounded at this k
    for k in range(1, max(32, most) + 1):  # (k + 1) x / size rounded down, in units of 1 / k, unless it is whole
        value = np.where((k + 1) * x % size == 0, x * k, (k + 1) * x // size * size)
        bound = max(bound, -(-int(count @ value) // (size * k)))
    return bound


def _packer(size: int, step: int) -> Callable:
    def pack(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        lengths = frame["length"].to_numpy()
        bin_of, offset, fill = best_fit(lengths, size)
        certified = len(fill) == bins_bound(lengths, size)
        emptiest = np.arange(len(fill)) == np.argmin(fill)
        loose = emptiest if certified else emptiest | (fill < size - size // 64)
        frame["sequence_id"] = (step << 56) + (int(keys[0]) << 24) + bin_of
        frame["offset"], frame["certified"], frame["emptiest"], frame["loose"] = offset, certified, emptiest[bin_of], loose[bin_of]
        return frame[["item", "length", "sequence_id", "offset", "certified", "emptiest", "loose"]]

    return pack


def packed(items: DataFrame, size: int = 1024, partition_items: int = 8192) -> DataFrame:
    """Place rows of (item, length), lengths from 1 to size: adds sequence_id, offset, certified.

    certified says that the item's partition met its lower bound. Ties are broken by item.
    An empty table gives an empty one. About partition_items items meet in a task, whatever the input, or what fills
    two sequences where that is more: of two partitions or more one then keeps a sequence, and every round shrinks.
    """
    schema = "item long, length long, sequence_id long, offset long, certified boolean, emptiest boolean, loose boolean"
    done, rest, step = [], items.select("item", "length"), 0
    n, ids = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    while True:
        parts = max(1, min(-(-n // partition_items), -(-ids // (2 * size))))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("item", F.lit(step)), F.lit(parts)))
        now = written(dealt.groupBy("part").applyInPandas(_packer(size, step), schema), f"packed-{step}")
        if parts == 1:
            done.append(now.drop("emptiest", "loose", "length"))
            break
        of = {c: now.where(c).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() for c in ("loose", "emptiest")}
        given = "loose" if 4 * of["loose"][0] <= 3 * n else "emptiest"
        done.append(now.where(~F.col(given)).drop("emptiest", "loose", "length"))
        rest, (n, ids), step = now.where(given).select("item", "length"), of[given], step + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row a piece, with its sequence and its place in it; see pieces() and packed()."""
    cut = written(pieces(docs, vocabulary, size, end_id), "pieces")
    alone = cut.where(F.col("length") == size).select(*cut.columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    open_ = cut.where(F.col("length") < size)
    placed = open_.join(packed(open_, size), "item")
    return alone.unionByName(placed).drop("item")
