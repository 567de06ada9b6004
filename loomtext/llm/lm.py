"""Stupid-backoff scores from counts over the whole corpus, each document scored without its own counts.

Documents are dealt into blocks of a few megabytes. A block's distinct n-grams, with their counts, are dealt out by
hash: all entries of an n-gram meet in one hash partition, which adds them up and answers each block with what the
other blocks have of its n-grams, in the order they came (mostly zeros, which shuffle as next to nothing). Back at its
block, the answers stand beside the documents' own n-grams and scores are summed per document. Both uses of the blocks
read one shuffle of the texts. Arrays keep a row per block and hash partition rather than one per n-gram occurrence; sorted
hashes are sent as differences in as few bytes as the largest needs. However often an n-gram occurs, it costs one entry a
block, of 12 bytes in memory: the most frequent one, in every block of 100 TB, 300 MB in its hash partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import own_id
from loomtext.llm.textnum import Words, mix

BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 4_000_000  # of text, whose n-grams one hash partition adds up


def _ngrams(texts: list[bytes], order: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """For n from 1 to order: the hashes of n-grams and the place of the last word of each; none crosses texts."""
    words = Words(texts, lower=True)
    one = words.hashes()
    out, h = [], one
    for n in range(1, order + 1):
        if n > 1:
            h = mix(h[:-1] * np.uint64(3) + one[n - 1 :] + np.uint64(n)) if len(h) else h
        at = np.arange(n - 1, len(one))
        inside = words.text[at] == words.text[at - n + 1] if len(at) else np.zeros(0, bool)
        out.append((h[inside], at[inside]))
    return words, out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed(key: np.ndarray) -> bytes:
    """Sorted values as differences of equal width; the first byte tells the width."""
    steps = np.diff(key, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    first = key[:1].astype("<u8").tobytes()
    return bytes([width]) + first + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = rest
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]


def scored(docs: DataFrame, order: int = 2, alpha: float = 0.4) -> DataFrame:
    """doc_id, n_words, n_hits, log_micro, mean_log of every document.

    A word is scored by the longest n-gram that ends with it and that other documents have: count over the count of its
    history, times alpha for each step back; at the last step count over all words, with at least half a count. Counts
    are those of the corpus less the document's own. log_micro sums the natural logs, each rounded to a millionth;
    n_hits counts words scored by an n-gram of the full order. Words are lower-cased in A-Z and split at space, tab and
    the controls up to CR. A null or empty text has no words, sum 0 and mean 0. Repeated rows count as often as they
    stand there; other columns are not looked at. An empty table gives an empty one.
    """
    own = own_id(docs)
    size, all_words = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), F.lit(0))).first()
    buckets = max(8, -(-size // BUCKET_BYTES))
    blocks = own.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(8, -(-size // BLOCK_BYTES)))))

    def entries(table: pa.Table) -> pa.Table:
        _, grams = _ngrams(_texts(table), order)
        key, count = np.unique(np.concatenate([h for h, _ in grams]), return_counts=True)
        of = _bucket(key, buckets)
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(key) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(cut, len(key)).astype(np.int32))
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(of[cut].astype(np.int64)), "block": pa.array(np.full(len(cut), block, np.int64)), "hashes": pa.array([packed(k) for k in np.split(key, cut[1:])] if len(key) else [], pa.binary()), "counts": pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))})

    def add_up(table: pa.Table) -> pa.Table:
        counts = table.column("counts").combine_chunks()
        c = counts.flatten().to_numpy(zero_copy_only=False)
        key, back = np.unique(np.concatenate([unpacked(x.as_buffer().to_pybytes()) for x in table.column("hashes")]), return_inverse=True)
        others = np.bincount(back, c, len(key)).astype(np.int64)[back] - c
        offsets = pa.array(np.append(0, np.cumsum(counts.value_lengths().to_numpy())).astype(np.int32))
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "others": pa.ListArray.from_arrays(offsets, pa.array(others))})

    spread = blocks.groupBy("block").applyInArrow(entries, "bucket long, block long, hashes binary, counts array<int>")
    answers = spread.groupBy("bucket").applyInArrow(add_up, "bucket long, block long, others array<long>")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _texts(left)
        words, grams = _ngrams(texts, order)
        key, count = np.unique(np.concatenate([h for h, _ in grams]), return_counts=True)
        told = right.sort_by("bucket").column("others").combine_chunks().flatten().to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0, np.int64)
        totals = told + count
        n = len(words.start)
        rest = np.maximum(all_words - words.n_words, 1)[words.text]
        others = []  # by order: for each word, how often other documents have the n-gram that ends with it
        for h, at in grams:
            _, back, own_count = np.unique(mix(h ^ mix(words.text[at].astype(np.uint64))), return_inverse=True, return_counts=True)
            whole = np.zeros(n, np.int64)
            whole[at] = totals[np.searchsorted(key, h)] - own_count[back]
            others.append(whole)
        value = np.maximum(others[0], 0.5) / rest
        for k in range(1, order):
            history = np.append(0, others[k - 1][:-1])
            reached = np.zeros(n, bool)  # words that have a history of this order within their text
            reached[grams[k][1]] = True
            longer = reached & (others[k] > 0) & (history > 0)
            value = np.where(longer, others[k] / np.maximum(history, 1), np.where(reached, alpha * value, value))
        logs = np.rint(np.log(value) * 1e6).astype(np.int64)
        edge = np.append(words.first_word, n)
        sums, hits = np.append(0, np.cumsum(logs)), np.append(0, np.cumsum(others[-1] > 0) if order > 1 else np.zeros(n, np.int64))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(words.n_words.astype(np.int64)), "n_hits": pa.array(hits[edge[1:]] - hits[edge[:-1]]), "log_micro": pa.array(sums[edge[1:]] - sums[edge[:-1]])})

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, n_hits long, log_micro long")
    return out.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_micro") / 1000000 / F.col("n_words")).otherwise(0.0))


ORACLE = """
WITH w AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), a AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), t AS (
  SELECT * FROM a WHERE word <> ''
), b AS (
  SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t
), n AS (SELECT count(*) AS n FROM t),
u AS (SELECT word, count(*) AS c FROM t GROUP BY 1),
ud AS (SELECT doc_id, word, count(*) AS c FROM t GROUP BY 1, 2),
g AS (SELECT prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY 1, 2),
gd AS (SELECT doc_id, prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
nd AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
s AS (
  SELECT b.doc_id, b.prev, g.c - gd.c AS both_c, up.c - udp.c AS prev_c, u.c - ud.c AS word_c, greatest(n.n - nd.n, 1) AS rest
  FROM b CROSS JOIN n JOIN nd USING (doc_id) JOIN u ON u.word = b.word JOIN ud ON ud.doc_id = b.doc_id AND ud.word = b.word
  LEFT JOIN u up ON up.word = b.prev LEFT JOIN ud udp ON udp.doc_id = b.doc_id AND udp.word = b.prev
  LEFT JOIN g ON g.prev = b.prev AND g.word = b.word LEFT JOIN gd ON gd.doc_id = b.doc_id AND gd.prev = b.prev AND gd.word = b.word
), v AS (
  SELECT doc_id, both_c > 0 AS hit,
    CASE WHEN prev IS NULL THEN greatest(word_c, CAST(0.5 AS DOUBLE)) / rest
         WHEN both_c > 0 THEN CAST(both_c AS DOUBLE) / prev_c
         ELSE CAST(0.4 AS DOUBLE) * (greatest(word_c, CAST(0.5 AS DOUBLE)) / rest) END AS p
  FROM s
), r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE hit) AS n_hits, CAST(sum(CAST(round(ln(p) * 1e6) AS BIGINT)) AS BIGINT) AS log_micro FROM v GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits, CAST(coalesce(log_micro, 0) AS BIGINT) AS log_micro,
  CASE WHEN n_words > 0 THEN log_micro / CAST(1000000 AS DOUBLE) / n_words ELSE CAST(0 AS DOUBLE) END AS mean_log
FROM w LEFT JOIN r USING (doc_id)
"""
