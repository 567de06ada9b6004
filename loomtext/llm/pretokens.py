"""Byte-pair ids of many texts: each distinct pretoken of a slice goes to the tokenizer once.

The vocabulary's pattern splits a text into pretokens that are encoded on their own, so the ids of a text are those
of its pretokens in a row. Splitting is vectorised for code points below 0x250; a text with others goes to the
tokenizer whole, with the same result. So does a text with the content of an added token (such as an end mark), which
the tokenizer looks for before it splits.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from loomtext.llm.textnum import point_hasher

LIMIT = 0x250
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    kinds = np.full(LIMIT, OTHER, np.uint8)
    for c in range(LIMIT):
        group = unicodedata.category(chr(c))[0]
        kinds[c] = LETTER if group == "L" else NUMBER if group == "N" else OTHER
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return kinds


KINDS = _classes()


def starts(points: np.ndarray, text_start: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """Where each pretoken begins, for texts laid end to end (none empty)."""
    n = len(points)
    kind = KINDS[points]
    begin = np.empty(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    fresh = np.zeros(n, bool)
    fresh[text_start] = True
    begin |= fresh
    begin[0] = True
    # The last white space before a word is a pretoken by itself, or the word's own first character if it is a space.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:]) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 0x20]] = False
    # 's 't 'm 'd and 're 've 'll end where they do, whatever letters follow.
    at = np.flatnonzero((points == 0x27) & begin)
    end_of = text_end[np.searchsorted(text_start, at, "right") - 1]
    one = np.where(at + 1 < end_of, points[np.minimum(at + 1, n - 1)], 0)
    two = np.where(at + 2 < end_of, points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for found, size in ((at[short], 2), (at[long], 3)):
        begin[found + 1] = False
        begin[(found + size)[found + size < n]] = True
    return np.flatnonzero(begin)


class PieceEncoder:
    """Keeps the ids of pretokens seen before, up to a bound."""

    KEPT = 1_500_000
    TOGETHER = 2000

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # of each key, its first id and its count
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and counts; words that are a space and letters are encoded as one text, which splits into them again."""
        ids, sizes = [], []
        for a in range(0, len(words), self.TOGETHER):
            part = words[a : a + self.TOGETHER]
            found = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return ids, sizes

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        spaced = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        ids, sizes = self._words([w for w, s in zip(words, spaced.tolist(), strict=True) if s])
        others = [x.ids for x in self.tokenizer.encode_batch_fast([w for w, s in zip(words, spaced.tolist(), strict=True) if not s], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, others), np.int64, len(others)))
        ids.append(np.fromiter((i for x in others for i in x), np.uint32))
        keys = np.concatenate([keys[spaced], keys[~spaced]])
        size = np.concatenate(sizes)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *ids])
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.size = (np.insert(have, into, more[order]) for have, more in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and (t.isascii() or max(t) < chr(LIMIT)) and not any(a in t for a in self.added):
                plain.append(i)
            elif t:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        if not plain:
            return out
        joined = "".join(texts[i] for i in plain)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(texts[i]) for i in plain), np.int64, len(plain))
        text_end = np.cumsum(sizes)
        text_start = text_end - sizes
        start = starts(points, text_start, text_end)
        end = np.append(start[1:], len(points))
        key, first, back = np.unique(point_hasher(points).of(start, end), return_index=True, return_inverse=True)
        if len(self.keys) > self.KEPT:
            self._forget()
        seen = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        inside = seen < len(self.keys)
        new[inside] = self.keys[seen[inside]] != key[inside]
        if new.any():
            self._learn(key[new], [joined[start[i] : end[i]] for i in first[new].tolist()])
        at = np.searchsorted(self.keys, key)[back]
        size = self.size[at]
        total = np.cumsum(size)
        flat = self.ids[np.repeat(self.at[at] - total + size, size) + np.arange(int(total[-1]))]
        cut = np.append(0, total)[np.searchsorted(start, np.append(text_start, len(points)))]
        for i, a, b in zip(plain, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i] = flat[a:b]
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(vocabulary: str) -> PieceEncoder:
    """One for each Python worker, so that what a task has learnt serves the next."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PieceEncoder(vocabulary)
    return _encoders[vocabulary]
