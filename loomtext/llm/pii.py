"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are decided by pattern and check alone. The method adds kinds that need more
evidence: iban (mod 97), ssn and birth date (context words), secret (key-like strings after a naming word). An added
span scores its pattern's prior, plus for a passed checksum, plus for a context word within 40 code points before or
after; it is kept from 0.5 up. Base spans always stay, and an added span that overlaps a base span is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import own_id

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "birth", "secret")
Span = tuple[str, int, int, float]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: kind, pattern, prior, bonus of a passed check, context words
_PROPOSED = (
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0.2, 0.5, ("iban", "account", "konto", "compte", "cuenta", "bank")),
    ("ssn", re.compile(r"(?<![0-9-])[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.3, 0.1, ("ssn", "social security", "tax id", "taxpayer")),
    ("birth", re.compile(r"(?<![0-9./-])(?:[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![0-9./-])"), 0.2, 0.1, ("born", "birth", "dob", "geboren", "naissance", "nacimiento")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9+/_-])"), 0.1, 0.15, ("token", "secret", "api_key", "apikey", "api key", "password", "passwd", "bearer")),
)
_NEAR = 40


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)]
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain. Each @ is looked at once, so long runs cost no more."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        at = run.start()
        parts = run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b, 1.0) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b, 1.0) for a, b in ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end(), 1.0))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end(), 1.0))
    return out


def _checked(kind: str, found: str) -> bool:
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "ssn":
        return found[:3] not in ("000", "666") and found[4:6] != "00" and found[7:] != "0000"
    if kind == "birth":
        a, b, c = re.split("[./-]", found)
        year, month, day = (a, b, c) if len(a) == 4 else (c, b, a)
        return "1900" <= year <= "2030" and 1 <= int(month) <= 12 and 1 <= int(day) <= 31
    return bool(re.search("[0-9]", found)) and bool(re.search("[A-Za-z]", found)) and len(set(found.rstrip("="))) >= 8


def added_spans(text: str, base: list[Span]) -> list[Span]:
    out: list[Span] = []
    if not _DIGIT.search(text):
        return out
    taken = [(a, b) for _, a, b, _ in base]
    low = None
    for kind, pattern, prior, bonus, words in _PROPOSED:
        if kind == "secret":
            low = low or text.lower()
            if not any(w in low for w in words):
                continue
        for m in pattern.finditer(text):
            a, b = m.span()
            near = (text[max(0, a - _NEAR) : a] + " " + text[b : b + _NEAR]).lower()
            score = prior + bonus * _checked(kind, m.group()) + 0.3 * any(w in near for w in words)
            if score >= 0.5 and not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b, round(score, 3)))
    return out


def spans_of(text: str) -> list[Span]:
    """All spans, by kind as listed in BASE and ADDED, then by start."""
    base = base_spans(text)
    added = added_spans(text, base)
    kinds = (*BASE, *ADDED)
    return sorted(base + added, key=lambda s: (kinds.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def found(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every whole text, in code points, end exclusive.

    A null or empty text has none; repeated rows each give a row; other columns are not looked at.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return own_id(docs).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def digest(spans: DataFrame) -> DataFrame:
    """Counts a kind, all spans as text, and the SHA-256 of the base ones."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def _scrubbed(text: str) -> str:
    pieces, done = [], 0
    for k, a, b, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= done:
            pieces += [text[done:a], f"<{k.upper()}>"]
        done = max(done, b)
    return "".join([*pieces, text[done:]]) if done else text


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars follows. Null texts stay null.

    Overlapping spans are replaced as one, named after the first. All columns are kept as they are otherwise.
    """

    def scrub(texts: pd.Series) -> pd.Series:
        return texts.map(_scrubbed, na_action="ignore").astype(object)

    clean = F.pandas_udf(scrub, "string")
    return docs.withColumn("text", clean("text")).withColumn("n_chars", F.length("text").cast("long"))
