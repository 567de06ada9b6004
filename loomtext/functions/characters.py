"""Unicode mappings of single characters as built-in expressions: case folding, and the ASCII of a text."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EVERY = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


@cache
def _case_folds() -> dict[str, str]:
    """Characters that case folding changes, with what they become."""
    return {c: c.casefold() for c in _EVERY if c.casefold() != c}


@cache
def _ascii_forms() -> dict[str, str]:
    """Characters beyond ASCII with the ASCII part of their compatibility decomposition, where they have one."""
    said = ((c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) for c in _EVERY[128:])
    return {c: x for c, x in said if x}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    """Each character replaced by its entry. One-to-one entries are a translate(); texts with a longer one are taken apart."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    longer = {k: v for k, v in table.items() if len(v) > 1}
    entries = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in longer.items())), F.lit("\x01"), F.lit("\x02"))  # a constant when the plan is made
    apart = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(entries, x), x)), "")
    has = c.rlike("[" + "".join(f"\\x{{{ord(k):x}}}" for k in longer) + "]")
    return F.translate(F.when(has, apart).otherwise(c), "".join(single), "".join(single.values()))


def case_folded(c: Column) -> Column:
    """Full case folding: ß as ss, the ligature fi as f and i, capitals of all scripts."""
    plain = c.rlike(r"^[\x00-\x7F]*\z")
    return F.when(plain, F.lower(c)).otherwise(_mapped(c, _case_folds()))


def ascii_only(c: Column) -> Column:
    """The compatibility decomposition without what is not ASCII. Marks that it moves are none, so characters stand for themselves."""
    return F.regexp_replace(_mapped(c, _ascii_forms()), r"[^\x00-\x7F]+", "")
