"""Names of characters: folding, honorifics, aliases, similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.characters import ascii_only
from loomtext.functions.text import strip

#: Word lists that decide what a name is.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "lord", "lady", "don", "dona", "senor", "senora", "senorita", "monsieur", "madame", "mademoiselle")
PRONOUNS = (
    "she", "he", "her", "him", "his", "hers", "they", "them", "their", "theirs", "it", "its", "i", "you", "we", "me", "us", "myself", "herself", "himself",
    "ella", "el", "le", "la", "lo", "les", "las", "los", "su", "sus", "yo", "tu", "usted", "ustedes", "nosotros", "nosotras", "ellos", "ellas",
)
KIN = (
    "mother", "father", "mamma", "mama", "papa", "mom", "dad", "parents", "sister", "brother", "aunt", "uncle", "cousin", "niece", "nephew", "wife", "husband", "son", "daughter",
    "child", "children", "family", "friend", "friends", "neighbour", "neighbor", "grandfather", "grandmother", "grandson", "granddaughter", "grandparent",
    "madre", "padre", "hermana", "hermano", "tia", "tio", "prima", "primo", "esposa", "esposo", "marido", "mujer", "hija", "hijo", "amiga", "amigo", "vecina", "vecino", "familia",
    "nina", "nino", "abuelo", "abuela", "nieto", "nieta",
)
ALIAS_PREFIXES = ("my", "your", "her", "his", "their", "our", "the", "that", "this", "mi", "tu", "su", "nuestra", "nuestro", "la", "el", "esa", "ese", "esta", "este")
ARTICLES = ("the", "a", "an", "el", "la", "los", "las", "un", "una", "unos", "unas", "one of the", "one of", "some of the")
COLLECTIVES = ("los", "las", "unos", "unas", "the", "some", "all", "every", "those", "these", "a group", "el grupo", "la multitud", "todos", "todas", "varios", "varias")


def fold_text(text: str) -> str:
    """Compatibility decomposition, ASCII only, case folded, stripped."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().casefold().strip()


def fold(c: Column) -> Column:
    """fold_text() as a built-in expression."""
    plain = c.rlike(r"^[\x00-\x7F]*\z")
    return strip(F.lower(F.when(plain, c).otherwise(ascii_only(c))))


def split_honorific(folded: Column) -> Column:
    """struct(honorific, base) of a folded name. A name that is only an honorific is its own base."""
    pattern = rf"^({'|'.join(HONORIFICS)})\.?\s+(\S.*)\z"
    title = F.regexp_extract(folded, f"(?is){pattern}", 1)
    return F.struct(title.alias("honorific"), F.when(title != "", strip(F.regexp_extract(folded, f"(?is){pattern}", 2))).otherwise(folded).alias("base"))


def _without(words: tuple[str, ...], c: Column) -> Column:
    return F.regexp_replace(c, rf"(?iuU)^(?:{'|'.join(words)})\s+", "")


def is_collective(c: Column) -> Column:
    return strip(c).rlike(rf"(?iuU)^(?:{'|'.join(COLLECTIVES)})\b")


def is_kin_descriptor(c: Column) -> Column:
    """<kin> de/of <x>, or <x>'s <kin> with an ASCII apostrophe."""
    of = F.regexp_extract(c, r"(?iuU)^(\S+)\s+(?:de|of)\s+\S+", 1)
    possessive = F.regexp_extract(c, r"(?iuU)^.+'s\s+(\S+)\s*\z", 1)
    return fold(of).isin(*KIN) | fold(possessive).isin(*KIN)


def is_unnamed(c: Column) -> Column:
    bare = _without(ARTICLES, strip(c))
    capital = F.exists(F.split(bare, r"(?U)\s+"), lambda w: w.rlike(r"^[\p{Lu}]"))
    return (bare == "") | is_kin_descriptor(bare) | ~capital


def is_valid_alias(c: Column) -> Column:
    folded = fold(c)
    return (folded != "") & ~folded.isin(*PRONOUNS) & ~strip(_without(ALIAS_PREFIXES, folded)).isin(*KIN) & ~is_unnamed(c)


def similarity(a: Column, b: Column) -> Column:
    """struct(similar, auto) of two split names: whether they may be one person, and whether without asking a human."""
    x, y = a["base"], b["base"]
    short, long = F.when(F.length(x) < F.length(y), x).otherwise(y), F.when(F.length(x) < F.length(y), y).otherwise(x)
    tokens = lambda c: F.split(c, r"\s+")
    last = lambda c: F.element_at(tokens(c), -1)
    many = lambda c: F.size(tokens(c)) > 1
    given = lambda c: F.slice(tokens(c), 1, F.size(tokens(c)) - 1)
    said = lambda similar, auto: F.struct(F.lit(similar).alias("similar"), auto.alias("auto"))
    return (
        F.when((a["honorific"] != "") & (b["honorific"] != "") & (a["honorific"] != b["honorific"]), said(False, F.lit(False)))
        .when(x == y, said(True, F.lit(True)))
        .when(F.contains(x, y) | F.contains(y, x), said(True, ~(many(long) & (short == last(long)))))
        .when(many(x) & many(y) & (last(x) == last(y)), said(True, given(x) == given(y)))
        .otherwise(said(False, F.lit(False)))
    )
