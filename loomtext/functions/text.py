"""Text expressions: white space, normalisation, snippets, headings, separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four information separators.
SPACE = r"[\s\x1c-\x1f]"

#: The lines that structure a narrative, in English and Spanish.
SEPARATOR = r"^[*·~—#§•\-–_ \t]+\z"
CHAPTER_HEADING = r"(?iuU)^\s*(?:CHAPTER|CHAP|CAP[IÍ]TULO)\s+(?:[IVXLCDM]+|\d+)\b[.\])\s]*\z"
SPECIAL_HEADING = r"(?iuU)^\s*(?:PROLOGUE|PRÓLOGO|PROLOGO|EPILOGUE|EPÍLOGO|EPILOGO|INTERLUDE|INTERLUDIO)\b[.\s:]*\z"
LICENSE_MARKERS = ("project gutenberg", "produced by")
COPYRIGHT_MARKERS = ("copyright", "all rights reserved")
CONTENTS_MARKERS = ("list of illustrations", "table of contents", "heading to chapter", "tailpiece")
CONTENTS_TITLES = ("contents", "índice", "indice")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def normalized(c: Column) -> Column:
    """One kind of line break, single blanks, no blanks at line ends, at most one empty line, no blanks around."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, rf"(?U)[{SPACE}&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def snippet(c: Column, n: int = 120) -> Column:
    return F.substring(F.array_join(words(c), " "), 1, n)


def is_separator(c: Column) -> Column:
    return strip(c).rlike(SEPARATOR)


def is_chapter_heading(c: Column) -> Column:
    return c.rlike(CHAPTER_HEADING)


def is_special_heading(c: Column) -> Column:
    return c.rlike(SPECIAL_HEADING)


def heading_kind(c: Column) -> Column:
    low = F.lower(c)
    special = F.when(low.contains("prol") | low.contains("pról"), "prologue").when(low.contains("epil") | low.contains("epíl"), "epilogue").when(low.contains("interl"), "interlude").otherwise("other")
    return F.when(is_special_heading(c), special).otherwise("chapter")


def heading_title(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), rf"(?U)[.\])\s\x1c-\x1f]+\z", "")
    return F.coalesce(F.nullif(bare, F.lit("")), strip(c))


def paratext_kind(c: Column) -> Column:
    """struct(kind, detected_by) of a non-narrative text; the first match wins."""
    low = F.lower(c)
    has = lambda marks: F.array_contains(F.array(*[low.contains(m) for m in marks]), True)
    said = lambda kind, by: F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("detected_by"))
    return (
        F.when(has(LICENSE_MARKERS), said("license", "gutenberg_marker"))
        .when(has(COPYRIGHT_MARKERS), said("license", "copyright_keyword"))
        .when(has(CONTENTS_MARKERS) | strip(low).isin(*CONTENTS_TITLES), said("toc", "toc_heuristic"))
        .otherwise(said("frontmatter", "frontmatter_position"))
    )


def offset_of(text: Column, surface: Column) -> Column:
    """Start of the first occurrence from 0; null if there is none."""
    return F.nullif(F.instr(text, surface), F.lit(0)) - 1
