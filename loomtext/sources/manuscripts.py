"""Manuscript files (txt, epub, docx) as BLOCK rows.

Text files are split by built-in functions. The zip formats are read whole, one file a row, by the standard library.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import InvalidFile, UnsupportedFormat
from loomtext.functions import text as T
from loomtext.schemas import BLOCK, SOURCE_FORMATS
from loomtext.sources.lines import only_separators
from loomtext.sources.markup import parsed


def files(spark: SparkSession, path: str) -> DataFrame:
    """manuscript_id (the path), content, format of the files under a path or pattern."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("manuscript_id"), "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"))


def decoded(content: str) -> Column:
    """UTF-8 if it is valid, else Latin-1; without a byte order mark."""
    plain = F.col(content).cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(F.col(content), "ISO-8859-1")), r"^\x{FEFF}", "")


def text_blocks(texts: DataFrame) -> DataFrame:
    """BLOCK rows of (manuscript_id, text): between the edition's markers, cut at empty lines."""
    whole = F.regexp_replace("text", r"\r\n?", "\n")
    begun = F.regexp_replace(whole, r"(?is)\A.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG(?-s:.*?)\*\*\*", "")
    ended = F.regexp_replace(begun, r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG(?-s:.*?)\*\*\*.*\z", "")
    parts = texts.select("manuscript_id", F.posexplode(F.split(ended, r"(?U)\n\s*\n")).alias("pos", "raw")).withColumn("raw", T.strip(F.col("raw"))).where("raw <> ''")
    raw, single = F.col("raw"), ~F.col("raw").contains("\n")
    kind = F.when(single & T.is_separator(raw), "separator").when(single & (T.is_chapter_heading(raw) | T.is_special_heading(raw)), "heading").otherwise("paragraph")
    joined = F.array_join(F.transform(F.split(raw, "\n"), T.strip), " ")
    none = F.lit(None).cast("string")
    return parts.select("manuscript_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), F.when(kind == "paragraph", joined).otherwise(raw).alias("text"), F.when(kind == "heading", 1).alias("level"), none.alias("style"), none.alias("source_role"))


_TAG = re.compile(r"^\{[^}]*\}")


def _local(element: ElementTree.Element) -> str:
    return _TAG.sub("", element.tag) if isinstance(element.tag, str) else ""


def epub_blocks(content: bytes) -> tuple[str | None, list[tuple]]:
    """Title and blocks (kind, text, level, style, source_role), by the order of the spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package_path = next(e.attrib["full-path"] for e in container.iter() if _local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(package_path))
        base = posixpath.dirname(package_path)
        at = lambda href: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
        elements = [(e, _local(e)) for e in package.iter()]
        title = next((e.text.strip() for e, n in elements if n == "title" and e.text and e.text.strip()), None)
        items = {e.attrib.get("id"): e.attrib for e, n in elements if n == "item"}
        roles = {at(e.attrib.get("href", "")): e.attrib.get("type") for e, n in elements if n == "reference"}
        blocks = []
        for e, n in elements:
            item = items.get(e.attrib.get("idref")) if n == "itemref" else None
            if item and item.get("media-type", "").endswith(("xhtml+xml", "html")):
                path = at(item["href"])
                blocks += [(kind, text, level, None, roles.get(path)) for kind, text, level in parsed(z.read(path).decode("utf-8", "replace"))]
    return title, blocks


def docx_blocks(content: bytes) -> tuple[str | None, list[tuple]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter():
                if _local(style) == "style":
                    own = {_local(e): e for e in style}
                    ident = next((v for k, v in style.attrib.items() if k.endswith("styleId")), "")
                    names[ident] = next(iter(own["name"].attrib.values()), ident) if "name" in own else ident
        title = None
        if "docProps/core.xml" in z.namelist():
            title = next((e.text.strip() for e in ElementTree.fromstring(z.read("docProps/core.xml")).iter() if _local(e) == "title" and e.text and e.text.strip()), None)
    blocks = []
    for p in (e for e in body.iter() if _local(e) == "p"):
        values = {_local(e): next((v for k, v in e.attrib.items() if k.endswith("val")), "") for e in p.iter() if _local(e) in ("pStyle", "jc")}
        style = names.get(values.get("pStyle", ""), values.get("pStyle", ""))
        text = "".join(e.text or "" for e in p.iter() if _local(e) == "t").strip()
        low = style.lower()
        if text and (low.startswith("heading") or low in ("title", "título", "titulo")):
            digits = re.sub(r"\D", "", style)
            blocks.append(("heading", text, int(digits) if digits else 1, style, None))
        elif "separator" in low or "separador" in low or (values.get("jc") == "center" and (not text or only_separators(text))) or only_separators(text):
            blocks.append(("separator", text or "***", None, style or None, None))
        elif not text:
            continue
        else:
            blocks.append(("paragraph", text, None, style or None, None))
    return title, blocks


PARSED = "manuscript_id string, title string, error string, blocks array<struct<pos:bigint,kind:string,text:string,level:int,style:string,source_role:string>>"


def zipped(found: DataFrame) -> DataFrame:
    """manuscript_id, title, error and blocks of the epub and docx files; a file that can't be read has an error and no blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("pos", "kind", "text", "level", "style", "source_role")
        for batch in batches:
            out = []
            for ident, content, kind in zip(batch["manuscript_id"], batch["content"], batch["format"], strict=True):
                try:
                    title, blocks = epub_blocks(content) if kind == "epub" else docx_blocks(content)
                    error = None if blocks else "no text"
                except (zipfile.BadZipFile, zlib.error, LookupError, StopIteration, ElementTree.ParseError, ValueError, NotImplementedError, RuntimeError) as e:
                    title, blocks, error = None, [], f"{type(e).__name__}: {e}"
                out.append((ident, title, error, [dict(zip(names, (pos, *b), strict=True)) for pos, b in enumerate(blocks)]))
            yield pd.DataFrame(out, columns=["manuscript_id", "title", "error", "blocks"])

    return found.where(F.col("format").isin("epub", "docx")).select("manuscript_id", "content", "format").mapInPandas(run, PARSED)


def parsed_files(found: DataFrame) -> DataFrame:
    """PARSED rows of files(), one a file, with the code of what is wrong with it; blocks of text files are left to blocks()."""
    none = F.lit(None).cast("string")
    text = F.col("content").cast("string")
    blank = (F.length("content") == 0) | ~text.rlike(r"(?U)\S")
    other = found.where(~F.col("format").isin("epub", "docx"))
    code = F.when(~F.col("format").isin(*SOURCE_FORMATS), UnsupportedFormat.code).when(blank, InvalidFile.code)
    plain = other.select("manuscript_id", none.alias("title"), code.alias("code"), F.when(code.isNotNull(), "unknown format or no text").alias("error"))
    return zipped(found).withColumn("code", F.when(F.col("error").isNotNull(), InvalidFile.code)).unionByName(plain, allowMissingColumns=True)


def blocks(found: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """BLOCK rows of files(), of those that can be read; each kind of format has its own branch of the plan.

    parsed: parsed_files() of the same files, where it is already at hand.
    """
    texts = text_blocks(found.where(F.col("format") == "txt").select("manuscript_id", decoded("content").alias("text")))
    zips = zipped(found) if parsed is None else parsed
    return texts.unionByName(zips.select("manuscript_id", F.explode("blocks").alias("b")).select("manuscript_id", "b.*"))
