"""Readers of exported packages (ZIP) and of document trees (JSON)."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from foliant.functions import doc_trees
from foliant.operators.documents import HANDED_CHARS, HANDED_ROWS, spread

_PIECE_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

#: Bytes of a package that is read, and of its page once it is unpacked; larger ones give an error.
PACKAGE_BYTES, PAGE_BYTES = 10_485_760, 104_857_600
#: What reading a damaged package may raise.
DAMAGED = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError, OverflowError)


def packages(spark: SparkSession, path: str) -> DataFrame:
    """ZIP packages as a binary table: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)


def entry_name(names: list[str]) -> str | None:
    """The page of a package: index.html, else the first HTML file; paths that leave the package don't count."""
    safe = [n for n in names if not n.startswith(("/", "\\")) and ".." not in n.replace("\\", "/").split("/") and ":" not in n]
    pages = [n for n in safe if n.lower().endswith((".html", ".htm"))]
    return next((n for n in pages if n.lower().rsplit("/", 1)[-1] == "index.html"), pages[0] if pages else None)


def package_pages(found: DataFrame, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Of packages (path, length, content): path, entry, html, error (too_large, bad_package, no_page or null). A page is unpacked up to PAGE_BYTES and no further, whatever its package says."""

    @F.pandas_udf("entry string, html string, error string")
    def read(contents: pd.Series) -> pd.DataFrame:
        out = []
        for data in contents:
            try:
                with zipfile.ZipFile(io.BytesIO(data or b"")) as package:
                    if not (name := entry_name(package.namelist())):
                        out.append((None, None, "no_page"))
                        continue
                    with package.open(name) as page:
                        html = page.read(PAGE_BYTES + 1)
                    out.append((name, html.decode("utf-8", "replace"), None) if len(html) <= PAGE_BYTES else (None, None, "too_large"))
            except DAMAGED:
                out.append((None, None, "bad_package"))
        return pd.DataFrame(out, columns=["entry", "html", "error"])

    small = found.filter(F.col("length") <= limit).withColumn("r", read("content")).select("path", "r.*")
    none = F.lit(None).cast("string")
    return small.unionByName(found.filter(F.col("length") > limit).select("path", none.alias("entry"), none.alias("html"), F.lit("too_large").alias("error")))


def styled(content: Column, bold: Column, italic: Column, underline: Column, url: Column) -> Column:
    """A run of text as HTML: escaped, line ends as breaks, without up to two at its end, then bold, italic, underline and link around it from the inside."""
    text = F.regexp_replace(content, r"\n{1,2}\z", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"), ("\n", "<br>\n")):
        text = F.replace(text, F.lit(char), F.lit(name))
    for on, tag in ((bold, "strong"), (italic, "em"), (underline, "u")):
        text = F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    link = F.replace(F.replace(url, F.lit("&"), F.lit("&#038;")), F.lit('"'), F.lit("%22"))
    html = F.when(url.isNotNull(), F.concat(F.lit('<a href="'), link, F.lit('">'), text, F.lit("</a>"))).otherwise(text)
    return F.when(F.coalesce(F.regexp_replace(content, r"\n{1,2}\z", ""), F.lit("")) == "", "").otherwise(html)


def element_count(document: Column) -> Column:
    """How many elements the parts of a document tree (JSON) have, one at least: those of its tabs at any depth, or its own where it has no tabs."""

    @F.pandas_udf("int")
    def counted(trees: pd.Series) -> pd.Series:
        return trees.map(doc_trees.element_count, na_action=None)

    return counted(document)


def paragraphs(documents: DataFrame, key: str = "doc_id", column: str = "document") -> DataFrame:
    """One row for each paragraph of document trees (JSON): key, pos, tab, depth, style, list_key, text, objects. What can't be read has none."""

    @F.pandas_udf("array<struct<tab:string,depth:int,style:string,list_key:string,text:string,objects:string>>")
    def parsed(trees: pd.Series) -> pd.Series:
        return trees.map(doc_trees.paragraphs, na_action=None)

    return documents.select(key, F.posexplode(parsed(column)).alias("pos", "p")).select(key, "pos", "p.*")


@F.udtf(returnType="pos: int, total: int, html: string, closes: string, error: string")
class DocumentHtml:
    """document_html(tree) in SQL: a document tree (JSON) as a row for each element of its parts, or one with the error bad_tree."""

    def eval(self, document: str):
        yield from _rows(document)


def register(spark: SparkSession) -> None:
    """Makes document_html known to SQL, and document_pieces, whose rows come as one array for each tree, for LATERAL VIEW inline(...): faster where trees are many."""
    spark.udtf.register("document_html", DocumentHtml)
    spark.udf.register("document_pieces", F.arrow_udf(document_pieces, ArrayType(_PIECES)))


_PIECES = StructType().add("pos", "integer").add("total", "integer").add("html", "string").add("closes", "string").add("error", "string")


def document_pieces(trees: pa.Array) -> pa.Array:
    """The rows of document_html of each tree (JSON), as an array."""
    rows, ends = [], [0]
    for tree in trees.to_pylist():
        rows.extend(_rows(tree))
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECES)
    fields = [pa.array(v, t) for v, t in zip(columns, _PIECE_TYPES, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, _PIECES.names))


def html_pieces(documents: DataFrame, key: str = "doc_id", column: str = "document") -> DataFrame:
    """The elements of document trees (JSON) as HTML: key, pos (from 1), total, html, closes (the end tag of the list that is open after it), error. Other columns stay as they are.

    Elements go on in batches of HANDED_ROWS, or fewer long ones."""
    others = [f for f in documents.schema if f.name != column]
    fields = StructType([*others, *_PIECES])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, chars = [], [], 0
            for k, tree in enumerate(batch.column(len(others)).to_pylist()):
                for row in _rows(tree):
                    at.append(k)
                    rows.append(row)
                    chars += len(row[2] or "")
                    if len(at) >= HANDED_ROWS or chars >= HANDED_CHARS:
                        yield handed(batch, at, rows)
                        at, rows, chars = [], [], 0
            if at:
                yield handed(batch, at, rows)

    def handed(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        taken = [batch.column(k).take(pa.array(at)) for k in range(len(others))]
        return pa.RecordBatch.from_arrays([*taken, *[pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)]], fields.names)

    return spread(documents.select(*[f.name for f in others], column)).mapInArrow(found, fields)


def _rows(tree: str | None) -> Iterator[tuple]:
    """The rows of document_html for a tree."""
    found = doc_trees.pieces(tree)
    return iter([(0, 0, None, None, "bad_tree")]) if found is None else ((*piece, None) for piece in found)


def document_html(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of html_pieces each document's HTML: key, html, error. A document without elements has none of html_pieces, and no row."""
    rows = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "html"))).alias("_p"), F.max("error").alias("error"))
    return rows.select(key, F.when(F.col("error").isNull(), F.array_join(F.transform("_p", lambda p: p.html), "")).alias("html"), "error")


def partial_html(pieces: DataFrame, key: str = "doc_id", every: int = 20) -> DataFrame:
    """What is there of a document's HTML after each every-th element and the last, with its open list closed: key, rendered, total, html."""
    rows = pieces.filter("error IS NULL").groupBy(key, "total").agg(F.array_sort(F.collect_list(F.struct("pos", "html", "closes"))).alias("_p"))
    marks = rows.withColumn("_mark", F.explode(F.filter("_p", lambda p: (p.pos % every == 0) | (p.pos >= F.col("total")))))
    so_far = F.array_join(F.transform(F.slice("_p", F.lit(1), F.col("_mark.pos")), lambda p: p.html), "")
    return marks.select(key, F.col("_mark.pos").alias("rendered"), "total", F.concat(so_far, "_mark.closes").alias("html"))
