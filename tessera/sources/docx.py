"""Word processors' files to typed blocks and HTML: the package's XML is read with Spark's XPath functions.

Unzipping is the only Python (one file of the package). Paragraphs and tables of the body keep their order; a paragraph has its
text, the name of its style, its alignment and whether all of it is bold, each from its own properties or else its style's.
A table's cells have an identity: one that is merged over columns is one cell, and one that is merged over rows is the cell
above wherever it goes on, as it is shown in each of its rows.

Defined results: a file without a body, or that is no package, has no blocks; a paragraph in a table inside a cell belongs to the
cell that begins first.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.html import docx_paragraph
from tessera.functions.text import let
from tessera.operators.pages import docx_table_html


def member(name: str):
    """A file of a package as text; null if there is none."""

    @F.pandas_udf(StringType())
    def run(content: pd.Series) -> pd.Series:
        def read(data):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as package:
                    return package.read(name).decode()
            except (zipfile.BadZipFile, KeyError, TypeError):
                return None

        return content.map(read)

    return run


def _elements(x: Column, *names: str) -> Column:
    """These elements of a piece of XML, none of them inside another."""
    one = "|".join(rf"<w:{n}(?: [^>]*)?/>|<w:{n}(?: [^>]*)?>.*?</w:{n}>" for n in names)
    return F.regexp_extract_all(x, F.lit(f"(?s)({one})"), F.lit(1))


def _lacks(x: Column, what: str) -> Column:
    """XML that does not hold this text has no element or attribute of the name: it need not be parsed for it."""
    return ~F.contains(x, F.lit(what))


def _value(x: Column, name: str, of: str = "w:val") -> Column:
    """An attribute of the first element of this name; empty without one."""
    return F.when(_lacks(x, f"<w:{name}") | _lacks(x, of), "").otherwise(F.xpath_string(x, F.lit(f'//*[name()="w:{name}"][1]/@*[name()="{of}"]')))


def _has(x: Column, name: str) -> Column:
    return F.when(_lacks(x, f"<w:{name}"), False).otherwise(F.xpath_boolean(x, F.lit(f'//*[name()="w:{name}"]')))


def _switch(x: Column, name: str) -> Column:
    """True, false, or null where the element is missing."""
    return F.when(_has(x, name), ~_value(x, name).isin("0", "false", "none", "off"))


def _text(x: Column) -> Column:
    """Texts in order; a tab or line break is a character."""
    marked = F.regexp_replace(F.regexp_replace(x, r"<w:(?:br|cr)(?: [^>]*)?/>", "<w:t>&#10;</w:t>"), r"<w:tab/>", "<w:t>&#9;</w:t>")
    return F.array_join(F.xpath(marked, F.lit('//*[name()="w:t"]/text()')), "")


def styles_of(xml: Column) -> Column:
    """Array of (id, name, align, bold, usual): the paragraph styles; usual: that of paragraphs without one."""
    each = F.filter(_elements(F.coalesce(xml, F.lit("")), "style"), lambda s: _value(s, "style", "w:type") == "paragraph")
    return F.transform(each, lambda s: F.struct(_value(s, "style", "w:styleId").alias("id"), _value(s, "name").alias("name"), _value(s, "jc").alias("align"), _switch(s, "b").alias("bold"), _value(s, "style", "w:default").isin("1", "true").alias("usual")))


def _paragraph(x: Column, styles: Column) -> Column:
    named = _value(x, "pStyle")
    style = F.coalesce(F.get(F.filter(styles, lambda s: s["id"] == named), F.lit(0)), F.get(F.filter(styles, lambda s: s["usual"]), F.lit(0)))

    def made(s: Column) -> Column:
        runs = F.filter(_elements(x, "r"), lambda r: F.rlike(_text(r), F.lit(r"(?U)\S")))
        bold = lambda r: F.coalesce(_switch(r, "b"), s["bold"], F.lit(False))
        text = F.trim(F.regexp_replace(_text(x), r"(?U)\s+", " "))
        align = F.upper(F.coalesce(F.nullif(_value(x, "jc"), F.lit("")), s["align"], F.lit("")))
        return F.struct(text.alias("text"), F.coalesce(s["name"], F.lit("")).alias("style"), align.alias("align"), ((F.size(runs) > 0) & F.forall(runs, bold)).alias("bold"))

    return let(style, made)


CELLS = "array<struct<id:string,paragraphs:array<string>>>"


def _table(x: Column) -> Column:
    """Rows of cells (id, paragraphs)."""
    cell = lambda c: F.struct(F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.nullif(_value(c, "gridSpan"), F.lit("")), F.lit("999")).cast("int"), F.lit(1))).alias("span"), (_has(c, "vMerge") & (_value(c, "vMerge") != "restart")).alias("goes_on"), F.transform(_elements(c, "p"), _text).alias("paragraphs"))
    rows = F.transform(_elements(x, "tr"), lambda r, i: F.struct(i.alias("i"), F.transform(_elements(r, "tc"), cell).alias("cells")))
    zero = F.struct(F.array().cast(CELLS).alias("above"), F.array().cast(f"array<{CELLS}>").alias("out"))

    def step(s: Column, row: Column) -> Column:
        cells = row["cells"]
        before = lambda j: F.aggregate(F.slice(cells, 1, j), F.lit(0), lambda n, c: n + c["span"])
        own = lambda c, j: F.struct(F.concat(row["i"].cast("string"), F.lit(":"), j.cast("string")).alias("id"), c["paragraphs"].alias("paragraphs"))
        shown = F.transform(cells, lambda c, j: F.when(c["goes_on"], F.coalesce(F.get(s["above"], before(j)), own(c, j))).otherwise(own(c, j)))
        return let(shown, lambda now: F.struct(F.flatten(F.zip_with(now, cells, lambda n, c: F.array_repeat(n, c["span"]))).alias("above"), F.concat(s["out"], F.array(now)).alias("out")))

    return F.aggregate(rows, zero, step, lambda s: s["out"])


def blocks(document: Column, styles: Column) -> Column:
    """Array of (kind, p, rows) of a document's XML: paragraphs (text, style, align, bold) and tables of cells, in order."""
    body = F.regexp_extract(F.coalesce(document, F.lit("")), r"(?s)<w:body>(.*)</w:body>", 1)

    def block(x: Column, found: Column) -> Column:
        table = F.startswith(x, F.lit("<w:tbl"))
        return F.struct(F.when(table, "t").otherwise("p").alias("kind"), F.when(~table, _paragraph(x, found)).alias("p"), F.when(table, _table(x)).alias("rows"))

    return let(styles_of(styles), lambda found: F.transform(_elements(body, "tbl", "p"), lambda x: block(x, found)))


def document_html(document: Column, styles: Column) -> Column:
    """The blocks in one style, a line each; blank paragraphs are left out."""
    shown = lambda b: F.when(b["kind"] == "t", docx_table_html(b["rows"])).when(b["p"]["text"] != "", docx_paragraph(b["p"]["text"], b["p"]["style"], b["p"]["align"], b["p"]["bold"]))
    return F.array_join(F.filter(F.transform(blocks(document, styles), shown), lambda h: h.isNotNull()), "\n")


def files_html(files: DataFrame) -> DataFrame:
    """files (content, and more) with the HTML of each package in place of its content."""
    rest = [c for c in files.columns if c != "content"]
    opened = files.select(*rest, member("word/document.xml")("content").alias("_document"), member("word/styles.xml")("content").alias("_styles"))
    return opened.select(*rest, document_html(F.col("_document"), F.col("_styles")).alias("html"))
