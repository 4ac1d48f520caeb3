"""Sources and sinks: folders of documents, decoded texts, rule files, a parse cache, JSON, other databases."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import let, lines_of, strip

EXTENSIONS = ("pdf", "docx", "txt", "md")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, stem, ext, sec, length, content): files of the folder and of its folders, one level deep; names that
    start with a dot, and folders that start with a dot or underscore, are left out, and so are empty files, which Spark's
    reader does not list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://")[-1].split(":", 1)[-1]
    rel = F.regexp_replace("path", rf"^.*?\Q{root}\E/", "")
    rows = files.withColumn("rel", rel).filter(F.size(F.split("rel", "/")) <= 2)
    file = F.element_at(F.split("rel", "/"), -1)
    sec = F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1)).otherwise("")
    rows = rows.select("path", file.alias("file"), sec.alias("sec"), "length", "content")
    rows = rows.filter(~F.startswith("file", F.lit(".")) & ~F.rlike("sec", F.lit("^[._]")))
    ext = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    return rows.select("path", "file", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), ext.alias("ext"), "sec", "length", "content")


def supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that can be read, files that are reported and skipped)."""
    ok = F.col("ext").isin(*EXTENSIONS)
    return files.filter(ok), files.filter(~ok)


def _windows_1251(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else bytes(v).decode("cp1251", errors="replace"))


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark at its start, else Windows-1251 (which Spark's own decode() does not know)."""
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.when(valid, content.cast("string")).otherwise(F.pandas_udf(_windows_1251, "string")(F.when(~valid, content)))
    return F.regexp_replace(text, "^\\uFEFF", "")


PARTS = "array<struct<label:string,text:string>>"


def parsed(files: DataFrame) -> DataFrame:
    """(path, parts: array of (label, text), error) of text, PDF and DOCX files. A file that can't be read has no parts and
    says why; a reader's package that is missing is an error of the whole job. PDF and DOCX readers are optional packages."""
    from tessera.operators.layout import docx_parts

    text = files.filter(F.col("ext").isin("txt", "md")).select("path", lines_of(decoded(F.col("content"))).alias("l"))
    n = F.ceil(F.size("l") / 60).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(numbers, lambda k: F.struct(F.concat(F.lit("часть "), k).alias("label"), F.array_join(F.slice("l", (k - 1) * 60 + 1, F.lit(60)), "\n").alias("text")))
    text = text.select("path", parts.alias("parts"), F.lit(None).cast("string").alias("error"))
    pages = _read_each(files.filter("ext = 'pdf'"), _pdf_reader, "array<string>")
    labelled = F.transform("found", lambda t, k: F.struct(F.concat(F.lit("стр. "), k + 1).alias("label"), t.alias("text")))
    blocks = _read_each(files.filter("ext = 'docx'"), _docx_reader, "array<struct<kind:string,rows:array<array<string>>>>")
    read = text.unionByName(pages.select("path", labelled.alias("parts"), "error"))
    return read.unionByName(blocks.select("path", docx_parts(docx_blocks(F.col("found"))).alias("parts"), "error"))


def _read_each(files: DataFrame, reader, kind: str) -> DataFrame:
    """(path, found, error) by a function of a file's bytes, which `reader` makes once in each task."""

    def run(batches):
        read = None
        for batch in batches:
            read = read or reader()
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, read(bytes(content)), None))
                except Exception as error:  # one broken file must not stop the rest
                    rows.append((path, [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "found", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, found {kind}, error string")


def _pdf_reader():
    from pypdf import PdfReader

    return lambda content: [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def _docx_reader():
    """Blocks in the order of the document's body: a paragraph as one cell, a table as its rows of cells, all as they are."""
    from docx import Document
    from docx.oxml.ns import qn
    from docx.table import Table
    from docx.text.paragraph import Paragraph

    def read(content: bytes) -> list[dict]:
        document = Document(io.BytesIO(content))
        make = {qn("w:p"): lambda e: ("p", [[Paragraph(e, document).text]]), qn("w:tbl"): lambda e: ("t", [[c.text for c in r.cells] for r in Table(e, document).rows])}
        found = (make[e.tag](e) for e in document.element.body if e.tag in make)
        return [{"kind": kind, "rows": rows} for kind, rows in found]

    return read


def docx_blocks(found: Column) -> Column:
    """Array of (kind, text) from blocks (kind, rows): paragraphs stripped, blank ones dropped; a table's rows are lines of
    its cells with blanks collapsed, equal neighbours (a merged cell) once."""
    cells = lambda r: collapsed(F.transform(r, lambda c: F.regexp_replace(strip(c), r"(?U)\s+", " ")))
    table = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), " | ")), "\n")
    text = lambda b: F.when(b["kind"] == "p", strip(b["rows"][0][0])).otherwise(table(b["rows"]))
    blocks = F.transform(found, lambda b: F.struct(b["kind"].alias("kind"), text(b).alias("text")))
    return F.filter(blocks, lambda b: (b["kind"] != "p") | (b["text"] != ""))


def collapsed(cells: Column) -> Column:
    """An array without items equal to the one before."""
    return let(cells, lambda xs: F.filter(xs, lambda v, i: (i == 0) | (v != F.get(xs, i - 1))))


def with_scans(parts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """parts (stem, parts), those that are blank throughout replaced by their sidecar's, if there is one."""
    side = sidecars.select("stem", F.col("parts").alias("side"))
    blank = ~F.exists("parts", lambda p: F.rlike(p["text"], F.lit(r"(?U)\S")))
    rows = parts.join(side, "stem", "left")
    return rows.withColumn("parts", F.when(blank & F.col("side").isNotNull(), F.col("side")).otherwise(F.col("parts"))).select(parts.columns)


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content the cache (column key) does not hold; key is the SHA-1 of the content."""
    return files.withColumn("key", F.sha1("content")).join(cache.select("key"), "key", "left_anti")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, *by: str) -> None:
    """Compact JSON lines, other alphabets as they are; by: partition columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 8) -> DataFrame:
    """A database table in ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
