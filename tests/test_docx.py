"""A word processor's file, made here, to HTML."""

import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import docx, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="a"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="1"><w:name w:val="heading 1"/><w:pPr><w:jc w:val="center"/></w:pPr></w:style>
<w:style w:type="character" w:default="1" w:styleId="c"><w:name w:val="title of letters"/><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="Strong"/><w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:b/></w:rPr></w:style></w:styles>"""


def p(text, properties="", run=""):
    return f"<w:p w:rsidR='0'><w:pPr>{properties}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space='preserve'>{text}</w:t></w:r></w:p>"


def tc(text, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{''.join(p(t) for t in text.split('/'))}</w:tc>"


MERGED = (
    "<w:tbl><w:tblPr/><w:tr>" + tc("широкая &lt;", '<w:gridSpan w:val="2"/>') + tc("высокая/ячейка", '<w:vMerge w:val="restart"/>') + "</w:tr>"
    "<w:tr w:rsidR='1'>" + tc("а") + tc(" /б") + tc("", "<w:vMerge/>") + "</w:tr><w:tr>" + tc("в") + tc("г") + tc("д") + "</w:tr></w:tbl>"
)
BODY = [
    (p("Первый  раздел ", '<w:pStyle w:val="1"/>'), "<h3>Первый раздел</h3>"),
    (p("ГЛАВА", '<w:pStyle w:val="1"/>'), "<h2>ГЛАВА</h2>"),
    (p("обычный &amp; текст"), "<p>обычный &amp; текст</p>"),
    ("<w:p/>", None),
    (p("  "), None),
    (p("середина", '<w:jc w:val="center"/>'), '<p class="c">середина</p>'),
    (p("СЕРЕДИНА", '<w:jc w:val="center"/>'), "<h2>СЕРЕДИНА</h2>"),
    (p("справа", '<w:jc w:val="right"/>'), '<p class="r">справа</p>'),
    (p("жирный", "", "<w:b/>"), "<p>жирный</p>"),
    (p("ЖИРНЫЙ", "", "<w:b/>"), "<h2>ЖИРНЫЙ</h2>"),
    (p("стиль", '<w:pStyle w:val="B"/>'), "<h3>стиль</h3>"),
    (p("не жирный", '<w:pStyle w:val="B"/>', '<w:b w:val="0"/>'), '<p class="c">не жирный</p>'),
    ("<w:p><w:r><w:t>до</w:t><w:tab/><w:t>после</w:t><w:br/></w:r><w:r><w:t>строка</w:t></w:r></w:p>", "<p>до после строка</p>"),
    (MERGED, '<div class="tbl"><table><tr><td>широкая &lt;</td><td>высокая<br>ячейка</td></tr><tr><td>а</td><td>б</td><td>высокая<br>ячейка</td></tr><tr><td>в</td><td>г</td><td>д</td></tr></table></div>'),
    (p("конец"), "<p>конец</p>"),
]


def package(body, styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", styles)
    return out.getvalue()


def test_docx_from_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package("".join(x for x, _ in BODY)))
    (tmp_path / "b.docx").write_bytes(package(p("без стилей"), None))
    (tmp_path / "c.docx").write_bytes(b"no package")
    found = files.scan(spark, str(tmp_path))
    got = {r.file: r.html for r in docx.files_html(found.select("file", "content")).collect()}
    assert got == {"a.docx": "\n".join(h for _, h in BODY if h), "b.docx": "<p>без стилей</p>", "c.docx": ""}


def test_cells_keep_their_identity(spark):
    df = spark.createDataFrame([(f"<w:body>{MERGED}</w:body>",)], "x string")
    (table,) = df.select(docx.blocks(F.col("x"), F.lit(None).cast("string")).alias("b")).first().b
    assert [[c.id for c in row] for row in table.rows] == [["0:0", "0:1"], ["1:0", "1:1", "0:1"], ["2:0", "2:1", "2:2"]]
