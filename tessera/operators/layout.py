"""Layout reconstruction from positioned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_noise(x: Column) -> Column:
    """Blank, or only digits, dashes, dots and the letters of a page mark (a fixed pattern)."""
    return F.rlike(x, F.lit(r"(?U)^[\s\d\-–—./стрСтр]*$"))


def repeated_edges(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, key, n): keys of edge lines (text with digits as #) seen on 3 pages or 30 % of them. lines: doc, page, text,
    y0, y1, height."""
    key = F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"\d+", "#")
    edge = (F.col("y1") < F.col("height") * 0.08) | (F.col("y0") > F.col("height") * 0.9)
    pages = lines.groupBy(doc).agg(F.countDistinct("page").alias("pages"))
    counts = lines.filter(edge).select(doc, key.alias("key")).filter("key <> ''").groupBy(doc, "key").agg(F.count("*").alias("n"))
    return counts.join(pages, doc).filter(F.col("n") >= F.greatest(F.lit(3.0), F.col("pages") * 0.3)).select(doc, "key", "n")


def without_edges(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines without noise and repeated lines at the edges of pages. Lines are read more than once, so the caller stores them;
    only those at the edges meet the repeated ones."""
    key = F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"\d+", "#")
    edge = (F.col("y1") < F.col("height") * 0.08) | (F.col("y0") > F.col("height") * 0.9)
    rows, at_edge = lines.filter(~(edge & is_noise(F.col("text")))), F.coalesce(edge, F.lit(False))
    often = repeated_edges(lines, doc).select(doc, F.col("key").alias("__key"))
    kept = rows.filter(at_edge).withColumn("__key", key).join(often, [doc, "__key"], "left_anti").select(lines.columns)
    return rows.filter(~at_edge).unionByName(kept)


def outside_tables(lines: DataFrame, tables: DataFrame, *page: str) -> DataFrame:
    """lines of which no table box of the page covers over half. Both have x0, y0, x1, y1."""
    box = tables.select(*page, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.least("x1", "t_x1") - F.greatest("x0", "t_x0")
    high = F.least("y1", "t_y1") - F.greatest("y0", "t_y0")
    same = [lines[c] == box[c] for c in page]
    over = (wide > 0) & (high > 0) & (wide * high > (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 0.5)
    return lines.join(box, [*same, over], "left_anti")


def reading_order(y0: Column, x0: Column) -> list[Column]:
    """Sort keys: rows of three units, then left to right."""
    return [F.bround(y0 / 3), x0]


def merged_lines(lines: DataFrame, *page: str) -> DataFrame:
    """Pieces of one text line joined: (page, line, text, x0, x1, y0, two). A piece joins the line before it if their tops
    differ by less than 2.5 and it starts no more than 2 left of that line's end; `two` tells a gap over 20."""
    items = F.sort_array(F.collect_list(F.struct(F.bround(F.col("y0") / 3).alias("row"), "x0", "y0", "x1", "text", "two")))
    groups = lines.groupBy(*page).agg(items.alias("items"))
    kind = "array<struct<text:string,x0:double,x1:double,y0:double,two:boolean>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast(kind[6:-1]).alias("cur"))
    alone = lambda p: F.struct(p["text"].alias("text"), p["x0"].alias("x0"), p["x1"].alias("x1"), p["y0"].alias("y0"), p["two"].alias("two"))

    def step(s: Column, p: Column) -> Column:
        c = s["cur"]
        joins = F.coalesce((F.abs(c["y0"] - p["y0"]) < 2.5) & (p["x0"] >= c["x1"] - 2), F.lit(False))
        both = F.struct(F.concat(c["text"], F.lit(" "), p["text"]).alias("text"), c["x0"].alias("x0"), p["x1"].alias("x1"), c["y0"].alias("y0"), (c["two"] | p["two"] | (p["x0"] - c["x1"] > 20)).alias("two"))
        return F.struct(F.when(joins | c.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(c))).alias("done"), F.when(joins, both).otherwise(alone(p)).alias("cur"))

    out = F.aggregate("items", zero, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
    return groups.select(*page, F.posexplode(out).alias("line", "l")).select(*page, F.col("line").cast("long").alias("line"), "l.*")


def form_runs(lines: DataFrame, *page: str) -> DataFrame:
    """(page, first, last) of runs of two-column lines: two or more, each within three sizes of the one before.

    lines: page, line, two, y0, y1, size.
    """
    two = lines.filter("two")
    w = Window.partitionBy(*page).orderBy("line")
    far = F.coalesce(F.col("y0") - F.lag("y1").over(w) > F.lag("size").over(w) * 3, F.lit(True))
    runs = two.withColumn("__new", far.cast("int")).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*page, "__run").agg(F.min("line").alias("first"), F.max("line").alias("last")).filter("last > first").drop("__run")


def margins(lines: DataFrame, *page: str) -> DataFrame:
    """(page, left, right): the x0 a tenth up from the least, the x1 a tenth down from the most."""
    ranked = F.sort_array(F.collect_list("x0")), F.sort_array(F.collect_list("x1"))
    rows = lines.groupBy(*page).agg(ranked[0].alias("a"), ranked[1].alias("b"))
    tenth = F.floor(F.size("a") / 10).cast("int")
    return rows.select(*page, F.element_at("a", tenth + 1).alias("left"), F.element_at("b", -F.greatest(F.lit(1), tenth)).alias("right"))


def joined(before: Column, after: Column) -> Column:
    """Two lines of one paragraph: a hyphen at the end goes, unless it is that of a compound, else a space between (fixed
    patterns)."""
    a, b = F.regexp_replace(before, r"(?U)\s+$", ""), F.regexp_replace(after, r"(?U)^\s+", "")
    small = F.rlike(b, F.lit("^[а-яё]"))
    compound = F.rlike(a, F.lit("[а-яё]{4,}(?:ико|но)-$")) & small
    broken = F.rlike(a, F.lit("[а-яёa-z]-$")) & small
    return F.when(compound, F.concat(a, b)).when(broken, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def paragraph_text(lines: Column) -> Column:
    """Lines of one paragraph joined in order."""
    return F.aggregate(lines, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(joined(s, x)))


def cell(x: Column) -> Column:
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "([а-яёa-z])-\n([а-яё])", "$1$2")
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")


def pruned_table(rows: Column) -> Column:
    """Array of arrays of cells: cleaned, rows without text dropped, then columns empty in every row, short rows filled."""
    rows = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    columns = F.filter(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.exists(rows, lambda r: F.coalesce(F.get(r, j), F.lit("")) != ""))
    return F.transform(rows, lambda r: F.transform(columns, lambda j: F.coalesce(F.get(r, j), F.lit(""))))


def merge_adjacent(rows: DataFrame, group: str, order: str, kind: str, text: str, sep: str = "\n") -> DataFrame:
    """(group, island, kind, n, text): neighbouring rows of one kind joined."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w))
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(group, "island").agg(F.first(kind).alias(kind), F.count("*").alias("n"), F.array_join(texts, sep).alias(text))


def docx_parts(blocks: Column, per_part: int = 10) -> Column:
    """Array of (label, text) from an array of (kind, text) blocks: a part ends at so many blocks, before an appendix and
    before a roman heading; its label names the appendix, the section and the first numbered point."""
    part = "array<struct<label:string,text:string>>"
    zero = F.struct(F.array().cast(part).alias("out"), F.array().cast("array<string>").alias("buf"), F.lit("").alias("app"), F.lit("").alias("sec"), F.lit("").alias("pt"))

    def flushed(s: Column) -> Column:
        names = F.array_join(F.filter(F.array(s["app"], s["sec"]), lambda x: x != ""), ", ")
        label = F.concat(F.when(names == "", "начало документа").otherwise(names), F.when(s["pt"] == "", "").otherwise(F.concat(F.lit(", с п. "), s["pt"])))
        one = F.array(F.struct(label.alias("label"), F.array_join(s["buf"], "\n").alias("text")))
        return F.when(F.size(s["buf"]) > 0, F.concat(s["out"], one)).otherwise(s["out"])

    def step(s: Column, b: Column) -> Column:
        para, t = b["kind"] == "p", b["text"]
        appendix = F.when(para, F.regexp_extract(t, r"^Приложение N\s*(\d+)", 1)).otherwise("")
        section = para & (appendix == "") & F.rlike(t, F.lit(r"^[IVX]+\.\s")) & (F.length(t) < 160)
        cut = (appendix != "") | section
        buf = F.when(cut, F.array().cast("array<string>")).otherwise(s["buf"])
        app = F.when(appendix != "", F.concat(F.lit("Приложение N "), appendix)).otherwise(s["app"])
        sec = F.when(appendix != "", "").when(section, F.concat(F.lit("раздел "), F.regexp_replace(t, ",+$", ""))).otherwise(s["sec"])
        pt = F.when(cut, "").otherwise(s["pt"])
        point = F.when(para, F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\.?\s", 1)).otherwise("")
        pt = F.when((pt == "") & (point != ""), point).otherwise(pt)
        out = F.when(cut, flushed(s)).otherwise(s["out"])
        now = F.struct(out.alias("out"), F.concat(buf, F.array(t)).alias("buf"), app.alias("app"), sec.alias("sec"), pt.alias("pt"))
        full = F.struct(flushed(now).alias("out"), F.array().cast("array<string>").alias("buf"), app.alias("app"), sec.alias("sec"), F.lit("").alias("pt"))
        return F.when(F.size(now["buf"]) >= per_part, full).otherwise(now)

    return F.aggregate(blocks, zero, step, flushed)


def sidecar_parts(x: Column) -> Column:
    """Array of (label, text) from a text with `=== стр. N ===` lines; what stands before the first is dropped."""
    mark = r"(?m)^=== (?:стр\. \d+) ===[ \t\r]*$"
    labels = F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^=== (стр\. \d+) ===[ \t\r]*$"), F.lit(1)), lambda v: v)
    texts = F.slice(F.split(x, mark, -1), 2, F.size(labels) + 1)
    return F.zip_with(labels, texts, lambda a, b: F.struct(a.alias("label"), b.alias("text")))
