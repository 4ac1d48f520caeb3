"""Rules for Russian text and layouts over the rows of tables. The tables hold no Russian, so each row of `part` gives two
words of Russian look, made of the letters of its name, and by its key a case that is put between them. The SQL puts what
the case becomes, derived by hand from the rules, between the same words, or follows the rule itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import style as S
from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import index as I
from tessera.operators import layout as L
from tessera.session import table

N = " "
CORRECTIONS = S.parse_corrections(["тепловоз -> локомотив", "# примечание", "по прибытию -> по прибытии", "цена 5$ -> цена $1"])

#: name -> (rows of input and expected output, the Column that turns one into the other)
CASES = {
    "stem": (
        [("поезда", "поезд"), ("поездов", "поезд"), ("тормозной", "тормозн"), ("следующих", "след"), ("скорость", "скорост"), ("неисправность", "неисправн"), ("проверившись", "провер"),
         ("локомотивными", "локомотивн"), ("длинный", "длин"), ("движения", "движен"), ("останавливается", "останавлива"), ("важнейший", "важн"), ("стр", "стр"), ("brake", "brake")],
        T.stem,
    ),
    "clean_text": (
        [("Р А З Р Я Д К У", "РАЗРЯДКУ"), ("А Б В", "А Б В"), ("локо-\nмотив", "локомотив"), ("со­юз​", "союз"), (f"5{N}км в", "5 км в"), ("x Г О С Т y А Б В Г", "x ГОСТ y АБВГ")],
        T.clean,
    ),
    "punct_rules": (
        [("да,, нет", "да, нет"), ("вагон,локомотив", "вагон, локомотив"), ("а,б,в", "а, б,в"), ("Не позднее, чем завтра", "Не позднее чем завтра"), ("поезд а вагон", "поезд, а вагон"),
         ("пункт а раздела", "пункт а раздела"), ("пункт а вагон а дом", "пункт а вагон а дом"), ("или но потом", "или но потом"), ("поезд а и вагон", "поезд а и вагон")],
        S.punctuation,
    ),
    "typography": (
        [("далее - ПТЭ", f"далее{N}— ПТЭ"), ("N 1215/р", f"№{N}1215/р"), ("5 км", f"5{N}км"), ("ОАО «РЖД»", f"ОАО{N}«РЖД»"), ("слово , слово", "слово, слово"), ("( скобки )", "(скобки)"), ("а  б", "а б"), ("5 кмч", "5 кмч")],
        S.typography,
    ),
    "quote_fold": ([('a "b "c" d" e', "a «b „c“ d» e"), ('"да"', "«да»"), ("«уже» \"нет\"", "«уже» «нет»"), ("без кавычек", "без кавычек"), ('("х")', "(«х»)")], S.quotes),
    "apply_corrections": ([("Тепловоз и тепловоз", "Локомотив и локомотив"), ("тепловозы", "тепловозы"), ("по прибытию", "по прибытии"), ("цена 5$", "цена $1")], lambda x: S.apply_corrections(x, CORRECTIONS)),
    "dehyphenate": ([("технико-|распорядительных", "технико-распорядительных"), ("локомо-|тивов", "локомотивов"), ("поезд|стоит", "поезд стоит"), ("А-|Б", "А- Б")], lambda x: L.paragraph_text(F.split(x, r"\|"))),
    "norm_email": ([("User@Example.COM ", "user@example.com "), ("a@B", "a@b"), ("ÉT@x.Y", "ét@x.y")], A.norm_email),
}


LATIN, LOOK = "abcdefghijklmnopqrstuvwxyz", "абцдефгхиклмнопярстувшжызю"


def words(spark, d):
    """(key, w, v, c): two words of each part, in Russian letters, and the consonants of the first."""
    ru = lambda k: F.translate(F.get(F.split(F.lower("p_name"), " "), F.lit(k)), LATIN, LOOK)
    w = F.concat(F.lit("сло"), ru(0))
    rows = I.dealt(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return rows.select(F.col("p_partkey").alias("key"), w.alias("w"), F.concat(F.lit("тре"), ru(1)).alias("v"), F.regexp_replace(w, f"[{T.VOWELS}]", "").alias("c"))


def _pick(xs: list, key: str = "key"):
    """The element of a list that the key chooses."""
    return F.get(F.array(*map(F.lit, xs)), (F.col(key) % len(xs)).cast("int"))


#: What stands before and behind a case: the words, or what keeps the case whole.
AROUND = {"stem": ("c", ""), "norm_email": ("  w.", " ")}


def _case(name: str):
    rows, change = CASES[name]
    front, back = AROUND.get(name, ("w ", " v"))
    put = lambda x: [F.col(c) if c in "wvc" else F.lit(c) for c in x]

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = F.concat(*put(front), _pick([a for a, _ in rows]), *put(back))
        return words(spark, d).select("key", made.alias("input")).select("key", "input", change(F.col("input")).alias("output"))

    return run


def section_order(spark, d):
    """Parts as a brand's sections: by size, by size and a second number, or without a number."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_size", F.lit(". "), "p_name")).when(k % 3 == 1, F.concat("p_size", F.lit("."), (k % 12).cast("string"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_brand", "p_partkey", name.alias("name"))
    order = Window.partitionBy("p_brand").orderBy(T.section_key(F.col("name")), "p_partkey")
    return rows.select("p_partkey", "name", F.row_number().over(order).cast("long").alias("rank"))


def byte_range(spark, d):
    """Ranges of pages by their key, some beyond the end, some none."""
    k, size = F.col("page_id"), F.octet_length("html").cast("long")
    bad = _pick(["bytes=-", "", "bytes=5-2", "bytes=a-b", "bytes=0-99999999"], "page_id")
    header = F.when(k % 4 == 0, bad).when(k % 4 == 1, F.concat(F.lit("bytes="), k * 37, F.lit("-"))).when(k % 4 == 2, F.concat(F.lit("bytes=-"), k * 11)).otherwise(F.concat(F.lit("bytes="), k, F.lit("-"), k * 29))
    return table(spark, d, "pages").select("page_id", header.alias("header"), A.byte_range(header, size).alias("r")).select("page_id", "header", "r.status", "r.first", "r.last")


def style_applies(spark, d):
    """Documents as files of their source's folder, under a list of a file, a stem and a folder."""
    stem = F.concat(F.lit("d"), "doc_id")
    return table(spark, d, "documents").select("doc_id", S.applies(["d7.pdf", "d13", "d12.doc", "src2"], F.concat(stem, F.lit(".pdf")), stem, F.col("source")).alias("applies"))


def fix_log(spark, d):
    cases = ["да,, нет а вагон,дом", "путь", "не более, чем", "поезд;вагон но дом"]
    x = F.concat("w", F.lit(" "), _pick(cases), F.lit(" "), "v")
    return words(spark, d).select("key", F.posexplode(S.fix_log(x)).alias("k", "f")).select("key", F.col("k").cast("long").alias("k"), "f.was", "f.became")


def comma_context(spark, d):
    cases = ["проверить если поезд стоит", "поезд который стоит там", "и если так", "нужно чтобы шел"]
    rows = words(spark, d).select("key", F.concat("w", F.lit(" "), _pick(cases), F.lit(" "), "v").alias("x"))
    return S.missing_commas(rows, "key", "x")


def tok_offsets(spark, d):
    """Tokens of whole documents in Russian letters."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(S.token_offsets(F.translate(F.lower("text"), LATIN, LOOK))).alias("t"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("t.begin").alias("begins"), F.max("t.begin").cast("long").alias("last"), F.sum(F.length("t.token") * F.col("t.begin").cast("long")).alias("product"))


def docx_parts(spark, d):
    texts = [("p", ["w"]), ("p", ["1.1. Первый ", "v"]), ("p", ["Приложение N 2 форма"]), ("t", ["w", " | ", "v"]), ("p", ["I. Общие положения,"]), ("p", ["2 ", "w"])]
    blocks = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(*[F.col(x) if x in "wv" else F.lit(x) for x in text]).alias("text")) for kind, text in texts])
    return words(spark, d).select("key", F.posexplode(L.docx_parts(blocks)).alias("k", "p")).select("key", F.col("k").cast("long").alias("k"), "p.label", "p.text")


def sidecar_parts(spark, d):
    mark = lambda n, more="": F.concat(F.lit("\n=== стр. "), n.cast("string"), F.lit(f" ==={more}\n"))
    x = F.concat("v", mark(F.col("key")), "w", mark(F.col("key") + 1, "  "), "v")
    parts = words(spark, d).select("key", F.posexplode(L.sidecar_parts(x)).alias("k", "p"))
    return parts.select("key", F.col("k").cast("long").alias("k"), "p.label", F.trim(F.replace("p.text", F.lit("\n"), F.lit(" "))).alias("text"))


#: Pieces of lines: text, from, to, height on the page. The first three are one line.
_LINES = [("a", 0.0, 10.0, 100.0), ("b", 12.0, 20.0, 101.0), ("c", 45.0, 60.0, 100.5), ("d", 0.0, 30.0, 112.0)]


def _pieces(spark, d):
    """Each part is a page with these pieces, moved by its key."""
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(y).alias("y")) for t, a, b, y in _LINES])).alias("l")
    right, down = F.col("key") % 50, F.col("key") % 40 * 6
    rows = words(spark, d).select("key", "w", one)
    return rows.select(F.col("key").alias("page"), F.concat("l.t", "w").alias("text"), (F.col("l.a") + right).alias("x0"), (F.col("l.b") + right).alias("x1"), (F.col("l.y") + down).alias("y0"))


def line_merge(spark, d):
    return L.merged_lines(_pieces(spark, d).withColumn("two", F.lit(False)), "page")


def reading_order(spark, d):
    return _pieces(spark, d).select("page", "text", F.row_number().over(Window.partitionBy("page").orderBy(*L.reading_order(F.col("y0"), F.col("x0")))).cast("long").alias("rank"))


def table_prune(spark, d):
    cells = [["w", "", " b-\nc"], ["", "", " "], ["v-\nе", " "]]
    rows = F.array(*[F.array(*[F.concat(*[F.col(c) if c in ("w", "v") else F.lit(c) for c in ([x[0], x[1:]] if x[:1] in ("w", "v") else [x])]) for x in r]) for r in cells])
    return words(spark, d).select("key", F.posexplode(L.pruned_table(rows)).alias("row", "r")).select("key", F.col("row").cast("long").alias("row"), F.array_join("r", "|").alias("cells"))


def tickets_explode(spark, d):
    """A deck for each part, written as JSON and read again."""
    kind = "title string, tickets array<struct<n:int,q:array<string>>>"
    ticket = lambda n, *q: F.struct(F.lit(n).alias("n"), F.array(*q).alias("q"))
    deck = F.to_json(F.struct(F.concat(F.lit('"'), "w").alias("title"), F.array(ticket(1, F.col("w"), F.col("v")), ticket(2, F.concat("v", F.lit("?\n")))).alias("tickets")))
    rows = words(spark, d).select("key", F.from_json(deck, kind).alias("d")).select("key", "d.title", F.explode("d.tickets").alias("t"))
    return rows.select("key", "title", F.col("t.n").alias("n"), F.posexplode("t.q").alias("k", "question")).withColumn("k", F.col("k").cast("long"))


def login_outcome(spark, d):
    """Customers who log in: some too often, some with a wrong password, some not verified, by their balance and key."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    status = F.when(bal < 0, "blocked").when(bal < 1000, "pending").otherwise("active")
    right = F.when(k % 7 != 0, k % 5 != 0)  # null: there is no such user
    return table(spark, d, "customer").select("c_custkey", A.login_outcome(k % 11 == 0, k % 13 == 0, right, bal > 500, status).alias("outcome"))


def queries():
    own = [section_order, byte_range, style_applies, fix_log, comma_context, tok_offsets, docx_parts, sidecar_parts, line_merge, reading_order, table_prune, tickets_explode, login_outcome]
    return {name: _case(name) for name in CASES} | {f.__name__: f for f in own}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case_sql(name: str) -> str:
    rows, _ = CASES[name]
    front, back = AROUND.get(name, ("w ", " v"))
    put = lambda x: [c if c in "wvc" else _q(c) for c in x]
    row = lambda k: " || ".join([*put(front), f"[{', '.join(_q(r[k]) for r in rows)}][key % {len(rows)} + 1]", *put(back)])
    became = row(1)
    if name == "norm_email":
        became = f"trim({became})"
    return f"{WORDS} SELECT key, {row(0)} AS input, {became} AS output FROM words"


WORDS = f"""WITH n AS (SELECT p_partkey AS key, 'сло' || translate(lower(string_split(p_name, ' ')[1]), '{LATIN}', '{LOOK}') AS w, 'тре' || translate(lower(string_split(p_name, ' ')[2]), '{LATIN}', '{LOOK}') AS v FROM part),
words AS (SELECT *, regexp_replace(w, '[аеиоуыэюя]', '', 'g') AS c FROM n)"""
BETWEEN = lambda xs: f"w || ' ' || [{', '.join(map(_q, xs))}][key % {len(xs)} + 1] || ' ' || v"
TOKEN = r"[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*|[0-9]+|[^\s\x0B\x1C-\x1F\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SHIFT = "key % 50 AS r, key % 40 * 6 AS u"
SQL = {
    "section_order": r"""WITH s AS (SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '. ' || p_name WHEN 1 THEN p_size || '.' || p_partkey % 12 || ' ' || p_name ELSE p_name END AS name FROM part),
n AS (SELECT *, regexp_extract(name, '^[0-9]+(\.[0-9]+)*') AS num FROM s)
SELECT p_partkey, name, row_number() OVER (PARTITION BY p_brand ORDER BY num = '', CASE WHEN num <> '' THEN list_transform(string_split(num, '.'), lambda x: x::BIGINT) END, name, p_partkey) AS rank FROM n""",
    "byte_range": r"""WITH h AS (SELECT page_id, strlen(html) AS size, CASE page_id % 4 WHEN 0 THEN ['bytes=-', '', 'bytes=5-2', 'bytes=a-b', 'bytes=0-99999999'][page_id % 5 + 1]
  WHEN 1 THEN 'bytes=' || page_id * 37 || '-' WHEN 2 THEN 'bytes=-' || page_id * 11 ELSE 'bytes=' || page_id || '-' || page_id * 29 END AS header FROM pages),
n AS (SELECT *, TRY_CAST(regexp_extract(header, '^bytes=(\d*)-(\d*)$', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(header, '^bytes=(\d*)-(\d*)$', 2) AS BIGINT) AS b FROM h),
r AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN greatest(0, size - b) ELSE a END AS f, CASE WHEN a IS NULL OR b IS NULL THEN size - 1 ELSE least(b, size - 1) END AS l FROM n)
SELECT page_id, header, CASE WHEN a IS NULL AND b IS NULL THEN 200 WHEN f > l OR f >= size THEN 416 ELSE 206 END AS status, f AS first, l AS last FROM r""",
    "style_applies": "SELECT doc_id, doc_id = 7 OR doc_id = 13 OR source = 'src2' AS applies FROM documents",
    "fix_log": f"""{WORDS}, f AS (SELECT * FROM (VALUES (0, 0, ',,', ','), (0, 1, 'вагон,дом', 'вагон, дом'), (0, 2, 'нет а вагон', 'нет, а вагон'), (2, 0, 'не более, чем', 'не более чем'), (3, 0, 'поезд;вагон', 'поезд; вагон'),
  (3, 1, 'вагон но дом', 'вагон, но дом')) t(m, k, was, became)) SELECT key, k, was, became FROM words JOIN f ON key % 4 = m""",
    "comma_context": f"""{WORDS}, f AS (SELECT * FROM (VALUES (0, 'проверить', 'если поезд'), (1, 'поезд', 'который стоит'), (3, 'нужно', 'чтобы шел')) t(m, a, b))
SELECT key, w || ' ' || a || ' ' || b AS was, w || ' ' || a || ', ' || b AS becomes FROM words JOIN f ON key % 4 = m""",
    "tok_offsets": f"""WITH x AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{LOOK}') AS x FROM documents),
t AS (SELECT doc_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS t, unnest(gs[1:len(ts)]) AS g FROM (SELECT doc_id, regexp_extract_all(x, '{TOKEN}') AS ts, string_split_regex(x, '{TOKEN}') AS gs FROM x)),
o AS (SELECT doc_id, t, sum(length(g) + length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - length(t) AS begin FROM t)
SELECT doc_id, count(*) AS tokens, sum(begin)::BIGINT AS begins, max(begin) AS last, sum(length(t) * begin)::BIGINT AS product FROM o GROUP BY doc_id""",
    "docx_parts": f"""{WORDS} SELECT key, k, label, text FROM (SELECT key, 0 AS k, 'начало документа, с п. 1.1' AS label, w || chr(10) || '1.1. Первый ' || v AS text FROM words
UNION ALL SELECT key, 1, 'Приложение N 2', 'Приложение N 2 форма' || chr(10) || w || ' | ' || v FROM words
UNION ALL SELECT key, 2, 'Приложение N 2, раздел I. Общие положения, с п. 2', 'I. Общие положения,' || chr(10) || '2 ' || w FROM words)""",
    "sidecar_parts": f"{WORDS} SELECT key, 0 AS k, 'стр. ' || key AS label, w AS text FROM words UNION ALL SELECT key, 1, 'стр. ' || (key + 1), v FROM words",
    "line_merge": f"""{WORDS}, m AS (SELECT *, {SHIFT} FROM words) SELECT key AS page, 0 AS line, 'a' || w || ' b' || w || ' c' || w AS text, r + 0.0::DOUBLE AS x0, r + 60.0::DOUBLE AS x1, u + 100.0::DOUBLE AS y0, true AS two FROM m
UNION ALL SELECT key, 1, 'd' || w, r + 0.0::DOUBLE, r + 30.0::DOUBLE, u + 112.0::DOUBLE, false FROM m""",
    "reading_order": f"{WORDS} SELECT key AS page, ['a', 'b', 'c', 'd'][k] || w AS text, k AS rank FROM words, range(1, 5) t(k)",
    "table_prune": f"{WORDS} SELECT key, 0 AS row, w || '|b- c' AS cells FROM words UNION ALL SELECT key, 1, v || 'е|' FROM words",
    "tickets_explode": f"""{WORDS} SELECT key, '"' || w AS title, 1 AS n, k, CASE k WHEN 0 THEN w ELSE v END AS question FROM words, range(2) t(k) UNION ALL SELECT key, '"' || w, 2, 0, v || '?' || chr(10) FROM words""",
    "login_outcome": """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'limited' WHEN c_custkey % 13 = 0 THEN 'resend' WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'bad' WHEN c_acctbal <= 500 THEN 'unverified'
  WHEN c_acctbal < 1000 THEN 'pending' ELSE 'ok' END AS outcome FROM customer""",
}


def oracle_sql():
    return {name: _case_sql(name) for name in CASES} | SQL
