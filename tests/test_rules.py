"""Rules on literal rows, sources on a temporary folder, snapshots of access tables, streams."""

import html
import random
import re
import time
from html.entities import html5

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import style as S
from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import index as I
from tessera.operators import layout as L
from tessera.sources import files as X
from tessera.streaming.attempts import attempt_windows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_hash_vectors(spark):
    assert [one(spark, w, T.fnv) for w in ("a", "foobar", "поезд")] == [3826002220, 3214735720, 2015307716]


def test_chunking_limits(spark):
    text = "a" * 700 + "\n" + "b" * 499 + "\n" + "c" * 10
    assert [len(p) for p in one(spark, text, T.split_text)] == [1200, 10]
    assert [len(p) for p in one(spark, "d" * 5000, T.split_text)] == [5000]
    assert one(spark, "", T.split_text) == []


def test_token_rules(spark):
    df = spark.createDataFrame([(0, "Ёлка и 5 x №12")], "chunk_id long, text string")
    assert sorted(r.term for r in I.tokens(df, "chunk_id").collect()) == ["12", "5", "елк"]


def test_weights_are_positive_and_complete(spark):
    df = spark.createDataFrame([(0, "раз два два"), (1, ""), (2, "два слово 7")], "chunk_id long, text string")
    tf = I.term_freq(df)
    rows = I.bm25(df, tf).collect()
    assert len(rows) == tf.count() and all(r.weight >= 1 for r in rows)
    assert I.corpus_stats(df, tf).first().n == 3
    empty = df.filter("false")
    assert I.bm25(empty, I.term_freq(empty)).count() == 0


def test_typography_is_idempotent_on_fixtures(spark):
    from tessera.plans.fixtures import CASES

    for _, want in CASES["typography"][0]:
        assert one(spark, want, S.typography) == want


def test_quotes_carry_over_parts(spark):
    df = spark.createDataFrame([(['он сказал "да', 'и ушел" домой'],)], "p array<string>")
    assert df.select(S.quotes_through(F.col("p")).alias("y")).first().y == ["он сказал «да", "и ушел» домой"]


def test_suggestions_include_swaps(spark):
    words = spark.createDataFrame([("поезд",), ("вагно",)], "word string")
    known = spark.createDataFrame([("поезда",), ("вагон",), ("ваго",), ("дом",)], "known string")
    got = {r.word: r.suggestions for r in S.suggestions(words, known).collect()}
    assert got == {"поезд": "поезда", "вагно": "ваго, вагон"}


def test_participle_needs_comma(spark):
    forms = spark.createDataFrame(
        [("локомотивов", "NOUN", "gent", "plur", "masc"), ("следующих", "PRTF", "gent", "plur", None), ("участков", "NOUN", "gent", "plur", "masc")],
        "form string, pos string, case string, number string, gender string",
    )
    rows = spark.createDataFrame([(1, "локомотивов следующих в депо"), (2, "локомотивов следующих участков")], "id long, x string")
    assert [(r.id, r["at"]) for r in S.participle_commas(rows, "id", "x", forms).collect()] == [(1, 1)]


def test_docx_paragraph_classes(spark):
    rows = [("ИТОГ", "Normal", "CENTER", False, "<h2>ИТОГ</h2>"), ("текст", "Normal", "RIGHT", False, '<p class="r">текст</p>'), ("a<b", "", "", False, "<p>a&lt;b</p>"), ("Глава 1", "Heading 1", "", False, "<h2>Глава 1</h2>")]
    df = spark.createDataFrame(rows, "t string, s string, a string, b boolean, want string")
    assert all(r.got == r.want for r in df.select(H.docx_paragraph(*map(F.col, "tsab")).alias("got"), "want").collect())


def test_edges_and_tables(spark):
    lines = spark.createDataFrame([(1, p, f"Стр {p}", 0.0, 5.0, 100.0) for p in range(1, 5)] + [(1, 1, "тело", 50.0, 58.0, 100.0)], "doc_id long, page long, text string, y0 double, y1 double, height double")
    assert [r.text for r in L.without_edges(lines).collect()] == ["тело"]
    box = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 2.0), (1, 8.0, 1.0, 20.0, 2.0)], box.schema)
    assert [r.x0 for r in L.outside_tables(cells, box, "page").collect()] == [8.0]


def test_form_runs(spark):
    rows = [(1, 0, True, 0.0, 10.0, 10.0), (1, 1, False, 12.0, 20.0, 10.0), (1, 2, True, 22.0, 30.0, 10.0), (1, 3, True, 90.0, 99.0, 10.0)]
    df = spark.createDataFrame(rows, "page long, line long, two boolean, y0 double, y1 double, size double")
    assert [(r["first"], r["last"]) for r in L.form_runs(df, "page").collect()] == [(0, 2)]


def test_access_snapshots(spark):
    tokens = spark.createDataFrame([(1, "a", 7, "verify", 50), (2, "b", 7, "reset", 500), (3, "c", 8, "verify", 500)], A.TOKENS)
    new = spark.createDataFrame([(4, "d", 8, "verify", 900)], A.TOKENS)
    assert sorted(r.id for r in A.issue_token(tokens, new, 100).collect()) == [2, 4]
    attempts = spark.createDataFrame([(i, "1.1.1.1", "u@x", 1000 + i) for i in range(10)], A.ATTEMPTS)
    assert [(r.what, r.n) for r in A.blocked(attempts, 1100).collect()] == [("email", 10)]
    assert A.blocked(attempts, 1900).count() == 0  # the first is exactly 900 seconds old
    sessions = spark.createDataFrame([(1, "t", 7, 100, 0), (2, "u", 7, 90 * 86_400, 0)], A.SESSIONS)
    assert [r.expires for r in A.renewed(sessions, 50).orderBy("id").collect()] == [50 + 90 * 86_400, 90 * 86_400]


def test_registration_order(spark):
    df = spark.createDataFrame([(False, "a@b.ru", "n", "12345678", "12345678", True), (False, "нет", "n", "1", "2", False), (False, "a@b.ru", "n", "12345678", "12345678", False)], "l boolean, e string, n string, p string, q string, t boolean")
    assert [r.x for r in df.select(A.registration_error(*map(F.col, "lenpqt")).alias("x")).collect()] == ["taken", "email", None]


def test_folder_scan_and_decoding(spark, tmp_path):
    (tmp_path / "1 Раздел").mkdir()
    (tmp_path / "_text").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿привет".encode())
    (tmp_path / "1 Раздел" / "b.TXT").write_bytes("строка\nещё".encode("cp1251"))
    (tmp_path / "1 Раздел" / "x.png").write_bytes(b"1")
    (tmp_path / "_text" / "c.txt").write_bytes(b"1")
    good, skipped = X.supported(X.scan(spark, str(tmp_path)))
    assert sorted((r.file, r.sec) for r in good.select("file", "sec").collect()) == [("a.txt", ""), ("b.TXT", "1 Раздел")]
    assert [r.file for r in skipped.select("file").collect()] == ["x.png"]
    assert sorted(r.t for r in good.select(X.decoded(F.col("content")).alias("t")).collect()) == ["привет", "строка\nещё"]
    assert X.not_cached(good, good.select(F.sha1("content").alias("key")).limit(1)).count() == 1


def test_scans_take_their_sidecar(spark):
    kind = "stem string, parts array<struct<label:string,text:string>>"
    parts = spark.createDataFrame([("a", [("стр. 1", "  ")]), ("b", [("стр. 1", "текст")])], kind)
    side = spark.createDataFrame([("a", [("стр. 1", "набрано")]), ("b", [("стр. 1", "лишнее")])], kind)
    assert sorted(r.parts[0].text for r in X.with_scans(parts, side).collect()) == ["набрано", "текст"]


def test_nfc(spark):
    assert spark.createDataFrame([("и\u0306",)], "x string").select(T.nfc()("x").alias("z")).first().z == "\u0439"


def test_unescape_is_that_of_html(spark):
    rng = random.Random(1)
    names = sorted(html5)
    xs = ["&" + name + rng.choice(["", ";", "x", " "]) for name in names]
    xs += [f"&#{k};&#x{k:X} " for k in [*range(0x180), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000]]
    xs += ["&", "&&amp;", "&amp;lt;", "&#;", "&#x;", f"&#{'9' * 40};", f"&#x{'f' * 40};", f"&#{'0' * 40}65;", "&notit;", "&unknown;", "a&b;c", ""]
    xs += ["".join(rng.choice(["&", "amp", ";", "lt", "#", "x", "6", "5", " ", "not", "\ue000"]) for _ in range(9)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x string").select("i", H.unescape(F.col("x")).alias("y")).collect()
    assert [r.y for r in sorted(rows)] == [html.unescape(x) for x in xs]


def test_entities_between_tags(spark):
    x = "<p>a &mdash; b &#8212; c &laquo;x&raquo; &lt;i&gt;</p>"
    assert one(spark, x, lambda c: H.page_body(c, [])) == "<p>a\u00a0— b\u00a0— c «x» &lt;i&gt;</p>"


class Sequential:
    """The rule of quotes, one character after the other."""

    def __init__(self):
        self.last, self.depth = "\n", 0

    def __call__(self, text):
        out = []
        for c in text:
            if c in '"“”„':
                opens = self.last.isspace() or self.last in "([«„-—/"
                self.depth = self.depth + 1 if opens else max(0, self.depth - 1)
                c = ("«" if self.depth == 1 else "„") if opens else ("»" if self.depth == 0 else "“")
            elif c in "«»":
                self.depth = self.depth + 1 if c == "«" else max(0, self.depth - 1)
            out.append(c)
            self.last = c
        return "".join(out)


def test_quotes_equal_the_sequential_rule(spark):
    rng = random.Random(2)
    docs = [["".join(rng.choice('"“”„«» аб(-—/\n\ue000') for _ in range(rng.choice([0, 0, 1, 2, 5, 40]))) for _ in range(rng.randrange(8))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, p array<string>").select("i", S.quotes_through(F.col("p")).alias("q"), S.quotes(F.array_join("p", "")).alias("w"))
    for r in df.collect():
        fold = Sequential()
        want = [fold(x) for x in docs[r.i]]
        assert r.q == want and r.w == "".join(want)


def test_a_private_character_stays_in_its_part(spark):
    x = "<p>один\ue000два</p><p>три</p><p>четыре</p>"
    assert one(spark, x, lambda c: H.page_body(c, [])) == x
    docs = spark.createDataFrame([(1, "да\ue000нет\n" * 61)], "doc_id long, text string")
    assert [r.text.count("\ue000") for r in I.chunks(docs, []).orderBy("part").collect()] == [60, 1]


def test_token_offsets_are_those_of_the_pattern(spark):
    rng = random.Random(7)
    xs = ["".join(rng.choice("аЯё- 12.,x\U0001F600\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    pattern = re.compile(r"[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*|\d+|\S")
    for r in spark.createDataFrame(list(enumerate(xs)), "i int, x string").select("i", S.token_offsets(F.col("x")).alias("t")).collect():
        assert [(t.token, t.begin) for t in r.t] == [(m.group(), m.start()) for m in pattern.finditer(xs[r.i])]


def test_long_texts_are_near_linear(spark):
    """Twenty times the text is far from four hundred times the work."""

    def took(n):
        df = spark.createDataFrame([('"a" "' * n,)], "x string")
        start = time.perf_counter()
        df.select(F.md5(S.quotes(F.col("x"))), F.size(S.token_offsets(F.col("x")))).collect()
        return time.perf_counter() - start

    took(100)
    assert took(40_000) < 60 * max(0.2, took(2_000))


def test_attempt_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    q = attempt_windows(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("attempts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("select * from attempts").count() > 0
