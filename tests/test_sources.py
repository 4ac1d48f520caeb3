"""Sources, sinks and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import style as S
from tessera.operators import access as A
from tessera.operators import index as I
from tessera.sources import files as X
from tessera.streaming.attempts import first_uses


def test_text_files_are_parsed_by_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(("x\r\n" * 61).encode())
    (tmp_path / "b.md").write_bytes(b"\n")
    (tmp_path / "c.txt").write_bytes("строка\u2028ещё".encode())
    files = X.scan(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in X.parsed(files.filter("ext in ('txt', 'md')")).collect()}
    assert [(p.label, p.text.count("x")) for p in got["a.txt"].parts] == [("часть 1", 60), ("часть 2", 1)] and [tuple(p) for p in got["b.md"].parts] == [("часть 1", "")]
    assert got["c.txt"].parts[0].text == "строка\nещё" and all(r.error is None for r in got.values())
    assert I.bytes_on_disk(files).first().bytes == 61 * 3 + 1 + len("строка\u2028ещё".encode())


def test_a_broken_file_says_why(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"broken")
    (tmp_path / "b.pdf").write_bytes(b"one\ntwo")

    def reader():
        def read(content):
            if content == b"broken":
                raise ValueError("no pages")
            return content.decode().split("\n")

        return read

    got = {r.path[-5:]: (list(r.found), r.error) for r in X._read_each(X.scan(spark, str(tmp_path)), reader, "array<string>").collect()}
    assert got == {"a.pdf": ([], "ValueError: no pages"), "b.pdf": (["one", "two"], None)}

    def missing():
        raise ModuleNotFoundError("no reader")

    with pytest.raises(Exception, match="no reader"):
        X._read_each(X.scan(spark, str(tmp_path)), missing, "array<string>").collect()


def test_docx_blocks(spark):
    found = [("p", [["  Первый \n"]]), ("p", [[" "]]), ("t", [["а", "а", " б  в "], ["г", "д", "г"]])]
    df = spark.createDataFrame([(found,)], "f array<struct<kind:string,rows:array<array<string>>>>")
    assert [tuple(b) for b in df.select(X.docx_blocks(F.col("f")).alias("b")).first().b] == [("p", "Первый"), ("t", "а | б в\nг | д | г")]


def test_json_and_rule_files(spark, tmp_path):
    deck = {"title": "Билеты", "tickets": [{"n": 1, "q": ["что"]}]}
    (tmp_path / "d.json").write_text(json.dumps(deck, indent=1))
    assert X.read_json(spark, str(tmp_path / "d.json")).first().title == "Билеты"
    df = spark.createDataFrame([(1, "ё"), (2, None)], "k int, x string")
    X.write_json(df, str(tmp_path / "out"), "k")
    assert sorted((r.k, r.x) for r in X.read_json(spark, str(tmp_path / "out"), "k int, x string").collect()) == [(1, "ё"), (2, None)]
    assert "ё" in "".join(p.read_text() for p in (tmp_path / "out").rglob("*.json"))
    (tmp_path / "r.txt").write_text("# нет\n\n  a -> b \n")
    assert [r.value for r in S.rule_lines(spark.read.text(str(tmp_path / "r.txt"))).collect()] == ["a -> b"]


def test_tables_of_another_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.range(100).select("id", (F.col("id") * 2).alias("twice")).write.jdbc(url, "t", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    except Exception as error:
        pytest.skip(f"no database in this installation: {type(error).__name__}")
    rows = X.read_jdbc(spark, url, "t", "id", 0, 100, 4)
    assert rows.count() == 100 and rows.rdd.getNumPartitions() == 4


def test_logs_and_snapshots(spark):
    df = spark.createDataFrame([("тепловоз и вагон",)], "x string")
    pairs = S.parse_corrections(["тепловоз -> локомотив", "поезд -> состав"])
    assert [tuple(h) for h in df.select(S.correction_hits(F.col("x"), pairs).alias("h")).first().h] == [("тепловоз", "локомотив")]
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "id long, user_id long")
    assert [r.id for r in A.without(rows, rows.filter("id = 1"), "user_id").collect()] == [2]
    users = spark.createDataFrame([(1, "a@b", "", "p", "admin", "active", 1, 0, 0), (2, "c@d", "", "p", "admin", "blocked", 1, 0, 0)], A.USERS)
    assert A.user_by_email(users, "c@d").first().id == 2 and [r.email for r in A.active_admins(users).collect()] == ["a@b"]
    good, bad = "a" * 64, "A" * 64
    hashed = spark.createDataFrame([(good,)], "t string").select(F.sha2("t", 256).alias("h")).first().h
    tokens = spark.createDataFrame([(1, hashed, 7, "reset", 100)], A.TOKENS)
    shown = spark.createDataFrame([(good,), (bad,)], "token string")
    assert A.used(tokens, shown, "reset", 50).count() == 0 and A.used(tokens, shown, "reset", 100).count() == 1


def test_first_uses(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "token string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = first_uses(spark.readStream.schema("token string, ts timestamp").parquet(str(tmp_path / "in")), "token")
    q = stream.writeStream.format("memory").queryName("uses").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.token for r in spark.sql("select * from uses").collect()) == ["a", "b"]
