"""Attempts of hot keys and renewals of sessions: windows, brute force, and the stream against the batch."""

import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import access as A
from tessera.streaming.sessions import session_renewals


def test_attempts_equal_one_window(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, -5, 0, 3599, 3600, rng.randrange(20_000), rng.randrange(20_000)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, who string, at long")
    for window in (1, 900, 5000):
        w = Window.partitionBy("who").orderBy("at").rangeBetween(-(window - 1), Window.currentRow)
        want = {r.id: r.n for r in df.withColumn("n", F.count("*").over(w)).collect()}
        got = A.recent_count(df, "who", F.col("at"), window)
        assert got.columns == ["id", "who", "at", "n"] and {r.id: r.n for r in got.collect()} == want
    assert A.recent_count(df.filter("false"), "who", F.col("at")).count() == 0


def test_a_hot_key_is_many_small_groups(spark):
    """Half of all attempts come from one address within a day, thousands in some seconds."""
    hot = spark.range(60_000).select(F.lit("10.0.0.1").alias("_k"), F.when(F.col("id") < 30_000, F.col("id") % 3).otherwise(F.col("id") * 3 % 86_400).alias("_t"))
    cold = spark.range(60_000).select(F.concat(F.lit("10.1."), F.col("id") % 5000).alias("_k"), (F.col("id") * 7 % 86_400).alias("_t"))
    each = hot.unionByName(cold).groupBy("_k", "_t").agg(F.count("*").alias("_c"))
    groups = A.seconds_sliced(each, A.WINDOW_S).groupBy("_k", "_s").count().cache()
    assert groups.filter("_k = '10.0.0.1'").count() >= 24
    assert groups.agg(F.max("count")).first()[0] <= A.SLICE_S + A.WINDOW_S


def folded(events, days):
    """Sessions one event after the other."""
    out, ends = Counter(), {}
    merged = {}
    for token, at, opens in events:
        merged[token, at] = bool(opens) or merged.get((token, at), False)
    for (token, at), opens in sorted(merged.items(), key=lambda e: e[0][1]):
        end = ends.get(token)
        if opens or end is not None and end >= at and at + days * 86_400 - end > A.RENEW_S:
            ends[token] = at + days * 86_400
            out[token, at, ends[token]] += 1
    return out


def made(rng, n=600):
    start = 1_700_000_000
    return [(f"t{rng.randrange(8)}", start + rng.randrange(20 * 86_400), rng.choice([True, False, False, False, False, None])) for _ in range(n)]


def test_renewals_equal_the_fold(spark):
    events = made(random.Random(2))
    events += events[:20]
    df = spark.createDataFrame(events, "token string, at long, opens boolean")
    for days in (2, 3, 90):
        assert Counter(map(tuple, A.renewals(df, days).collect())) == folded(events, days)


def test_stream_of_renewals_equals_the_batch(spark, tmp_path):
    """Events arrive shuffled and up to a day late, in several files; the last one moves the watermark beyond all."""
    rng = random.Random(3)
    events = sorted(made(rng, 300), key=lambda e: e[1] + rng.randrange(80_000))
    schema = "token string, at long, opens boolean"
    src = str(tmp_path / "in")
    for k in range(0, 300, 75):
        spark.createDataFrame(events[k : k + 75], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("last", events[-1][1] + 400 * 86_400, False)], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("last", events[-1][1] + 500 * 86_400, False)], schema).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).select("token", F.timestamp_seconds("at").alias("ts"), "opens")
        q = session_renewals(stream, days=3, late="1 day").writeStream.format("memory").queryName("renewed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = Counter(map(tuple, A.renewals(spark.createDataFrame(events, schema), 3).collect()))
    assert Counter(map(tuple, spark.sql("select token, at, expires from renewed").collect())) == want and len(want) > 20
