"""Incremental builds of the index: unchanged texts are not read again, and document frequencies, the number of chunks and
their total length are kept by differences.

A document's signature is a digest of its text and of the rules it is read by (correction pairs, limits, RULES), so a change
of either is another signature. What reading a text gives is kept by signature in cache folders, which are only added to:

- `texts` (sig, place, part, piece, label, text): its chunks;
- `words` (sig, place, len, words): the length of each and its words (term, tf), a row for each chunk, so that a signature stands
  once beside them and not beside every word.

A state folder holds what goes with one set of documents: `docs` (doc_id, sig), `df` (term, df), `stats` (chunks, total,
number of texts that were read) and `caches`, the cache folders it refers to. `update` makes the next state from the last:

1. signatures of all documents; those that no cache holds are read, each text once however many documents have it;
2. how many documents more or fewer have each signature; only where that number has changed is the cache read, and df,
   chunks and total change by the difference times what the signature holds.

The state is written after its cache folder and its stats last, so an update that fails leaves the last state as it was. A chunk's
number depends on all documents before it, and a weight on the whole corpus: `pieces` and `weights` compute them from the
state by joins and arithmetic, without reading texts, and equal those of a full build.

Defined results: doc_ids are not null and distinct; a null text is empty and has no chunks; an empty table is a state
without documents; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import index as I
from tessera.session import stored

#: Grows when the reading of texts changes in a way that its parameters don't show.
RULES = "1"
#: Tables of a cache folder.
TABLES = {
    "sigs": "sig string", "texts": "sig string, place long, part long, piece long, label string, text string",
    "words": "sig string, place long, len long, words array<struct<term:string,tf:long>>",
}


def signature(pairs: list[tuple[str, str]] | None = None, cleaned: bool = True) -> str:
    """What texts are read by, as one text: the correction pairs, the limits, and whether texts are read as they stand."""
    return repr((RULES, pairs, I.LINES, T.CHUNK_CHARS, *([] if cleaned else ["as it stands"])))


def signed(docs: DataFrame, pairs: list[tuple[str, str]] | None = None, cleaned: bool = True) -> DataFrame:
    """(doc_id, text, sig)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(F.concat(text, F.lit("\n" + signature(pairs, cleaned))), 256).alias("sig"))


def cached(spark: SparkSession, caches: list[str], name: str) -> DataFrame:
    """One of TABLES over these cache folders."""
    if not caches:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*[f"{c}/{name}" for c in caches])


class State:
    """A written state: the tables of one set of documents."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.stats = read("stats")
        self.docs, self.df = read("docs"), read("df")
        self.caches = [r.path for r in read("caches").collect()]  # one for each update that read something

    @property
    def chunks(self) -> DataFrame:
        return cached(self.spark, self.caches, "texts")

    @property
    def words(self) -> DataFrame:
        return cached(self.spark, self.caches, "words")


def _read(texts: DataFrame, pairs, path: str, cleaned: bool) -> None:
    """Chunks, words and lengths of texts (sig, text), written to a cache folder."""
    pieces = I.chunks(texts.withColumnRenamed("sig", "doc_id"), pairs, cleaned)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "piece")) - 1
    pieces = pieces.select(F.col("doc_id").alias("sig"), place.cast("long").alias("place"), "part", "piece", "label", "text")
    pieces.write.option("compression", "zstd").parquet(f"{path}/texts")
    rows = cached(texts.sparkSession, [path], "texts").select("sig", "place", T.counted(T.kept_tokens(F.col("text"))).alias("words"))
    length = F.aggregate("words", F.lit(0).cast("long"), lambda a, p: a + p["tf"])
    rows.select("sig", "place", length.alias("len"), "words").write.option("compression", "zstd").parquet(f"{path}/words")


def update(docs: DataFrame, root: str, last: State | None = None, pairs: list[tuple[str, str]] | None = None, cleaned: bool = True) -> State:
    """The state of these documents, from the last one's; without one, a full build."""
    spark = docs.sparkSession
    path = f"{root}/state-{uuid.uuid4().hex}"
    rows = signed(docs, pairs, cleaned)
    rows.select("doc_id", "sig").write.parquet(f"{path}/docs")
    now = spark.read.parquet(f"{path}/docs")
    caches = list(last.caches) if last else []
    fresh = now.select("sig").distinct().join(cached(spark, caches, "sigs"), "sig", "left_anti")
    cache = f"{root}/cache-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{cache}/sigs")
    fresh = spark.read.parquet(f"{cache}/sigs")
    n_read = fresh.count()
    if n_read:
        once = rows.join(fresh, "sig", "left_semi").groupBy("sig").agg(F.first("text").alias("text"))
        _read(once, pairs, cache, cleaned)
        caches.append(cache)
    spark.createDataFrame([(c,) for c in caches], "path string").coalesce(1).write.parquet(f"{path}/caches")
    # Documents more or fewer of each signature.
    diff = now.groupBy("sig").agg(F.count("*").alias("more"))
    if last:
        diff = diff.unionByName(last.docs.groupBy("sig").agg((-F.count("*")).alias("more"))).groupBy("sig").agg(F.sum("more").alias("more")).filter("more <> 0")
    diff.write.parquet(f"{path}/diff")
    diff = spark.read.parquet(f"{path}/diff")
    changed = cached(spark, caches, "words").join(diff, "sig")
    words = changed.select("more", F.explode("words.term").alias("term")).groupBy("term").agg(F.sum("more").alias("df"))
    if last:
        words = last.df.unionByName(words).groupBy("term").agg(F.sum("df").alias("df"))
    words.filter("df > 0").write.parquet(f"{path}/df")
    sums = changed.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.col("more") * F.col("len")), F.lit(0)).alias("total"))
    if last:
        sums = sums.unionByName(last.stats.select("chunks", "total")).agg(F.sum("chunks").alias("chunks"), F.sum("total").alias("total"))
    sums.withColumn("read", F.lit(n_read).cast("long")).coalesce(1).write.parquet(f"{path}/stats")
    return State(spark, path)


def offsets(state: State) -> DataFrame:
    """(doc_id, sig, start): the number of each document's first chunk; documents without chunks are left out."""
    counts = state.docs.join(state.words.groupBy("sig").agg(F.count("*").alias("chunks")), "sig")
    return I.running_total(counts, "doc_id", "chunks").select("doc_id", "sig", "start")


def pieces(state: State) -> DataFrame:
    """(chunk_id, doc_id, part, piece, label, text) as a full build numbers them."""
    return offsets(state).join(state.chunks, "sig").select((F.col("start") + F.col("place")).alias("chunk_id"), "doc_id", "part", "piece", "label", "text")


def weights(state: State) -> DataFrame:
    """(chunk_id, term, tf, weight) as a full build weighs them."""
    avg = F.col("total") / F.when(F.col("chunks") > 0, F.col("chunks"))
    stats = state.stats.select(F.col("chunks").alias("n"), F.coalesce(F.when(avg != 0, avg), F.lit(1.0)).alias("avg_len"))
    chunks = state.words.join(offsets(state), "sig").select((F.col("start") + F.col("place")).alias("chunk_id"), "len", "words")
    rows = I.with_df(stored(chunks, "numbered").select("chunk_id", "len", F.inline("words")), state.df).crossJoin(F.broadcast(stats))  # one row
    return rows.select("chunk_id", "term", "tf", I.weight(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("avg_len")).alias("weight"))
