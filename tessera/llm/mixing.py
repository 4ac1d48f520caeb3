"""Temperature mixing of sources, in DataFrame functions only.

A source's share p of all words becomes a weight p**a / sum of p**a. The exponent a in 0..1 is found by bisection: the
smallest that keeps within a repetition limit (no source is repeated over `limit` times while none falls below one whole
pass), or the one whose weights have a target entropy. With the repetition limit the budget is the least one that gives
every source one whole pass, so mixing then only adds copies and drops no document; with a target entropy the budget is
`budget` words (all the words there are by default) and a source may be cut.

The weights are realised in blocks: block k of a source is a keyed permutation of its documents; blocks are taken whole
while the source's quota lasts, and of the last one the documents in permuted order while the words before them are
fewer than what is left. The running sum is taken in two steps (BUCKETS ranges of the permutation, then inside each), so
a source with most of the rows is no single task.

Defined results: a null text has no words and, like any text without words, is in each whole block; a null source is a
source of its own; rows that repeat a doc_id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, fresh, md5_hex, stored

STEPS = 40
#: Hex digits of the permutation key that name a bucket: 4096 for each source.
DIGITS = 3
LIMIT = 1.5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(words: DataFrame, limit: float | None = LIMIT, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source_key, words, share, exponent, weight, quota): one row for each source; words: (source_key, n_words).

    The one array it folds over has an element for each source.
    """
    totals = words.groupBy("source_key").agg(F.sum("n_words").alias("words")).filter("words > 0")
    listed = totals.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_key", "words"))).alias("s"), F.sum("words").cast("double").alias("all"))
    listed = listed.select("s", "all", F.transform("s", lambda x: x["words"] / F.col("all")).alias("p"))
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    high, low = F.array_max("p"), F.array_min("p")
    if entropy is None:
        # Repetition of the rarest source when the commonest has one pass.
        fits = lambda a: F.pow(high / low, 1 - a) <= F.lit(float(limit))
    else:
        total = lambda a: add(F.col("p"), lambda x: F.pow(x, a))
        fits = lambda a: F.ln(total(a)) - a * add(F.col("p"), lambda x: F.pow(x, a) * F.ln(x)) / total(a) <= F.lit(float(entropy))
    # Bisection keeps an exponent that fits at the upper end.
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), start,
        lambda s, _: F.struct(F.when(fits(middle(s)), s["lo"]).otherwise(middle(s)).alias("lo"), F.when(fits(middle(s)), middle(s)).otherwise(s["hi"]).alias("hi")),
    )
    listed = listed.select("s", "p", "all", found["hi"].alias("exponent"))
    rows = listed.select("all", "p", "exponent", add(F.col("p"), lambda x: F.pow(x, F.col("exponent"))).alias("z"), F.posexplode("s").alias("k", "x"))
    share = F.get("p", F.col("k"))
    weight = F.pow(share, "exponent") / F.col("z")
    if entropy is None:
        most = F.array_max("p")
        spend = F.col("all") * most / (F.pow(most, "exponent") / F.col("z"))
    else:
        spend = F.lit(float(budget)) if budget is not None else F.col("all")
    quota = F.round(spend * weight).cast("long")
    if entropy is None:
        quota = F.greatest(quota, F.col("x.words"))  # rounding never costs a document
    return rows.select(F.col("x.source_key").alias("source_key"), F.col("x.words").alias("words"), share.alias("share"), "exponent", weight.alias("weight"), quota.alias("quota"))


def mixed(docs: DataFrame, seed: int = 42, **target) -> DataFrame:
    """(doc_id, source, n_words, block, weight, key): a row for each time a document is taken.

    Order by block, then key, to read the permutations. `key` is the md5 of seed, block, doc_id and source.
    """
    base = docs.select("doc_id", F.col("source"), F.coalesce("source", F.lit("\x00")).alias("source_key"), n_words(F.col("text")).alias("n_words"))
    base = stored(base, "words")  # texts are read once
    goal = plan(base, **target)
    # Whole blocks, and the words of the last, partial one.
    goal = goal.select("source_key", "weight", F.floor(F.col("quota") / F.col("words")).alias("whole"), F.pmod("quota", "words").alias("rest"))
    rows = base.join(goal, "source_key", "left").withColumn("whole", F.coalesce("whole", F.lit(1).cast("long"))).withColumn("rest", F.coalesce("rest", F.lit(0).cast("long")))
    key = lambda block: md5_hex(F.lit(seed), block, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("source_key"))
    names = ["doc_id", "source", "n_words", "block", "weight", "key"]
    full = rows.filter("whole > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    full = full.withColumn("key", key(F.col("block"))).select(names)
    last = rows.filter("rest > 0").withColumn("block", F.col("whole")).withColumn("key", key(F.col("block")))
    last = last.withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = last.groupBy("source_key", "bucket").agg(F.sum("n_words").alias("here"))
    sums = sums.withColumn("ahead", F.sum("here").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("here")).drop("here")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    last = last.join(sums, ["source_key", "bucket"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("n_words").over(inside), F.lit(0).cast("long")))
    return full.unionByName(last.filter("before < rest").select(names))


def mixed_documents(docs: DataFrame, seed: int = 42, **target) -> DataFrame:
    """docs, each row as often as mixed() takes its document. Rows with a null doc_id stay once. Rows that repeat a doc_id
    share its takes: as many each, and the first of them, by the text's hash, one more if need be."""
    taken = mixed(docs.select("doc_id", "source", "text").filter("doc_id is not null"), seed, **target)
    takes, rows, id_, nth, copy = fresh(docs, "takes", "rows", "id", "nth", "copy")
    times = taken.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(takes))
    held = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(rows))
    each = stored(times.join(held, id_), "takes")
    mine = docs.join(each, docs["doc_id"] == each[id_])
    one, several = mine.filter(F.col(rows) == 1).withColumn(nth, F.lit(1)), mine.filter(F.col(rows) > 1)
    if each.filter(F.col(rows) > 1).limit(1).count():
        order = Window.partitionBy(id_).orderBy(F.xxhash64("text"), F.length("text"))
        one = one.unionByName(several.withColumn(nth, F.row_number().over(order)))
    count = F.floor((F.col(takes) + F.col(rows) - F.col(nth)) / F.col(rows)).cast("int")
    again = one.withColumn(takes, count).filter(F.col(takes) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(takes))))
    return again.select(docs.columns).unionByName(docs.filter("doc_id is null"))
