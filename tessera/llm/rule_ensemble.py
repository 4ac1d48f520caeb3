"""Quality by a sparse rule ensemble.

Boosted shallow trees over text statistics give their paths as conjunctive rules; a lasso logistic regression over the
rules (and the clipped, scaled statistics) keeps a few; the kept rules become one Spark Column over the statistics, which
are Columns too. Scoring runs no Python.

At most `sample` labelled texts (those of the smallest keyed hash of doc_id) are used for fitting, a documented bound;
every whole text is scored, and an empty table gives an empty result. Of rows that repeat a doc_id each different text is
one training row. Null and empty texts have statistics 0 and a score. Null labels are not used; without labels,
or with one class, the score is the class's share. Rows that repeat a doc_id are scored each; doc_id, lang, source and
labels never enter a score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.learn import grow_tree, logistic, sigmoid

SAMPLE, TREES, DEPTH, BINS, LEAST = 20_000, 24, 3, 32, 15
STATISTICS = ["chars", "words", "word_chars", "symbols", "bars", "cries", "capitals", "digits", "lines", "repeated_lines", "distinct_words", "short_words", "stops"]


def _count(text: Column, marks: str) -> Column:
    """How many of the ASCII marks a text holds."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m))) for m in marks), F.lit(0))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and STATISTICS, as doubles: counts and shares of the whole text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("t"))
    base = base.select(
        *keep, "t", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("l"),
    )
    per = lambda a, b: a / F.greatest(b, F.lit(1)).cast("double")
    chars, words, lines = F.length("t"), F.size("w"), F.size("l")
    return base.select(
        *keep,
        F.log1p(chars).alias("chars"), F.log1p(words).alias("words"), per(chars, words).alias("word_chars"),
        per(_count(F.col("t"), "#*$%&<>"), chars).alias("symbols"), per(_count(F.col("t"), "|"), chars).alias("bars"),
        per(_count(F.col("t"), "!?"), chars).alias("cries"), per(F.regexp_count("t", F.lit(r"\p{Lu}")), chars).alias("capitals"),
        per(_count(F.col("t"), "0123456789"), chars).alias("digits"), per(words, lines).alias("lines"),
        per(lines - F.size(F.array_distinct("l")), lines).alias("repeated_lines"),
        per(F.size(F.array_distinct("w")), words).alias("distinct_words"),
        per(F.size(F.filter("w", lambda x: F.length(x) < 4)), words).alias("short_words"),
        per(_count(F.col("t"), ".,"), words).alias("stops"),
    )


class Rules:
    """Weighted conjunctions of tests (statistic, bound, above) plus linear terms and an intercept."""

    def __init__(self, rules: list[tuple[tuple[tuple[str, float, bool], ...], float]], linear: list[tuple[str, float, float, float]], intercept: float):
        self.rules, self.linear, self.intercept = rules, linear, intercept

    def column(self) -> Column:
        """The score as one Column over STATISTICS."""
        total = F.lit(self.intercept)
        for tests, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(s) > bound if above else F.col(s) <= bound for s, bound, above in tests])
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        for s, low, high, weight in self.linear:
            total = total + F.least(F.greatest(F.col(s), F.lit(low)), F.lit(high)) * F.lit(weight)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, l1: float = 1.5e-3) -> Rules:
    """x: a row of STATISTICS for each document, y: 0/1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Rules([], [], float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    rng, f, paths = np.random.default_rng(7), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        some = rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False)
        found, values = grow_tree(bins, y - sigmoid(f), some, DEPTH, LEAST, BINS + 1)
        f = f + 2.0 * values
        for path in found:
            tests: dict = {}
            for s, at, above in path:  # of several tests of one side of a statistic the tightest
                old = tests.get((s, above))
                tests[s, above] = at if old is None else max(old, at) if above else min(old, at)
            paths[tuple(sorted((s, at, above) for (s, above), at in tests.items()))] = None
    rules = list(paths)
    hold = np.column_stack([np.logical_and.reduce([(bins[:, s] > at) == above for s, at, above in r]) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    scale = 0.4 / np.maximum(np.clip(x, low, high).std(axis=0), 1e-6)
    flat = (np.clip(x, low, high) * scale).astype(np.float32)
    centre = flat.mean(axis=0)
    w, b = logistic(np.column_stack([hold, flat - centre]), y.astype(np.float32), l1=l1, rounds=400)
    names = STATISTICS
    kept = [(tuple((names[s], float(cuts[s][at]), above) for s, at, above in r), float(v)) for r, v in zip(rules, w, strict=False) if v]
    slopes = w[len(rules) :]
    linear = [(names[s], float(low[s]), float(high[s]), float(v * scale[s])) for s, v in enumerate(slopes) if v]
    return Rules(kept, linear, float(b - (slopes * centre).sum()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, l1: float = 1.5e-3) -> Rules:
    """Rules fitted on the labelled rows given (leave the held-out ones out of `labels`)."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    chosen = marks.orderBy(F.xxhash64(F.lit("rules"), "doc_id"), "doc_id").limit(sample)  # bounded, so broadcast and collected
    # An id may have many texts: copies are one row, and what is left is bounded again.
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    mine = mine.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.max("y").alias("y")).orderBy(F.xxhash64(F.lit("rules"), "doc_id"), "doc_id", "h").limit(sample)
    rows = statistics(mine, "doc_id", "h", "y").orderBy("doc_id", "h").toPandas()
    return fit(rows[STATISTICS].to_numpy(np.float64), rows["y"].to_numpy(np.int64), l1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out rows are not read."""
    rules = train(docs, labels.filter(~held_out(F.col("doc_id"))), sample)
    score = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("doc_id", rules.column().alias("score"))
    return score.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
