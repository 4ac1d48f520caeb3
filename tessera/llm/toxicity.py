"""Toxicity by a classifier chain.

The categories are kinds of toxicity, predicted in order: `insult` (the text holds an indicator, a word that hardly any
but toxic texts hold), `severe` (two or more different indicators) and `toxic` as a whole. Each has a linear (logistic,
lasso) model over the presence of VOCABULARY words and a few shares of the text, and over the probabilities of the
categories before it. While training, those earlier probabilities are out-of-fold ones, so a later model learns from what
it will meet when it scores: for the texts of a fold they come from models, marks and a choice of words that the other folds
alone have made. Labels tell `toxic` only; the other two are marked by rule on the training texts: toxic ones,
by the indicators found among them (words of LEAST_DOCS texts or more, INDICATES of which are toxic).

The models are fitted on at most `sample` distinct labelled texts (those of the smallest keyed hash), a documented bound,
and over at most VOCABULARY words, a parameter of the model; scoring reads every whole text. A text's score depends on the
text alone. A null or empty text has no words and scores by its intercepts; null labels are not used; copies of a text
are one in training, toxic if one of them is; without labels, or with one class only, a category's probability is its
share (0 without labels). Rows that repeat a doc_id, or have none, are scored each. An empty table gives an empty result.
Batches of BATCH_ROWS texts are held at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, stored
from tessera.llm.learn import logistic, sigmoid

WORDS = re.compile(r"[^\W\d_]+")
SAMPLE, VOCABULARY, FOLDS = 12_000, 160, 3
LEAST_DOCS, INDICATES = 4, 0.9
#: Chi-square of a word's toxic texts that chance exceeds once in a thousand words.
LEAST_SURPRISE = 10.83
BATCH_ROWS = 512
CATEGORIES = ["insult", "severe", "toxic"]
SHARES = 5
_classes = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"), 1):
    _classes[list(_chars)] = _k


def words_in(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def shares(text: str) -> np.ndarray:
    """Shares of symbols, capitals, digits and cries among the bytes, and the scaled log of the length."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = np.bincount(_classes[data], minlength=5)[1:]
    return np.append(n / max(1, len(data)), np.log1p(len(data)) / 12).astype(np.float32)


class Chain:
    """Fitted models of one chain; small enough to send to every executor."""

    def __init__(self, names: list[str], vocabulary: list[str]):
        self.names, self.vocabulary, self.models = names, {w: k for k, w in enumerate(vocabulary)}, []
        # What training has seen: a share beyond it counts as the nearest, so no model is carried on past its data.
        self.low, self.high = (np.full(len(vocabulary) + SHARES, v, np.float32) for v in (0, 1e9))

    def row(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.vocabulary) + SHARES, np.float32)
        out[[self.vocabulary[w] for w in words_in(text) & self.vocabulary.keys()]] = 1
        out[-SHARES:] = shares(text)
        return out

    def fit(self, x: np.ndarray, toxic: np.ndarray, fold: np.ndarray, l1: float) -> None:
        """x: words, then shares, of each text; toxic: 0, 1 or -1 (unknown)."""
        n = len(self.vocabulary)
        if len(x):
            self.low[n:], self.high[n:] = x[:, n:].min(axis=0), x[:, n:].max(axis=0)
        words, y = x[:, :n], kinds(x[:, :n], toxic)
        # What the other folds say of each: their marks, and which of the words stand out in them.
        others = [np.where(fold == f, -1, toxic).astype(np.int8) for f in range(FOLDS)]
        seen = [(kinds(words, t), np.concatenate([surprising(words, t), np.ones(SHARES, bool)])) for t in others]
        for k in range(len(self.names)):
            known = y[:, k] >= 0
            self.models.append(_fit(x[known], y[known, k], l1))
            out_of_fold = np.zeros(len(x), np.float32)
            for f, (marks, use) in enumerate(seen):
                use = np.concatenate([use, np.ones(k, bool)])  # and the categories before
                there = marks[:, k] >= 0
                w, b = _fit(x[there] * use, marks[there, k], l1)
                out_of_fold[fold == f] = sigmoid((x[fold == f] * use) @ w + b)
            x = np.column_stack([x, out_of_fold])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, x = np.zeros((len(x), len(self.models))), np.clip(x, self.low, self.high)
        for k, (w, b) in enumerate(self.models):
            out[:, k] = sigmoid(x @ w + b)
            x = np.column_stack([x, out[:, k]])
        return out


def _fit(x, y, l1):
    """No model can be fitted to one class: then its share is the answer."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1], np.float32), float(-30 if not len(y) or y.max() == 0 else 30)
    return logistic(x, y.astype(np.float32), l1=l1, rounds=500)


def kinds(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A column of 0, 1 or -1 (unknown) for each of CATEGORIES; x: which words each text holds, toxic: 0, 1 or -1."""
    known = toxic >= 0
    held, bad = x[known].sum(axis=0), x[known & (toxic == 1)].sum(axis=0)
    indicators = (held >= LEAST_DOCS) & (bad >= INDICATES * held)
    n = x[:, indicators].sum(axis=1)
    mark = lambda yes: np.where(known, (toxic == 1) & yes, -1).astype(np.int8)
    return np.column_stack([mark(n >= 1), mark(n >= 2), toxic.astype(np.int8)])


def surprising(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words stand out in toxic texts by LEAST_SURPRISE; x: which words each text holds, toxic: 0, 1 or -1."""
    known = toxic >= 0
    held, bad = x[known].sum(axis=0), x[known & (toxic == 1)].sum(axis=0)
    expected = held * (toxic[known].mean() if known.any() else 0.0)
    return (held >= LEAST_DOCS) & (bad > expected) & ((bad - expected) ** 2 / np.maximum(expected, 0.5) >= LEAST_SURPRISE)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text_hash, y, words, shares): at most `sample` distinct labelled texts."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = F.xxhash64(F.lit("chain"), "doc_id")
    chosen = marks.orderBy(order, "doc_id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Copies would weigh as often as they are copied: one row of each text. An id may have many texts.
    texts = texts.select("text", "y", F.xxhash64("text").alias("text_hash")).groupBy("text_hash").agg(F.max("y").alias("y"), F.first("text").alias("text"))
    texts = texts.orderBy(F.xxhash64(F.lit("chain"), "text_hash"), "text_hash").limit(sample)

    def words(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([sorted(words_in(t)) for t in found], pa.list_(pa.string())), pa.array([shares(t).tolist() for t in found], pa.list_(pa.float32()))],
                names=["text_hash", "y", "words", "shares"],
            )

    bags = bounded_batches(texts).select("text_hash", "y", "text").mapInArrow(words, "text_hash long, y int, words array<string>, shares array<float>")
    return stored(bags, "bags")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, l1: float = 4e-5) -> Chain:
    """Fit the chain on labelled documents; labels: (doc_id, toxic)."""
    bags = labelled(docs, labels, sample)
    of = bags.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).filter(F.col("n") >= LEAST_DOCS)
    total = bags.agg(F.count("*").alias("n"), F.sum("y").alias("bad")).first()
    expected = F.col("n") * F.lit((total.bad or 0) / max(1, total.n))
    surprise = F.pow(F.col("bad") - expected, 2) / F.greatest(expected, F.lit(0.5))
    # A long text holds nearly every word, so words that stand out by chance must stay out.
    top = of.filter((F.col("bad") > expected) & (surprise >= LEAST_SURPRISE)).orderBy(F.desc(surprise), "word").limit(VOCABULARY)
    chain = Chain(CATEGORIES, [r.word for r in top.select("word").collect()])
    index = F.create_map(*[F.lit(x) for w, k in chain.vocabulary.items() for x in (w, k)]) if chain.vocabulary else None
    kept = F.filter(F.transform("words", lambda w: F.try_element_at(index, w)), lambda x: x.isNotNull()) if chain.vocabulary else F.array().cast("array<int>")
    rows = bags.select("text_hash", "y", kept.alias("at"), "shares").orderBy("text_hash").collect()  # bounded by sample
    x = np.zeros((len(rows), len(chain.vocabulary) + SHARES), np.float32)
    for i, r in enumerate(rows):
        x[i, list(r["at"])] = 1
        x[i, -SHARES:] = r["shares"]
    fold = np.array([r["text_hash"] % FOLDS for r in rows], np.int64)
    chain.fit(x, np.array([r["y"] for r in rows], np.int8), fold, l1)
    return chain


def _predicted(chain: Chain, texts: pa.Array) -> np.ndarray:
    return chain.predict(np.stack([chain.row(t or "") for t in texts.to_pylist()]))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and one probability column p_<category> for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                p = _predicted(shared.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in p.T]], names=["doc_id", *[f"p_{n}" for n in shared.value.names]])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names)
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_insult, p_severe, p_toxic, toxic)."""
    return scored(docs, train(docs, labels, sample)).withColumn("toxic", F.col("p_toxic") >= threshold)


def nontoxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that toxicity() marks, whatever their doc_id: rows are scored and left out where they stand."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                yield part.filter(pa.array(_predicted(shared.value, part.column(at))[:, -1] < threshold))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
