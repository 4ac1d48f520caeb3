"""Lempel-Ziv phrase fingerprints of documents, and the likeness of two of them.

A text's UTF-8 bytes are parsed into dictionary phrases from left to right: each phrase is the shortest run that is not in
the dictionary yet, and enters it. Texts that compress well together share phrases. The phrase set is hashed, and the
KEPT smallest of its 32-bit hashes are the signature (bottom-k minimum hashing with one hash function; one of fewer is the
whole set). The likeness of two is, of the hashes up to which both signatures are complete, the share that both have: the
Jaccard similarity of the phrase sets if both are of fewer than KEPT phrases, else an estimate of it with a standard error
of at most 0.5 / sqrt(KEPT).

As the parse goes from left to right, texts with the same beginning share all phrases of it; a change early in a text
moves the later borders, but repeated content still falls into the same short phrases.

`beside` puts each document beside the next one in ascending order. Keys are cut into ranges at quantiles of a bounded
sample; a row goes to its range, and the first row of each range to the range before as well, so every range knows the
document behind its last. Texts are shuffled once; no task holds more than a few ranges, no window more than one.

Defined results: a null text is empty and has the empty fingerprint; two empty fingerprints are 1 alike, an empty and
another 0. Equal texts have equal fingerprints. A null doc_id comes first; rows with one doc_id are in the order of the hash
of their texts, and rows that are equal in both stand side by side in one range. Of a single document the next is itself;
an empty table gives an empty result; other columns are not read. Parsing a text costs its length times the length of its
phrases, which grows with the square root of a text that is one letter all along, and little with any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.window import Window

from tessera.llm.common import let
from tessera.llm.textvec import span_hashes

#: Hashes of a signature, and bytes of text whose phrases are hashed at once.
KEPT, BATCH = 128, 1 << 20
#: Rows of a range, the most ranges, and draws for each.
RANGE_ROWS, MOST_RANGES, DRAWS = 256, 1 << 14, 16
NULL_ID = -(1 << 63)


def phrase_sizes(data: bytes) -> list[int]:
    """Lengths of the dictionary phrases of a text's bytes, which follow one another. What is left at the end, if anything,
    is a phrase that is known already."""
    known, sizes, phrase = set(), [], ""
    add, append = known.add, sizes.append
    for c in data.decode("latin-1"):  # a character for each byte
        phrase += c
        if phrase not in known:
            add(phrase)
            append(len(phrase))
            phrase = ""
    return sizes


def signatures(texts: list[str]) -> list[str]:
    """Hexadecimal signatures: eight digits for each hash, in ascending order."""
    datas = [t.encode() for t in texts]
    sizes = [np.array(phrase_sizes(d), np.int64) for d in datas]
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
    data = np.frombuffer(b"".join(d[: int(n.sum())] for d, n in zip(datas, sizes, strict=True)), np.uint8)
    hashes = (span_hashes(data, ends[:-1], ends[1:]) >> np.uint64(32)).astype(np.uint32) if len(data) else np.zeros(0, np.uint32)
    return [np.unique(h)[:KEPT].astype(">u4").tobytes().hex() for h in np.split(hashes, np.cumsum([len(n) for n in sizes])[:-1])]


def likeness_of(a: str, b: str) -> float:
    """Of the hashes up to which both signatures are complete, the share that both have."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (a, b))
    known = min([int(s[-1]) for s in (x, y) if len(s) >= KEPT], default=1 << 32)
    x, y = x[x <= known], y[y <= known]
    every = len(np.union1d(x, y))
    return (len(x) + len(y) - every) / every


@F.pandas_udf(DoubleType())  # a name would need a session, which a worker that imports this has not
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fingerprints(docs: DataFrame, **texts: str) -> DataFrame:
    """docs without its columns `texts.values()`, and a fingerprint of each under its key. A text that several rows or
    columns of a batch hold is parsed once."""
    rest = [c for c in docs.columns if c not in texts.values()]
    schema = StructType([docs.schema[c] for c in rest])
    for c in texts:
        schema = schema.add(c, StringType())

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in texts.values()]
            size = sum(c.nbytes for c in columns)
            step = max(1, batch.num_rows * BATCH // max(1, size))
            for a in range(0, batch.num_rows, step):
                part = [[t or "" for t in c.slice(a, step).to_pylist()] for c in columns]
                each = list(dict.fromkeys(t for c in part for t in c))
                prints = dict(zip(each, signatures(each), strict=True))
                held = batch.slice(a, step)
                yield pa.RecordBatch.from_arrays([*(held.column(held.schema.get_field_index(c)) for c in rest), *(pa.array([prints[t] for t in c]) for c in part)], names=[*rest, *texts])

    return docs.mapInArrow(run, schema)


def _place(cuts: list[tuple], key: Column) -> Column:
    """How many cuts are at or below the key: a search in two steps, so a row meets few of them."""
    lit = lambda xs: F.from_json(F.lit("[" + ",".join(f'{{"d":{d},"h":{h}}}' for d, h in xs) + "]"), "array<struct<d:long,h:long>>")
    wide = max(1, int(len(cuts) ** 0.5))
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    low = F.greatest(F.lit(0), (count(lit(cuts[::wide])) - 1) * wide)
    return let(low, lambda at: at + count(F.slice(lit(cuts), at + 1, F.lit(wide)))) if cuts else F.lit(0)


def beside(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): every document's text and that of the document behind it; behind the last comes the first."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.struct(F.coalesce(doc_id, F.lit(NULL_ID)).alias("d"), F.xxhash64(text).alias("h")).alias("key"))
    total = rows.agg(F.count("*").alias("n"), F.min("key").alias("first")).first()
    ranges = min(MOST_RANGES, total.n // RANGE_ROWS)
    cuts: list[tuple] = []
    if ranges > 1:
        every = max(1, total.n // (DRAWS * ranges))
        drawn = sorted((r.key.d, r.key.h) for r in rows.filter(F.pmod(F.xxhash64("key.d", "key.h"), F.lit(every)) == 0).select("key").collect())  # about DRAWS for each range
        cuts = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)} - {tuple(total.first)}) if drawn else []
    found = _place(cuts, F.col("key"))
    is_cut = let(found, lambda at: (at > 0) & (F.get(F.from_json(F.lit("[" + ",".join(f'{{"d":{d},"h":{h}}}' for d, h in cuts) + "]"), "array<struct<d:long,h:long>>"), at - 1) == F.col("key"))) if cuts else F.lit(False)
    to = lambda at, extra: F.struct(at.cast("int").alias("range"), F.lit(extra).alias("extra"))
    first = F.col("key") == F.struct(F.lit(total.first.d if total.n else 0).cast("long").alias("d"), F.lit(total.first.h if total.n else 0).cast("long").alias("h"))
    placed = rows.withColumn("at", found).withColumn("cut", is_cut)
    goes = F.filter(F.array(to(F.col("at"), 0), F.when(F.col("cut"), to(F.col("at") - 1, 1)), F.when(first, to(F.lit(len(cuts)), 1))), lambda x: x.isNotNull())
    placed = placed.select("doc_id", "text", "key", F.inline(goes))
    behind = F.lead("text").over(Window.partitionBy("range").orderBy("extra", "key"))
    return placed.withColumn("next", behind).filter("extra = 0").select("doc_id", "text", "next")


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, next) of documents beside their next: the last quarter of a text, rounded down to
    code points, gives way to as many of the next one's first."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    new = F.concat(F.left("text", F.length("text") - quarter), F.left("next", quarter))
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", new.alias("edited"), "next")


def likenesses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = edited(beside(docs)).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = fingerprints(rows, fingerprint="text", edited_fingerprint="edited", next_fingerprint="next")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
