"""Phrase collocation mining, by language.

Texts are cut into pieces at punctuation and line ends and those into words; all runs of 1 to max_n words of a piece are
exploded into rows and counted by language and phrase. As hardly any long phrase comes again, that is done in two passes.
In the first the rows of two words and more are 48-bit hashes of language and phrase; those of a batch of about BATCH
bytes of text are counted where they are made, dealt out by hash and summed. The hashes that reach `least` are put into a
Bloom filter of a fixed number of bits. In the second pass the phrases the filter lets through, and all single words, are
exploded as strings and counted. A hash counts at least what each of its phrases does and the filter holds all of
them, so no phrase that reaches `least` is missed, and the counts are those of the strings: a full filter would cost
rows, not results.

A candidate is a phrase of two or more words with at least `least` occurrences. Each of its cuts is joined with the counts
of its first and its remaining words; the score is floor(1000000 * a * a / (l * r)) in 38-digit decimals, and the
lowest-scoring cut counts (ties: the smallest first part). A candidate goes if a longer one that holds it has at least
`share` per cent of its occurrences: an anti-join with the candidates one word longer, cut at either end. That is enough,
as whatever lies between two phrases, one inside the other, occurs at least as often as the longer. Ranks are taken in two
steps, in SALTS shares of each language and then over what those kept, so no task sorts a whole language.

Only counts that reach `least` leave the aggregation, and those of single words: what a candidate is cut into occurs at
least as often as the candidate.

Defined results: null texts are empty, a null language is `und`; a text of any length is read whole, its phrases in steps
of STEP words; repeated rows and doc_ids count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import let, small_batches, stored
from tessera.llm.textvec import BASE, mix, pieces, span_hashes, word_spans

#: Fixed by the contract: what ends a piece, what else ends a word, and the letters that are lower-cased.
PIECE_ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
ENDS_PIECE = np.isin(np.arange(256), [ord(c) for c in PIECE_ENDS])
IN_WORD = ~(ENDS_PIECE | np.isin(np.arange(256), [ord(c) for c in BLANKS]))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Bytes of text and words whose phrases are counted at once, and shares of a language in the first ranking.
BATCH, STEP, SALTS = 4 << 20, 1 << 15, 64
#: Bits of a phrase's hash and of the filter, and where in a hash its places in the filter begin.
HASH_BITS, FILTER_BITS, PLACES = 48, 27, (0, 21)
WIDE = "decimal(38,0)"


class Words:
    """The words of some texts in lower case: where they are, in which text, and in which piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.row = word_spans(data, offsets, IN_WORD)
        self.piece = np.cumsum(ENDS_PIECE[data])[self.starts] + self.row  # grows at each end of a piece and of a text

    def steps(self, max_n: int):
        """(first, end) of runs of words; phrases begin in the first STEP of a run."""
        for a in range(0, len(self.starts), STEP):
            yield a, min(len(self.starts), a + STEP + max_n - 1)

    def whole(self, a: int, b: int, k: int) -> np.ndarray:
        """Whether the run of k + 1 words from each word on is in one piece and begins in this step."""
        return (np.arange(b - a - k) < STEP) & (self.piece[a + k : b] == self.piece[a : b - k])


def _language_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    hashes = np.array([zlib.crc32(x.encode()) for x in coded.dictionary.to_pylist()], np.uint64)
    return mix(hashes)[coded.indices.to_numpy()]


def hashes(words: Words, langs: np.ndarray, max_n: int):
    """(k, first word, end, HASH_BITS-bit hashes) of all runs of k + 1 words that begin at these words, whole or not."""
    for a, b in words.steps(max_n):
        low = int(words.starts[a])
        held = span_hashes(words.data[low : words.ends[b - 1]], words.starts[a:b] - low, words.ends[a:b] - low)
        run = mix(held ^ langs[words.row[a:b]])
        for k in range(1, max_n):
            run = mix(run[: b - a - k] * np.uint64(BASE) + held[k:])
            yield k, a, b, run >> np.uint64(64 - HASH_BITS)


def phrases(words: Words, langs: pa.Array, max_n: int, wanted=None):
    """Arrays of `phrase, tab, language`, one entry for each occurrence; a tab stands before single words too. wanted(h): of
    longer phrases, which hashes to form."""
    lang_hashes = _language_hashes(langs)
    hashed = hashes(words, lang_hashes, max_n)
    for a, b in words.steps(max_n):
        low, high = int(words.starts[a]), int(words.ends[b - 1])
        at = np.zeros(b - a + 1, np.int32)
        np.cumsum(words.ends[a:b] - words.starts[a:b], out=at[1:])
        held = words.data[low:high]
        each = pa.StringArray.from_buffers(b - a, pa.py_buffer(at), pa.py_buffer(held[IN_WORD[held]]))
        lang = langs.take(pa.array(words.row[a:b]))
        for k in range(max_n):
            begin = words.whole(a, b, k)
            if k:
                h = next(hashed)[3]
                begin &= wanted(h) if wanted else True
            begin = np.flatnonzero(begin)
            run = each.take(pa.array(begin))
            for j in range(1, k + 1):
                run = pc.binary_join_element_wise(run, each.take(pa.array(begin + j)), " ")
            yield pc.binary_join_element_wise(*([] if k else [""]), run, lang.take(pa.array(begin)), "\t")


def _batches(batches):
    """(words, languages) of runs of texts of about BATCH bytes."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0), "und")
        for row, rows, data, offsets in pieces(batch.column(1), BATCH):
            if len(data):
                yield Words(LOWER[data], offsets), langs.slice(row, rows)


def frequent_filter(texts: DataFrame, max_n: int, least: int) -> np.ndarray:
    """The Bloom filter of the hashes of all phrases of two and more words that reach `least`: 2**FILTER_BITS bits in words of
    64. Its words are put together by Spark; the driver gets at most 2**(FILTER_BITS - 6) of them."""

    def run(batches):
        for words, langs in _batches(batches):
            found = [h[words.whole(a, b, k)] for k, a, b, h in hashes(words, _language_hashes(langs), max_n)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield from pa.table({"h": h.view(np.int64), "n": n}).to_batches(1 << 16)

    # Counted in their batches already, the rows are dealt out as they are: a second count before the shuffle finds little.
    sums = texts.mapInArrow(run, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    place = F.explode(F.array(*[F.shiftright("h", low) % (1 << FILTER_BITS) for low in PLACES])).alias("p")
    filled = sums.select(place).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits"))
    table, out = filled.toArrow(), np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for low in PLACES:
        p = (h >> np.uint64(low)) & np.uint64(64 * len(bits) - 1)
        ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, f): phrases of at least `least` occurrences, and every single word."""
    texts = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(frequent_filter(texts, max_n, least))  # of a fixed size

    def run(batches):
        for words, langs in _batches(batches):
            found = pa.table({"key": pa.chunked_array(list(phrases(words, langs, max_n, lambda h: _passes(held.value, h))), pa.string())})
            counts = found.group_by("key", use_threads=False).aggregate([([], "count_all")]).select(["key", "count_all"])
            yield from counts.rename_columns(["key", "n"]).to_batches(1 << 16)

    counts = texts.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | F.startswith("key", F.lit("\t")))
    parts = let(F.ltrim("key", F.lit("\t")), lambda key: F.struct(F.substring_index(key, "\t", 1).alias("phrase"), F.substring(key, F.instr(key, "\t") + 1, F.length(key)).alias("lang")))
    return counts.select(parts.alias("k"), "f").select("k.lang", "k.phrase", "f")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a) with l, r and score of their lowest-scoring cut."""
    words = F.split("phrase", " ", -1)
    join = lambda xs: F.array_join(xs, " ")
    cut = lambda k: F.struct(k.alias("at"), join(F.slice(words, 1, k)).alias("left"), join(F.slice(words, k + 1, F.size(words))).alias("right"))
    cuts = candidates.select("lang", "phrase", "a", F.inline(F.transform(F.sequence(F.lit(1), F.size(words) - 1), cut)))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(CAST(1000000 AS {WIDE}) * CAST(a AS {WIDE}) * CAST(a AS {WIDE})) DIV (CAST(l AS {WIDE}) * CAST(r AS {WIDE}))")
    lowest = F.min(F.struct(score.alias("score"), "at", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def unextended(candidates: DataFrame, share: int = 50) -> DataFrame:
    """candidates (lang, phrase, a) that no candidate one word longer holds at `share` per cent of their occurrences."""
    first_off, last_off = F.regexp_replace("phrase", r"^[^ ]+ ", ""), F.regexp_replace("phrase", r" [^ ]+$", "")
    longer = candidates.select("lang", F.explode(F.array(first_off, last_off)).alias("phrase"), F.col("a").alias("more")).filter(F.contains("phrase", F.lit(" ")))
    best = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    c, b = candidates.alias("c"), best.alias("b")
    return c.join(b, (F.col("c.lang") == F.col("b.lang")) & (F.col("c.phrase") == F.col("b.phrase")) & (100 * F.col("b.more") >= share * F.col("c.a")), "left_anti")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases."""
    with small_batches(docs.sparkSession):
        counts = stored(phrase_counts(docs, max_n, least), "phrases")
    many = F.contains("phrase", F.lit(" "))
    totals = counts.filter(~many).groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = counts.filter(many).select("lang", "phrase", F.col("f").alias("a"))
    rows = scored(unextended(candidates, share), counts.filter(F.col("f") >= least))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
