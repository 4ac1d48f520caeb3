"""Quality rules over whole documents and over lines that many documents of a host share, in DataFrame functions only.

Base rules of a document: too few words, or too many words in passages that repeat inside it. Cross-document rule: a line
is normalised (lower case, digits to 0, white space to one space) and hashed; for each host (`source`) the documents that
hold the line are counted, once each; a line in more than `max_docs` documents and over `max_share` of the host's
documents is removed everywhere in that host; a document of which less than `least_left` of the words is left is
rejected.

Defined results: null texts have no words; a null source is a host of its own; a null doc_id is a document too; rows that
repeat doc_id, source and text are one document in the counts and get the same verdict. An empty table gives an empty
result. Other columns are not read by the verdicts. A row's words, their hashes and those of its windows are in one
task's memory at once, some 100 bytes a word, so a text of 100 MB needs about 2 GB there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, let, words_of

#: Windows are of 8 words: three doublings.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
MAX_DOCS, MAX_SHARE, LEAST_LEFT = 20, 0.02, 0.3
SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, first included; hashes: the word hashes of one text.

    Hashes of longer windows come from doubling; equal ones are found by one sort, so the cost is n log n.
    """

    def paired(xs: Column, step: int) -> Column:
        n = F.size(xs) - step
        return F.zip_with(F.slice(xs, 1, n), F.slice(xs, step + 1, n), lambda a, b: F.xxhash64(a, b))

    def covered(sorted_windows: Column) -> Column:
        like = lambda e, i: F.coalesce(F.get(sorted_windows, i)["h"] == e["h"], F.lit(False))
        twice = F.filter(sorted_windows, lambda e, i: like(e, i - 1) | like(e, i + 1))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")))["n"]

    def count(windows: Column) -> Column:
        # Nearly every text has no repeated window; only the others are sorted.
        indexed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(indexed, covered))

    def windows(h: Column) -> Column:
        return let(let(let(paired(h, 1), lambda two: paired(two, 2)), lambda four: paired(four, 4)), count)

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(windows(hashes))


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), text.alias("t"), words_of(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = sum((F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c))) for c in SYMBOLS), F.lit(0))
    spaces = F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))
    return rows.select(
        "doc_id", "source", "text_hash", F.size("w").cast("long").alias("n_words"), (F.length("t") - spaces).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.transform("w", lambda x: F.xxhash64(x)), repeated_words).cast("long").alias("n_repeat_words"),
    )


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def host_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, line, words): each distinct normalised line with a word, and its words over all its
    occurrences in the document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.explode(F.split(text, "\n")).alias("x")).select("doc_id", "source", "text_hash", normalised(F.col("x")).alias("x")).filter("x <> ''")
    words = F.length("x") - F.length(F.replace("x", F.lit(" "))) + 1
    return rows.select("doc_id", "source", "text_hash", F.xxhash64("x").alias("line"), words.cast("long").alias("words"))


def line_verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """base_counts() with lost_words, base_failed and kept for each row of docs."""
    base = base_counts(docs)
    keys = ["doc_id", "source", "text_hash"]
    host = F.coalesce("source", F.lit("\x00")).alias("host")
    once = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    sizes = once.groupBy(*keys).count().groupBy(host).agg(F.count("*").alias("docs"))
    # Rows of one document are summed where they are read; a document then counts once for each line.
    lines = host_lines(docs).groupBy(*keys, "line").agg(F.sum("words").alias("words"))
    counts = lines.groupBy(host, "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    often = counts.join(sizes, "host").filter(F.col("n") > F.col("docs") * max_share).select("host", "line")
    lost = lines.withColumn("host", host).join(often, ["host", "line"]).groupBy(*keys).agg(F.sum("words").alias("lost"))
    lost = lost.toDF("l_doc", "l_source", "l_hash", "lost")
    # Repeated rows of a document have each added their lines.
    times = once.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1").toDF("t_doc", "t_source", "t_hash", "times")
    same = lambda a: F.col("text_hash").eqNullSafe(F.col(f"{a}_hash")) & F.col("doc_id").eqNullSafe(F.col(f"{a}_doc")) & F.col("source").eqNullSafe(F.col(f"{a}_source"))
    rows = base.join(lost, same("l"), "left").join(times, same("t"), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.col("lost") / F.coalesce("times", F.lit(1)), F.lit(0)).cast("long")
    rows = rows.select(*base.columns, gone.alias("lost_words"), failed.alias("base_failed"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("lost_words") >= F.col("n_words") * least_left))


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """docs that line_verdicts() keeps, without their removed lines; other columns stay and may have any name."""
    keep, k_doc, k_source, k_hash, bad, b_doc, b_source, b_hash = fresh(docs, "keep", "k_doc", "k_source", "k_hash", "bad", "b_doc", "b_source", "b_hash")
    plain = docs.select("doc_id", "source", "text")
    verdicts = line_verdicts(plain, max_docs, max_share, least_left).filter("kept").select("doc_id", "source", "text_hash").distinct().toDF(k_doc, k_source, k_hash)
    host = F.coalesce("source", F.lit("\x00")).alias("host")
    once = host_lines(plain).select("doc_id", "source", "text_hash", "line").distinct()
    sizes = plain.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).distinct().groupBy(host).agg(F.count("*").alias("docs"))
    often = once.groupBy(host, "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).join(sizes, "host").filter(F.col("n") > F.col("docs") * max_share).select("host", "line")
    held = once.withColumn("host", host).join(often, ["host", "line"]).groupBy("doc_id", "source", "text_hash").agg(F.collect_list("line").alias(bad)).toDF(b_doc, b_source, b_hash, bad)
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = lambda t, doc, source, hash_: docs["doc_id"].eqNullSafe(t[doc]) & docs["source"].eqNullSafe(t[source]) & (h == t[hash_])
    rows = docs.join(verdicts, same(verdicts, k_doc, k_source, k_hash), "left_semi")
    rows = rows.join(held, same(held, b_doc, b_source, b_hash), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x: ~F.array_contains(held[bad], F.xxhash64(normalised(x)))), "\n")
    text = F.when(held[bad].isNull(), docs["text"]).otherwise(left).alias("text")
    return rows.select(*[text if c == "text" else docs[c] for c in docs.columns])
