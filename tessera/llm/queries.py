"""The opN_ queries: each operator with its production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, collocations, decontaminate, line_rules, mixing, phrase_prints, rule_ensemble, sharding, simhash_dedup, spelling, surrogates, token_output, toxicity
from tessera.llm.common import stored

TOXIC_AT = 0.4
SURROGATE_KEY = b"tessera surrogates 1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to token ids in patched frame-of-reference segments, read back from the files."""
    return token_output.token_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier chain probabilities and the verdict for every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), TOXIC_AT)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and their best window."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every take of a document under the repetition limit."""
    got = mixing.mixed(_table(spark, sf_dir, "documents"), limit=mixing.LIMIT)
    return got.select("doc_id", "source", "n_words", "block", F.round("weight", 9).alias("weight"), "key")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by rules learned without the held-out labels."""
    return rule_ensemble.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, n=4, seed=42)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "stays")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and one conversation more, whose texts are control strings."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return table.unionByName(tricky)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations; references in their texts are typed parts."""
    turns = _conversations(spark, sf_dir)
    chats = chat_format.formatted(turns.select("conv_id", "turn", "role", chat_format.parts_of(F.col("text")).alias("parts")))
    chats = stored(chats, "chats")
    back = chat_format.read_back(chats)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    loss = F.array_join("loss_texts", "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(every).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars",
        "n_attachments", "expanded_tokens",
    )


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for its private data."""
    return surrogates.anonymised(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of near-equal bytes."""
    got = sharding.sharded(_table(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    got = line_rules.line_verdicts(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")


def op11_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and its edited text, and their likeness to each other and the next document."""
    return phrase_prints.likenesses(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its form and root."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    import corpus_pipeline  # noqa: F401  the pipeline is part of this subpackage

    found = [op1_token_blocks, op2_toxicity_chain, op3_decontaminate, op4_temperature_mix, op5_rule_ensemble, op6_simhash, op7_chat_format, op8_surrogates, op9_shards, op10_line_rules, op11_phrase_prints, op12_spelling, op13_collocations, pipeline]
    return {f.__name__: f for f in found}


WORDS = r"'[^\x20\x09-\x0D]+'"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS sk, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS n FROM documents),
t AS (SELECT sk, sum(n)::BIGINT AS words FROM w GROUP BY sk HAVING sum(n) > 0),
a AS (SELECT sum(words)::DOUBLE AS total, max(words) / sum(words)::DOUBLE AS high, min(words) / sum(words)::DOUBLE AS low FROM t),
b(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN pow(high / low, 1 - (lo + hi) / 2) <= {mixing.LIMIT} THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(high / low, 1 - (lo + hi) / 2) <= {mixing.LIMIT} THEN (lo + hi) / 2 ELSE hi END
  FROM b, a WHERE k < {mixing.STEPS}),
e AS (SELECT hi AS e FROM b WHERE k = {mixing.STEPS}),
z AS (SELECT sum(pow(words / total, e)) AS z FROM t, a, e),
q AS (
  SELECT sk, words, pow(words / total, e) / z AS weight,
         greatest(round(total * high / (pow(high, e) / z) * (pow(words / total, e) / z))::BIGINT, words) AS quota
  FROM t, a, e, z),
r AS (
  SELECT w.*, weight, coalesce(quota // words, 1) AS whole, coalesce(quota % words, 0) AS rest FROM w LEFT JOIN q USING (sk)),
f AS (SELECT doc_id, source, sk, n, weight, unnest(range(whole)) AS block FROM r),
l AS (
  SELECT doc_id, source, sk, n, weight, whole AS block, rest,
         md5(concat_ws('|', '42', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''), sk)) AS key FROM r WHERE rest > 0),
p AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY sk ORDER BY key, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, source, n AS n_words, block::BIGINT AS block, round(weight, 9) AS weight,
       md5(concat_ws('|', '42', block::VARCHAR, coalesce(doc_id::VARCHAR, ''), sk)) AS key FROM f
UNION ALL
SELECT doc_id, source, n, block::BIGINT, round(weight, 9), key FROM p WHERE before < rest
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS et,
         replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') AS er,
         regexp_replace(text, '!\[[^\]\n]*\]\([^()\s]+\)', '', 'g') AS bare,
         list_transform(regexp_extract_all(text, '!\[[^\]\n]*\]\([^()\s]+\)'), lambda r: CASE
           WHEN regexp_matches(r, '(?i)\.(?:mp3|wav|ogg|flac)\)$') THEN 'audio'
           WHEN regexp_matches(r, '(?i)\.(?:pdf|docx|txt)\)$') THEN 'document' ELSE 'image' END) AS kinds
  FROM t),
y AS (
  SELECT *, coalesce(sum(len(kinds)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, er, et ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM x),
z AS (
  SELECT *, length(replace(replace(replace(bare, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
         + coalesce(list_sum(list_transform(kinds, lambda k, i: 5 + length(k) + length((ahead + i)::VARCHAR))), 0) AS chars FROM y)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, er, et)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(18 + length(er) + chars))::BIGINT AS formatted_chars, sum(len(kinds))::BIGINT AS n_attachments,
       sum(coalesce(list_sum(list_transform(kinds, lambda k: CASE k WHEN 'audio' THEN 25 WHEN 'document' THEN 800 ELSE 256 END)), 0))::BIGINT AS expanded_tokens
FROM z GROUP BY conv_id
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS host, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, regexp_extract_all(t, {WORDS}) AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM s),
g AS (
  SELECT rid, i, concat_ws(chr(31), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
         lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS gram, lead(word, 7) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE whole),
m AS (SELECT rid, lead(i) OVER (PARTITION BY rid ORDER BY i) - i AS gap FROM h WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(gap, 8)))::BIGINT AS n_repeat FROM m GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, line FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM lw GROUP BY rid),
nl AS (SELECT rid, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM lw),
nx AS (SELECT rid, x, sum(len(string_split(x, ' ')))::BIGINT AS words FROM nl GROUP BY rid, x),
one AS (SELECT host, doc_id, t, min(rid) AS rid FROM d GROUP BY host, doc_id, t),
sizes AS (SELECT host, count(*) AS docs FROM one GROUP BY host),
often AS (
  SELECT host, x FROM nx JOIN one USING (rid) JOIN sizes USING (host) GROUP BY host, x, docs
  HAVING count(*) > {line_rules.MAX_DOCS} AND count(*) > docs * {line_rules.MAX_SHARE}),
lost AS (SELECT rid, sum(words)::BIGINT AS lost FROM nx JOIN d USING (rid) JOIN often USING (host, x) GROUP BY rid),
r AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_words
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       lost_words, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost_words >= n_words * {line_rules.LEAST_LEFT} AS kept
FROM r
"""


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, {AZ}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT d, run, count(*) AS c FROM o WHERE length(run) >= 5 GROUP BY d, run),
b AS (
  SELECT run, c, flatten(list_transform(string_split(d || ':' || run, ''),
         lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes FROM r),
h AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295], bytes), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM b, crc),
m AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other FROM del a JOIN del b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT del.word, v.word FROM del JOIN v ON rest = v.word
  UNION SELECT v.word, del.word FROM del JOIN v ON rest = v.word),
best AS (
  SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS place
  FROM near JOIN v ON other = v.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word AND place = 1),
way AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN way USING (word) JOIN f AS last ON way.at = last.word WHERE last.form IS NULL
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(text, {AZ}) AS t FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
         list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS f FROM o GROUP BY lang, phrase),
s AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE phrase NOT LIKE '% %' GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= 10 AND phrase LIKE '% %'),
k AS (SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM x),
e AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a AS more FROM c WHERE len(ws) = 3 UNION ALL SELECT lang, array_to_string(ws[2:], ' '), a FROM c WHERE len(ws) = 3),
z AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM y WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.lang = y.lang AND e.phrase = y.phrase AND 100 * e.more >= 50 * y.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN s USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_temperature_mix": OP4, "op7_chat_format": OP7, "op10_line_rules": OP10, "op12_spelling": OP12, "op13_collocations": OP13}
