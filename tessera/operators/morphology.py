"""Parses of words that a lexicon lacks, and the punctuation report that needs them.

A lexicon is a table (form, rank, pos, case, number, gender): the parses of each form, in lower case with е for ё, ordered by rank. A
form it lacks is parsed by its ending: the endings of up to LONGEST letters of all forms of open classes are counted by
parse, and the longest ending that any form shares gives its parses, the commonest first. Words meet endings by an
equi-join; the table of endings has a row for each ending and parse of the lexicon, whatever the texts hold.

Defined results: a word too short to leave STEM letters before an ending, or whose endings no form shares, has no parse; ties
go by part of speech, case, number and gender; null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import style as S

#: Letters of the longest ending, and the fewest before it.
LONGEST, STEM = 5, 2
#: Classes that new words belong to.
OPEN = ("NOUN", "ADJF", "ADJS", "VERB", "INFN", "PRTF", "PRTS", "GRND", "ADVB")
PARSE = ("pos", "case", "number", "gender")


def norm(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("ё"), F.lit("е"))


def _endings(form: str) -> Column:
    """A form's endings of 1 to LONGEST letters."""
    most = F.least(F.lit(LONGEST), F.length(form) - STEM)
    return F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda k: F.right(form, k))).otherwise(F.array().cast("array<string>"))


def endings(lexicon: DataFrame) -> DataFrame:
    """(ending, pos, case, number, gender, n): how many forms of open classes have the ending and the parse."""
    rows = lexicon.filter(F.col("pos").isin(*OPEN)).select("form", *PARSE).distinct()
    return rows.select(F.explode(_endings("form")).alias("ending"), *PARSE).groupBy("ending", *PARSE).agg(F.count("*").alias("n"))


def parses(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(form, rank, pos, case, number, gender, known) of the distinct words (column form). No words are broadcast: they grow with
    the texts, and Spark's estimate of them is far too small."""
    forms = words.select(norm(F.col("form")).alias("form")).distinct()
    known = forms.join(lexicon.hint("merge"), "form").select("form", "rank", *PARSE, F.lit(True).alias("known"))
    table = endings(lexicon)
    tried = forms.join(lexicon.select("form").distinct().hint("merge"), "form", "left_anti").select("form", F.explode(_endings("form")).alias("ending"))
    longest = tried.join(table.select("ending").distinct().hint("merge"), "ending").groupBy("form").agg(F.max(F.struct(F.length("ending").alias("size"), "ending")).alias("e"))
    order = Window.partitionBy("form").orderBy(F.desc("n"), *PARSE)
    guessed = longest.select("form", F.col("e.ending").alias("ending")).join(table.hint("merge"), "ending").select("form", F.row_number().over(order).alias("rank"), *PARSE, F.lit(False).alias("known"))
    return known.unionByName(guessed)


def comma_hints(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, at, to, was, becomes): where a comma lacks, before token `at`, with the words around it: before a participle
    behind the noun it agrees with, and before a clause with котор-, by the parses of all words of the texts."""
    toks = rows.select(key, F.posexplode(S.token_offsets(F.col(text))).alias("i", "t")).select(key, "i", F.col("t.token").alias("t"), F.col("t.begin").alias("b"))
    forms = parses(toks.filter(F.rlike("t", F.lit("^[А-Яа-яЁё]"))).select(F.col("t").alias("form")), lexicon)
    participles = S.participle_commas(rows, key, text, forms).select(key, "at", (F.col("at") + 1).alias("to"))
    clauses = S.clause_commas(rows, key, text, forms).select(key, "at", "to")
    return in_context(rows, key, text, toks, participles.unionByName(clauses))


def in_context(rows: DataFrame, key: str, text: str, toks: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (key, at, to) with the text from the word before `at` or the one before that, to the token behind `to`, as it was
    and with the comma. Both sides of each join grow with the texts and their sizes are estimated far too small, so none is
    broadcast."""
    w = Window.partitionBy(key).orderBy("i")
    word = F.rlike("t", F.lit("^[А-Яа-яЁё]"))
    toks = toks.withColumn("word", word)
    begin = F.when(F.lag("word", 2).over(w), F.lag("b", 2).over(w)).when(F.lag("word", 1).over(w), F.lag("b", 1).over(w)).otherwise(F.col("b"))
    end = F.coalesce(F.lead("b").over(w) + F.length(F.lead("t").over(w)), F.col("b") + F.length("t"))
    placed = toks.select(key, "i", "b", begin.alias("begin"), end.alias("end"), F.max("i").over(Window.partitionBy(key)).alias("last"))
    last = placed.select(key, "last").distinct()
    hits = hits.join(last.hint("merge"), key).withColumn("to", F.least("to", "last")).drop("last")
    starts = placed.select(key, F.col("i").alias("at"), "b", "begin")
    ends = placed.select(key, F.col("i").alias("to"), "end")
    found = hits.join(starts.hint("merge"), [key, "at"]).join(ends.hint("merge"), [key, "to"]).join(rows.select(key, F.col(text).alias("x")).hint("merge"), key)
    was = F.substring("x", F.col("begin") + 1, F.col("end") - F.col("begin"))
    cut = F.col("b") - F.col("begin")
    becomes = F.concat(F.regexp_replace(F.substring(was, F.lit(1), cut), r"(?U)\s+$", ""), F.lit(", "), F.substring(was, cut + 1, F.length(was)))
    return found.select(key, "at", "to", was.alias("was"), becomes.alias("becomes"))
