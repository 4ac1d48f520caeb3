"""Spelling variants: words one edit apart, met by errata-trie merging, and the commoner form of each.

The words are a trie whose nodes are prefixes. A node's heavy child is the one with the most words below it (an end of word
is a child too, but never heavy). A word's path to the root leaves the heavy paths on at most log2(words) light edges, and
only there is it merged into the other subtrees of the node, its letter behind the node skipped or replaced:

- replaced by the heavy letter, it meets the heavy subtree's words; replaced by a wildcard, those of the other light ones;
- skipped, it meets the node's words without that letter;
- with the heavy letter put before it, it meets the heavy subtree's words that are one letter longer.

What coincides at a terminal is one edit apart, and each pair coincides once: at the node where a replaced letter stands,
or behind the last of the equal letters of which one is missing. Subtrees are small-to-large by construction: the heavy
one is never enumerated.

On Spark: sizes are counts by (node, letter), summed before they are shuffled; light edges are an equi-join of the words'
edges with the branching nodes, in which the nodes of up to two letters (at most 1 + 90 + 90 ** 2 of them) are broadcast, as
every word passes them; terminals meet the words by equi-joins on the whole changed word, and each other by the key with
the wildcard, of which one holds at most a word for each letter. No pair within a group is formed: a member of n counts n
- 1 others, and knows the best of them. Prefixes longer than BLOCK letters are named by a digest and the letters behind
it, so a very long word costs its length.

A word's form is its near word of largest count (ties: smallest) if that is `times` its own or more. Forms form chains whose
counts grow `times`-fold, so their roots are found in a few rounds in which each word takes its form's form.

Defined results: null texts have no words; a null doc_id is empty in the damage key; repeated rows and doc_ids count each;
an empty table gives an empty result; words of any length are whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a prefix between digests, and prefixes up to this length are broadcast.
BLOCK, TOP = 64, 2
#: Not a letter: stands for any in a key.
ANY = "*"


def word_counts(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of Latin letters in lower case, one of `every` with a letter missing, that are long and common enough."""
    text = F.translate(docs["text"].cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit("([a-zÀ-ÿ]+)"), F.lit(1))).alias("run"))
    runs = runs.filter(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.left("run", at), _from("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _from(word: str | Column, at: Column) -> Column:
    """The letters from place `at` (the first is 1) on."""
    return F.substring(word, at, F.length(word))


def _nodes(word: Column) -> Column:
    """Names of the prefixes of 0, 1, ... letters: the letters themselves, or a digest and those behind it."""

    def named(k: Column) -> Column:
        head = F.when(k > 0, F.concat(F.md5(F.left(word, k * BLOCK).cast("binary")), F.lit(":"), k.cast("string"), F.lit(":"))).otherwise(F.lit(""))
        own = F.substring(word, k * BLOCK + 1, F.lit(BLOCK))
        return let(F.struct(head.alias("head"), own.alias("own")), lambda x: F.transform(F.sequence(F.lit(0), F.least(F.lit(BLOCK - 1), F.length(word) - k * BLOCK)), lambda j: F.concat(x["head"], F.left(x["own"], j))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.length(word) / BLOCK).cast("int")), named))


def _edges(words: DataFrame, *columns: str) -> DataFrame:
    """(columns, depth, node, letter): each word's way down; the last letter is empty."""
    edges = let(_nodes(F.col("word")), lambda nodes: F.transform(nodes, lambda node, d: F.struct(d.alias("depth"), node.alias("node"), F.substring("word", d + 1, F.lit(1)).alias("letter"))))
    return words.select(*columns, F.inline(edges))


def branching(words: DataFrame) -> DataFrame:
    """(node, depth, heavy): nodes with two children or more, and the letter of the heavy one."""
    sizes = _edges(words).groupBy("node", "letter").agg(F.count("*").alias("size"), F.first("depth").alias("depth"))
    heavy = F.max(F.struct((F.col("letter") != "").alias("real"), "size", "letter"))
    return sizes.groupBy("node").agg(F.first("depth").alias("depth"), F.count("*").alias("children"), heavy.alias("h")).filter("children > 1").select("node", "depth", F.col("h.letter").alias("heavy"))


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, depth, letter, heavy): the light edges of each word's path."""
    nodes = stored(branching(words), "branching")
    name = F.when(F.length("word") <= BLOCK, F.col("word")).otherwise(F.concat(F.lit("#"), F.md5(F.col("word").cast("binary"))))
    named = words.withColumn("name", name)  # edges of long words don't carry them
    edges = _edges(named, "name")
    top = nodes.filter(F.col("depth") <= TOP).select("node", "heavy")
    deep = nodes.filter(F.col("depth") > TOP).select("node", "heavy")
    light = edges.filter(F.col("depth") <= TOP).join(F.broadcast(top), "node").unionByName(edges.filter(F.col("depth") > TOP).join(deep, "node")).filter("letter <> heavy")
    return light.select("name", "depth", "letter", "heavy").join(named, "name").select("word", "n", "depth", "letter", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and the commonest of them as (-n, word)."""
    light = stored(light_edges(words), "light")
    d, head = F.col("depth"), F.left("word", F.col("depth"))
    behind, rest = _from("word", d + 2), _from("word", d + 1)
    last = F.substring("word", d + 2, F.lit(1)) != F.col("letter")  # of equal letters the last is skipped
    changed = F.array(F.concat(head, "heavy", rest), F.when(F.col("letter") != "", F.concat(head, "heavy", behind)), F.when((F.col("letter") != "") & last, F.concat(head, behind)))
    changed = light.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(changed).alias("word")).filter("word IS NOT NULL")
    met = changed.join(words, "word")  # a pair each
    both = F.array(F.struct(F.col("word").alias("word"), (-F.col("a_n")).alias("m"), F.col("a").alias("near")), F.struct(F.col("a").alias("word"), (-F.col("n")).alias("m"), F.col("word").alias("near")))
    one = met.select(F.inline(both)).select("word", F.lit(1).cast("long").alias("others"), F.struct("m", "near").alias("best"))
    # Light subtrees of one node: a key has a word for each letter at most.
    key = F.concat(head, F.lit(ANY), behind)
    groups = light.filter("letter <> ''").groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("near")))).alias("g")).filter("size(g) > 1")
    many = groups.select((F.size("g") - 1).cast("long").alias("others"), F.col("g")[0].alias("first"), F.col("g")[1].alias("second"), F.posexplode("g").alias("at", "own"))
    many = many.select(F.col("own.near").alias("word"), "others", F.when(F.col("at") == 0, F.col("second")).otherwise(F.col("first")).alias("best"))
    return one.unionByName(many).groupBy("word").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each word takes its form's form until none has one. Counts grow along a chain, so
    there are no rings, and a chain of k words takes log2(k) rounds."""
    going = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = going.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = going.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        going = stored(step, "roots")
        if going.filter("moved").isEmpty():
            return going.select("word", "root")
        going = going.select("word", "root")


def variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = stored(word_counts(docs, every, shortest, least), "words")
    near = near_words(words)
    best_n = -F.col("best.m")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), best_n.alias("n"))).alias("f"))
    formed = stored(formed.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "formed")
    found = roots(formed.filter("form IS NOT NULL"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
