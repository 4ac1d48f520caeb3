"""Phrase fingerprints, spelling variants and collocations: brute force, SQL, and the odd cases of their docstrings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, phrase_prints, queries, spelling

DOCS = "doc_id long, text string, lang string"
PIECES = ["er", "en", "tion", "an", "é", "st", "ou", "th", "ÿ", "ß", "a", "o"]


def word(rng, most=4):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, most)))


def odd_rows():
    """Nulls in each column, empty and long texts, ties, repeated rows, doc_ids that repeat."""
    rng = random.Random(11)
    out = [(k, " ".join(word(rng) for _ in range(rng.randrange(0, 80))), rng.choice(["en", "fr"])) for k in range(120)]
    out += [(None, "Keine Nummer, keine", "de"), (None, None, None), (500, "", "en"), (501, None, "en"), (502, "x", None), (503, "Two  words\there", "")]
    out += [out[3], out[3], (7, "another with the number seven", "en"), (504, "ab " * 3000, "en"), (505, "ab " * 3000, "en"), (506, "q" * 700, "en"), (507, "Q" * 700 + "\nq", "en"), (508, "q" * 700 + "!", "fr")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(1).alias(c) for c in ("n", "key", "word", "next", "range", "form", "phrase", "a")]
    return spark.createDataFrame(odd_rows(), DOCS).select("*", *extra).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


# Phrase fingerprints


def naive_phrases(text):
    """The dictionary parse by its definition, on bytes."""
    data, known, at = text.encode(), [], 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.append(data[at:end])
            at = end
    return known


def test_phrases_follow_the_definition():
    rng = random.Random(1)
    for text in ["", "a", "aaaaaa", "ababababab", "Ünï ☃ 日本", *("".join(rng.choice("abé ") for _ in range(rng.randrange(200))) for _ in range(50))]:
        sizes, want = phrase_prints.phrase_sizes(text.encode()), naive_phrases(text)
        assert sizes == [len(p) for p in want]
        assert text.encode().startswith(b"".join(want))
        assert len(set(want)) == len(want)


def test_likeness_is_exact_for_short_texts_and_near_for_long():
    rng = random.Random(2)
    for size in (0, 1, 40, 200, 20_000):
        base = "".join(rng.choice("abcdefgh ") for _ in range(size))
        for other in (base, base[: size * 3 // 4] + "xyz" * (size // 12), "".join(rng.choice("abcdefgh ") for _ in range(size)), ""):
            a, b = set(naive_phrases(base)) if size < 1000 else None, set(naive_phrases(other)) if size < 1000 else None
            got = phrase_prints.likeness_of(*phrase_prints.signatures([base, other]))
            assert 0 <= got <= 1
            if base == other:
                assert got == 1
            if a is not None and max(len(a), len(b)) < phrase_prints.KEPT:
                assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1)


def test_prints_equal_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # one row for each doc_id: the next one is certain
    got = {r.doc_id: r for r in phrase_prints.likenesses(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    order = sorted((r[0], r[1] or "") for r in rows)
    assert len(got) == len(order)
    for (d, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        own, new, far = phrase_prints.signatures([text, edited, following])
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, new)
        assert r.near_edited == phrase_prints.likeness_of(own, new)
        assert r.near_next == phrase_prints.likeness_of(own, far)


def test_next_across_ranges(spark, monkeypatch):
    """Many small ranges: each row still meets the one behind it, and the last the first."""
    monkeypatch.setattr(phrase_prints, "RANGE_ROWS", 5)
    rng = random.Random(3)
    ids = rng.sample(range(-1000, 1000), 333)
    rows = [(k, f"text {k}", "en") for k in ids]
    got = {r.doc_id: r.next for r in phrase_prints.beside(spark.createDataFrame(rows, DOCS).repartition(7)).collect()}
    ids.sort()
    assert got == {a: f"text {b}" for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_next_with_repeated_ids(docs, none, monkeypatch):
    monkeypatch.setattr(phrase_prints, "RANGE_ROWS", 3)
    got = phrase_prints.beside(docs).collect()
    rows = odd_rows()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert Counter(r.next for r in got) == Counter(r[1] or "" for r in rows)  # a ring
    assert phrase_prints.likenesses(none).count() == 0
    one = phrase_prints.beside(docs.filter("doc_id = 502")).collect()
    assert [(r.text, r.next) for r in one] == [("x", "x")]


def test_prints_of_copies_and_odd_texts(docs):
    rows = phrase_prints.likenesses(docs).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[504][0].fingerprint == by_id[505][0].fingerprint
    assert by_id[500][0].fingerprint == by_id[501][0].fingerprint == ""
    assert len({r.fingerprint for r in by_id[3]}) == 1 and len(by_id[3]) == 3
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted_words(rows, every=97, shortest=5, least=3):
    counts = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def variants_by_force(words, times=2):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def as_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters, longest, seed", [("ab", 9, 1), ("abc", 7, 2), ("aé", 12, 3), ("abcdefgh", 6, 4), ("a", 40, 5)])
def test_variants_equal_brute_force(spark, letters, longest, seed):
    """Dense vocabularies: doubled letters, words that begin others, many light and heavy meetings at a node."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(150)]
    rows = [(k, " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 150])]) for _ in range(60)), "en") for k in range(30)]
    got = spelling.variants(spark.createDataFrame(rows, DOCS).repartition(3), every=13, shortest=2, least=1)
    assert as_rows(got) == variants_by_force(counted_words(rows, 13, 2, 1))


def test_light_edges_are_few(spark):
    """Small-to-large: a word leaves the heavy path at most log2(words) times."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(3000)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    worst = spelling.light_edges(df).groupBy("word").count().agg(F.max("count")).first()[0]
    assert worst <= len(words).bit_length()


def test_variants_of_odd_rows(docs, none):
    words = counted_words(odd_rows(), 97, 5, 2)
    assert any(len(w) > 600 for w in words)  # a very long one
    assert as_rows(spelling.variants(docs, least=2)) == variants_by_force(words)
    assert spelling.variants(none).count() == 0


def test_long_words_by_digest(spark):
    base = "abcdefghij" * 40
    words = [base, base[:200] + base[201:], base[:-1], base + "x", base[:64] + "z" + base[65:], base[:64] + "y" + base[65:], base[:65], base[:64], base[:63]]
    rows = [(k, " ".join([w] * (3 + k)), "en") for k, w in enumerate(words)]
    assert as_rows(spelling.variants(spark.createDataFrame(rows, DOCS), every=10**9)) == variants_by_force(counted_words(rows, 10**9))


def test_roots_of_long_chains(spark):
    pairs = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("lone", "w5"), ("x", "y")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w37" for k in range(37)}, "lone": "w37", "x": "y"}


# Collocations


def mined(rows, max_n=3, least=10, share=50, top=2000):
    """The contract, word by word, in whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def phrase_rows(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("max_n, least, top, seed", [(3, 3, 2000, 1), (3, 2, 7, 2), (2, 3, 50, 3), (4, 2, 100, 4)])
def test_collocations_equal_brute_force(spark, max_n, least, top, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "é", "É", "x-y", " ", "ß", "日本", "q r"]
    gap = lambda: rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\x0b\x0c"])
    rows = [(k, "".join(rng.choice(vocabulary) + gap() for _ in range(rng.randrange(60))), rng.choice(["en", "f r", None, "\t"])) for k in range(60)]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), max_n=max_n, least=least, top=top)
    assert phrase_rows(got) == mined(rows, max_n, least, 50, top)


def test_collocations_in_small_steps(spark, monkeypatch):
    """Phrases over the borders of steps and batches; a piece longer than a step."""
    monkeypatch.setattr(collocations, "STEP", 7)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(200)) + ". " + rng.choice("abc"), "en") for k in range(5)]
    import numpy as np
    import pyarrow as pa

    for _, text, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        words = collocations.Words(collocations.LOWER[data], np.array([0, len(data)]))
        got = Counter(x for c in collocations.phrases(words, pa.array(["en"]), 3) for x in c.to_pylist())
        want = Counter()
        for piece in text.split("."):
            w = piece.split()
            want.update(f"{'' if k > 1 else chr(9)}{' '.join(w[i : i + k])}\ten" for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert got == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A filter far too small lets nearly everything through: the counts are those of the strings all the same."""
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(100)), rng.choice("xy")) for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    want = mined(rows, 3, 5)
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    (bits,) = collocations.frequent_filter(docs.select("lang", "text"), 3, 5).tolist()
    assert bits.bit_count() > 48
    assert phrase_rows(collocations.collocations(docs, least=5)) == want


def test_collocations_of_odd_rows(docs, none):
    assert phrase_rows(collocations.collocations(docs, least=4)) == mined(odd_rows(), 3, 4)
    assert collocations.collocations(none).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_000_000_001
    counts = spark.createDataFrame([("en", "x", a + 2), ("en", "y", a + 5), ("en", "x y", a)], "lang string, phrase string, f long")
    r = collocations.scored(counts.filter("phrase = 'x y'").withColumnRenamed("f", "a"), counts).first()
    assert r.score == 10**6 * a * a // ((a + 2) * (a + 5))


@pytest.mark.parametrize("name", ["op12_spelling", "op13_collocations"])
def test_queries_equal_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, d)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_op11_separates_edits_from_others(spark):
    rows = queries.op11_phrase_prints(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.99 * len(rows)
