"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of letters and digits. An item is the weighted bag of its SHINGLE-word shingles (a shorter
item: its whole text, searched as it stands in documents of any length); a shingle weighs ln(1 + items / items that hold
it), as a whole number of 1/SCALE, so every sum is exact. A document is read through windows as long as an item (a shorter
document is one window). Each window's weighted SimHash is looked up in a multi-index: the fingerprint is cut into BLOCKS
runs of bits and each run's table lists the items within the run's Hamming ball, so every item within `radius` is found.
Found items are verified by the weighted Jaccard similarity of the two bags, `threshold` or more. So what is found has that
similarity, and of windows within the radius none is missed. A bit of two bags at a similarity of 0.8 differs with a
probability of 0.151, so a window of 0.8 lies beyond RADIUS bits in about 3 cases of 10,000, and one of 0.85 hardly ever.

Items are a distributed table. A window of the threshold lacks at most 1 - threshold of its item's weight, so it holds one
of the item's rarest shingles that together weigh more than that (its probes). One scan of the documents keeps those with
a probe: it meets a broadcast Bloom filter of 2**FEWEST_BITS to 2**MOST_BITS bits (32 MB at most) over the probes and the
shingles of several items. What passes is joined with the tables themselves, so a full filter costs time, not results. A
document then meets the items of its probes in one task, where the windows that hold a probe are looked up. Weights
are those of the whole benchmark, however the work is dealt out.

Defined results: null texts and texts without words match nothing; null item_ids are left out; equal items count once and
the smallest item_id names them; a null doc_id is a document like any other; rows that repeat a doc_id are looked at each;
the best window is the first of the most similar ones; empty tables give an empty result; other columns are not read.
Hashes have 64 bits, so unlike shingles count as equal with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh, stored, whole_groups
from tessera.llm.textvec import pieces, shingle_hashes, span_hashes, word_spans

SHINGLE = 5
#: Bits within which windows are looked up, and the runs of bits of the multi-index.
RADIUS, BLOCKS = 20, 8
SCALE = 1 << 16
#: The filter has FILL bits for each of its shingles, within these powers of two.
FILL, FEWEST_BITS, MOST_BITS = 64, 20, 28


def _words(text: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words, in order."""
    out = []
    for row, rows, data, offsets in pieces(pa.array(text, pa.string())):
        starts, ends, of = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        at = np.searchsorted(of, np.arange(rows + 1))
        out += [words[at[k] : at[k + 1]] for k in range(rows)]
    return out


def bags(text: list[str | None], n: int) -> list[np.ndarray]:
    """Hashes of each text's shingles, in order; a text of fewer words is one shingle."""
    return [shingle_hashes(w, min(n, max(1, len(w)))) for w in _words(text)]


def weight(items: int, held: np.ndarray) -> np.ndarray:
    """Of shingles that so many of the items hold; none counts as one."""
    return np.rint(np.log1p(items / np.maximum(1, held)) * SCALE).astype(np.int64)


def probes(shingles: np.ndarray, weights: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest distinct shingles of an item that together weigh more than a window of the threshold can lack."""
    distinct, at, counts = np.unique(shingles, return_index=True, return_counts=True)
    order = np.lexsort((distinct, -weights[at]))
    total = np.cumsum((weights[at] * counts)[order])
    enough = np.searchsorted(total, (1 - threshold) * total[-1] + 1e-6 * SCALE, "right") + 1
    return distinct[order[:enough]]


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) * 2 - 1


def _print(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class ItemIndex:
    """Bags, weights, fingerprints and the multi-index of some items: (item_id, shingles in order).

    known: (shingles, ascending, and how many of all items hold each); any other shingle is one of no or one item.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], known: tuple[np.ndarray, np.ndarray], total: int, radius: int = RADIUS, threshold: float = 0.8):
        self.radius, self.default = radius, int(weight(total, np.ones(1))[0])
        self.keys, self.values = known[0], weight(total, known[1])
        self.ids = [i for i, _ in items]
        self.bags = [Counter(b.tolist()) for _, b in items]
        self.length = np.array([len(b) for _, b in items])  # shingles of a window of this item
        self.total = [int(self.weigh(b).sum()) for _, b in items]
        self.prints = np.array([_print((_signs(b) * self.weigh(b)[:, None]).sum(axis=0, keepdims=True))[0] for _, b in items], np.uint64)
        self.probed = defaultdict(list)
        for k, (_, b) in enumerate(items):
            for h in probes(b, self.weigh(b), threshold).tolist():
                self.probed[h].append(k)
        self.shingles = np.array(sorted(self.probed), np.uint64)
        a, b = divmod(radius, BLOCKS)
        width = 64 // BLOCKS
        self.tables = []
        for k in range(BLOCKS):
            ball = [sum(1 << x for x in bits) for r in range((a if k <= b else a - 1) + 1) for bits in combinations(range(width), r)]
            own = ((self.prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int32)
            keys = (own[:, None] ^ np.array(ball, np.int32)[None, :]).ravel()
            which = np.repeat(np.arange(len(own), dtype=np.int32), len(ball))
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], which[order]))

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.default, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            same = self.keys[at] == hashes
            out[same] = self.values[at[same]]
        return out

    def within(self, fp: int) -> set[int]:
        """Items whose fingerprint is within radius of fp: from the tables, verified on all bits."""
        width = 64 // BLOCKS
        found: set[int] = set()
        for k, (keys, which) in enumerate(self.tables):
            key = fp >> k * width & (1 << width) - 1
            found.update(which[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")].tolist())
        return {k for k in found if (int(self.prints[k]) ^ fp).bit_count() <= self.radius}

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions whose shingle is a probe of an item."""
        if not len(self.shingles):
            return np.zeros(0, np.int64)
        found = np.searchsorted(self.shingles, shingles)
        found[found == len(self.shingles)] = 0
        return np.flatnonzero(self.shingles[found] == shingles)

    def matches(self, shingles: np.ndarray, threshold: float) -> dict[int, tuple]:
        """item -> (similarity, start, Hamming distance) of its best window in one text."""
        probed: dict[int, list[int]] = defaultdict(list)
        for p in self.hits(shingles).tolist():
            for k in self.probed[int(shingles[p])]:
                probed[k].append(p)
        spans: dict[int, set[int]] = defaultdict(set)
        for k, at in probed.items():
            size = min(int(self.length[k]), len(shingles))
            starts = spans[size]
            reach = -1
            for p in at:
                starts.update(range(max(reach + 1, p - size + 1, 0), min(p, len(shingles) - size) + 1))
                reach = max(reach, p)
        best: dict[int, tuple] = {}
        for size, starts in spans.items():
            ordered = np.array(sorted(starts))
            for k in range(0, len(ordered), 2048):
                self._windows(shingles, ordered[k : k + 2048], size, threshold, best)
        return best

    def _better(self, best: dict, item: int, like: float, start: int, fp: int) -> None:
        old = best.get(item)
        if old is None or like > old[0] or like == old[0] and start < old[1]:
            best[item] = like, start, (int(self.prints[item]) ^ fp).bit_count()

    def _windows(self, shingles, starts, size, threshold, best) -> None:
        # Runs of neighbouring starts share one running sum.
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            if not len(run):
                continue
            low = int(run[0])
            part = shingles[low : int(run[-1]) + size]
            sums = np.zeros((len(part) + 1, 64), np.int64)
            np.cumsum(_signs(part) * self.weigh(part)[:, None], axis=0, out=sums[1:])
            prints = _print(sums[run - low + size] - sums[run - low])
            seen: dict[int, set[int]] = {}
            for s, fp in zip(run.tolist(), prints.tolist(), strict=True):
                if fp not in seen:
                    # A window is compared with items of its own length only.
                    seen[fp] = {k for k in self.within(fp) if min(int(self.length[k]), len(shingles)) == size}
                for k in seen[fp]:
                    if k in best and best[k][0] == 1 and best[k][1] < s:
                        continue
                    like = self.similarity(k, shingles[s : s + size])
                    if like >= threshold:
                        self._better(best, k, like, s, fp)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard of the two bags of shingles."""
        bag, mine = self.bags[item], Counter(window.tolist())
        weights = self.weigh(np.fromiter(mine, np.uint64, len(mine))).tolist()
        common = sum(min(c, bag[h]) * w for (h, c), w in zip(mine.items(), weights, strict=True) if h in bag)
        every = sum(c * w for c, w in zip(mine.values(), weights, strict=True)) + self.total[item] - common
        return common / every if every else 0.0


def item_table(benchmark: DataFrame, n: int = SHINGLE) -> tuple[DataFrame, DataFrame, int]:
    """((item_id, m, shingles), (shingle, held), number of items): m words make a shingle; held: by so many items."""

    def run(batches):
        for batch in batches:
            words = _words(batch.column(1).to_pylist())
            m = [min(n, len(w)) for w in words]
            some = [k for k, size in enumerate(m) if size]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some, pa.int64())), pa.array([m[k] for k in some], pa.int64()), pa.array([shingle_hashes(words[k], m[k]).view(np.int64) for k in some], pa.list_(pa.int64()))],
                names=["item_id", "m", "shingles"],
            )

    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text).filter("item_id is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = stored(bounded_batches(rows).select("item_id", "text").mapInArrow(run, "item_id long, m long, shingles array<long>"), "items")
    held = items.select(F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("held"))
    return items, stored(held, "held"), items.count()


def _filter_of(marks: DataFrame) -> np.ndarray:
    """A Bloom filter of two positions for each shingle, as bytes; a row for every 64 of its bits is all the driver sees."""
    n = marks.count()
    bits = max(FEWEST_BITS, min(MOST_BITS, (FILL * n).bit_length()))
    low = F.col("shingle").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    at = marks.select(F.explode(F.array(low, F.shiftrightunsigned("shingle", 64 - bits))).alias("at"))
    word = at.select(F.shiftrightunsigned("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _passes(bloom: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    bits = len(bloom).bit_length() - 1 + 6
    out = np.ones(len(shingles), bool)
    for at in ((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), (shingles >> np.uint64(64 - bits)).astype(np.int64)):
        out &= (bloom[at >> 6] >> (at & 63)) & 1 == 1
    return out


#: What leaks() finds: `text_key` is the MD5 of the text, on which alone a document's rows depend.
FOUND = "doc_id long, text_key string, item_id long, similarity double, hamming int, first_word long, n_words int"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """contaminated() with text_key."""
    spark = docs.sparkSession
    items, held, total = item_table(benchmark, n)
    sizes = sorted(r.m for r in items.select("m").distinct().collect())  # at most n
    counts = items.select("item_id", "m", F.posexplode("shingles").alias("at", "shingle")).join(held, "shingle")
    counts = counts.groupBy("item_id", "m").agg(F.sort_array(F.collect_list(F.struct("at", "shingle", "held"))).alias("s"))
    items = stored(counts.select("item_id", "m", F.col("s.shingle").alias("shingles"), F.col("s.held").alias("held")), "weighed")

    def rarest(batches):
        for batch in batches:
            for item, m, shingles, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = probes(np.array(shingles, np.int64).view(np.uint64), weight(total, np.array(many)), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(np.full(len(found), m)), pa.array(found.view(np.int64))], names=["item_id", "m", "shingle"])

    probe = stored(items.mapInArrow(rarest, "item_id long, m long, shingle long"), "probes")
    marks = probe.select("shingle").union(held.filter("held > 1").select("shingle")).distinct()
    shared = spark.sparkContext.broadcast(_filter_of(marks))

    def scan(batches):
        bloom = shared.value
        for batch in batches:
            out = []
            for row, _, data, offsets in pieces(batch.column(3)):
                starts, ends, of = word_spans(data, offsets)
                if not len(starts):
                    continue
                words = span_hashes(data, starts, ends)
                begin = np.searchsorted(of, np.arange(len(offsets)))
                for m in sizes:
                    shingles = shingle_hashes(words, m)
                    hit = np.flatnonzero(_passes(bloom, shingles))
                    hit = hit[hit <= begin[1:][of[hit]] - m]  # a shingle that runs into the next text is none
                    cut = np.flatnonzero(np.diff(of[hit], prepend=-1))
                    for part in np.split(hit, cut[1:]) if len(hit) else ():
                        k = int(of[part[0]])
                        out.append((row + k, m, np.unique(shingles[part]).view(np.int64), shingles[begin[k] : begin[k + 1] - m + 1].view(np.int64)))
            if out:
                at, m, hits, shingles = zip(*out, strict=True)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(at) for c in range(3)], pa.array(m, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(shingles, pa.list_(pa.int64()))],
                    names=["r", "doc_id", "text_key", "m", "hits", "shingles"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_key"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    texts = stored(bounded_batches(rows).mapInArrow(scan, "r long, doc_id long, text_key string, m long, hits array<long>, shingles array<long>"), "hits")
    hits = texts.select("r", "m", F.explode("hits").alias("shingle"))
    pairs = hits.join(probe, ["shingle", "m"]).select("r", "m", "item_id").distinct()
    # A document's rows in one group: itself, what is known of its shingles, and its items.
    none = lambda kind: F.lit(None).cast(kind)
    wanted = pairs.select("r", "m").distinct()
    known = hits.join(wanted, ["r", "m"], "left_semi").join(held.filter("held > 1"), "shingle").groupBy("r", "m").agg(F.collect_list(F.struct("shingle", "held")).alias("s"))
    known = known.select("r", "m", F.col("s.shingle").alias("shingles"), F.col("s.held").alias("held"))
    group = texts.join(wanted, ["r", "m"], "left_semi").select("r", "m", "doc_id", "text_key", none("long").alias("item_id"), "shingles", none("array<long>").alias("held"))
    group = group.unionByName(known.select("r", "m", none("long").alias("doc_id"), none("string").alias("text_key"), none("long").alias("item_id"), "shingles", "held"))
    of_items = pairs.join(items.drop("m"), "item_id").select("r", "m", none("long").alias("doc_id"), none("string").alias("text_key"), "item_id", "shingles", "held")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = group.unionByName(of_items).repartition(parts, "r", "m").sortWithinPartitions("r", "m")

    def work(t, _):
        found, mine, seen, keys, many = t.column("item_id").to_pylist(), {}, [], [], []
        shingles, held = t.column("shingles").combine_chunks(), t.column("held").combine_chunks()
        row = lambda column, k: column.slice(k, 1).flatten().to_numpy()
        for k in range(t.num_rows):
            if held[k].is_valid:
                keys.append(row(shingles, k).view(np.uint64))
                many.append(row(held, k))
                if found[k] is not None:
                    mine[found[k]] = keys[-1]
            else:
                seen.append(k)
        keys, first = np.unique(np.concatenate(keys), return_index=True) if keys else (np.zeros(0, np.uint64), [])
        many = np.concatenate(many)[first] if many else np.zeros(0)
        index = ItemIndex(sorted(mine.items()), (keys, many), total, radius, threshold)
        doc_id, text_key, m, out = t.column("doc_id"), t.column("text_key"), t.column("m"), []
        for k in seen:
            text, size = row(shingles, k).view(np.uint64), m[k].as_py()
            for i, (like, start, far) in index.matches(text, threshold).items():
                out.append((doc_id[k].as_py(), text_key[k].as_py(), index.ids[i], like, far, start, min(int(index.length[i]), len(text)) + size - 1))
        if out:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    return dealt.mapInArrow(whole_groups(["r", "m"], work), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, first_word, n_words): each document's best window for each item it holds."""
    return leaks(docs, benchmark, threshold, radius, n).drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their doc_id; rows of a null text stay."""
    (key,) = fresh(docs, "key")
    bad = stored(leaks(docs, benchmark, threshold, radius, n).select(F.col("text_key").alias(key)).distinct(), "leaks")
    return docs.join(bad, F.md5(docs["text"]) == bad[key], "left_anti")
