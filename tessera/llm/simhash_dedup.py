"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits) link at `radius` or fewer differing bits. They are cut into SEGMENTS runs of bits. By the
pigeonhole rule two linked fingerprints agree in some segment up to a small number of bits: with 3 segments and
4 bits, up to one bit in the first or second, or fully in the third. So each fingerprint is entered in a table under its
segments' values and looks up, in the same table, the values in that small Hamming ball; what is found is verified on all
64 bits. A pair that differs by one bit in a segment is seen once: only the fingerprint with the 0 asks.

Copies cost nothing: equal fingerprints are one class before the search (for a similarity: equal sets of shingles). A bucket
(segment, value) that holds very many is cut into blocks of a fixed size before its rows are dealt out, and every two
blocks meet in a task of their own; a task returns one link for each fingerprint it connects (a spanning forest over all its buckets), never all pairs. The forests of
several tasks may be merged to one. Links become components by alternating large-star and small-star steps over written
tables, so nothing grows on the driver.

64 bits tell texts apart whose shingles are nearly all the same. For a similarity of 0.8 (`similar_documents`) the
fingerprints are of 256 bits: texts whose sets of shingles have a Jaccard similarity of 0.8 differ in 38 of them on
average (standard deviation 6), unrelated ones in 128 (8). Candidates link at WIDE.radius or fewer. A lookup in balls
of one bit round each of the segments meets 98 % of pairs at 0.8 and nearly all above 0.85; a guarantee for that
radius would take balls that hold most of the table. Candidate components are then read again with their exact sets of
shingles, in blocks of bounded bytes of which every two meet, and only links of the exact similarity stay.

Defined results: a null text has no words; no words give fingerprint 0, linked like any other (for a similarity: one set,
the empty one). Every row is a document, also one with a null doc_id or one that repeats a doc_id; a component is named by
its smallest doc_id, null if it has none. Of a component stays the row with that doc_id (then the smallest MD5 of the text,
then, of rows that repeat both, the first in the order of all columns as JSON). An empty table gives an empty result.
Other columns are not read, and may have any name and type.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_batches, stored, whole_groups
from tessera.llm.textvec import mix, pieces, shingle_hashes, span_hashes, word_spans

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: (lowest bit, number of bits) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: The same letters and separators for vectorised reading: lower case of each byte, and the bytes of words.
LOWER_BYTES = np.frombuffer(LOWER, np.uint8)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Rows of one side of a bucket that meet in one task; a dense block's search is over this many at most.
BLOCK = 8192
#: Bytes of exact sets in one side of a candidate component that meet in one task.
SET_BYTES = 1 << 20
#: Links that a task holds before it cuts them to a spanning forest.
FOREST_LINKS = 1 << 18
#: Up to this many comparisons a bucket's pairs are formed at once; above, they are searched breadth first.
DIRECT = 1 << 14


class Index(NamedTuple):
    """A multi-index: (column, lowest bit, bits) and ball radius of each segment, and the distance that links."""

    columns: list[str]
    segments: list[tuple[str, int, int]]
    balls: list[int]
    radius: int


#: Classes up to which the three segments of 21 and 22 bits do; beyond, two of 32 bits.
FEW = 1 << 24
#: The share of differing bits at a similarity of 0.8, and the share of such pairs that the wide index is to meet.
DIFFER, MEET = 0.15, 0.98
#: Bits of a wide segment, whatever the corpus holds: 16,384 buckets for each of the segments.
WIDE_BITS = 14


def wide() -> Index:
    """The index over four words of 64 bits. It is the same for every corpus, so which texts meet does not depend on what else
    there is; a corpus of very many classes has fuller buckets, which are cut into blocks."""
    near = (1 - DIFFER) ** WIDE_BITS + WIDE_BITS * DIFFER * (1 - DIFFER) ** (WIDE_BITS - 1)
    count = math.ceil(math.log(1 - MEET) / math.log(1 - near))
    each = -(-count // 4)  # in a word
    step = (64 - WIDE_BITS) // max(1, each - 1)
    segments = [(f"fp{k % 4}", k // 4 * step, WIDE_BITS) for k in range(count)]
    return Index([f"fp{k}" for k in range(4)], segments, [1] * count, 52)


WIDE = wide()


def narrow(radius: int, classes: int = 1) -> Index:
    """The index over one 64-bit fingerprint that misses nothing within radius."""
    segments = SEGMENTS if classes <= FEW else ((0, 32), (32, 32))
    return Index(["fp"], [("fp", low, size) for low, size in segments], balls(radius, segments), radius)


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest as h64

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return h64(joined, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    hashes = np.fromiter((h64(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp) with fp as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n, seed) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return bounded_batches(docs).select(*_named(docs), "text").mapInArrow(run, "doc_id long, text_key string, fp long")


def _named(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.md5(docs["text"]), F.lit("")).alias("text_key")]


def wide_prints(texts: pa.Array, n: int = 5) -> np.ndarray:
    """A row of WIDE's words for each text: bit b is 1 if it is set in over half of the distinct shingles' hashes. Last, a
    hash of the text's set of shingles."""
    out = np.zeros((len(texts), len(WIDE.columns) + 1), np.uint64)
    for row, rows, data, offsets in pieces(texts):
        data = LOWER_BYTES[data]
        starts, ends, of = word_spans(data, offsets, NOT_SPACE)
        if not len(starts):
            continue
        words = span_hashes(data, starts, ends)
        begin = np.searchsorted(of, np.arange(rows + 1))
        shingles = shingle_hashes(words, n)
        whole = of[: len(shingles)] == of[len(of) - len(shingles) :]  # not across two texts
        short = np.flatnonzero((np.diff(begin) > 0) & (np.diff(begin) < n))
        of_short = [shingle_hashes(words[begin[k] : begin[k + 1]], int(begin[k + 1] - begin[k])) for k in short.tolist()]
        owner = np.concatenate([of[: len(shingles)][whole], short])
        hashes = np.concatenate([shingles[whole], *of_short])
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
        owner, hashes = owner[new], hashes[new]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[row + owner[first], -1] = np.add.reduceat(mix(hashes), first)
        size = np.diff(np.append(first, len(owner)))
        # Eight counters of a byte each are summed at once, over runs short enough for them.
        runs = -(-size // 255)
        of_text = np.cumsum(runs) - runs
        at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(of_text, runs))
        for k in range(len(WIDE.columns)):
            mixed = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
            fp = np.zeros(len(first), np.uint64)
            for shift in range(8):
                lanes = np.add.reduceat((mixed >> np.uint64(shift)) & np.uint64(0x0101010101010101), at)
                counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
                bits = (2 * counts > size[:, None]).astype(np.uint8)
                fp |= bits.view("<u8").ravel().astype(np.uint64) << np.uint64(shift)
            out[row + owner[first], k] = fp
    return out


def wide_fingerprints(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, text_key, fp0, fp1, fp2, fp3, shingles), the last as signed longs; shingles: the hash of the set of them."""

    def run(batches):
        for batch in batches:
            fp = wide_prints(batch.column(2), n).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.ascontiguousarray(x)) for x in fp.T]], names=["doc_id", "text_key", *WIDE.columns, "shingles"])

    schema = "doc_id long, text_key string, " + ", ".join(f"{c} long" for c in [*WIDE.columns, "shingles"])
    return bounded_batches(docs).select(*_named(docs), "text").mapInArrow(run, schema)


def balls(radius: int, segments=SEGMENTS) -> list[int]:
    """Ball radius of each segment that together miss no pair within radius."""
    a, b = divmod(radius, len(segments))
    return [a if k <= b else a - 1 for k in range(len(segments))]


def candidates(classes: DataFrame, index: Index) -> DataFrame:
    """classes' columns, bucket and asks: a row of each table entry and each lookup; classes: distinct fingerprints.

    A lookup is an entry's segment with some bits flipped: up to the segment's ball radius of them.
    """
    values = [F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << size) - 1).cast("long")) for c, low, size in index.segments]
    tag = lambda k, value: (F.lit(k).cast("long") * F.lit(1 << 40) + value).alias("bucket")
    entries = F.array(*[F.struct(tag(k, v), F.lit(False).alias("asks")) for k, v in enumerate(values) if index.balls[k] >= 0])
    masks = [
        (k, sum(1 << b for b in bits))
        for k, r in enumerate(index.balls)
        for size in range(1, r + 1)
        for bits in itertools.combinations(range(index.segments[k][2]), size)
    ]
    # One side of each pair asks: the one whose lowest flipped bit is 0.
    asks = [
        F.when(values[k].bitwiseAND(F.lit(m & -m).cast("long")) == 0, F.struct(tag(k, values[k].bitwiseXOR(F.lit(m).cast("long"))), F.lit(True).alias("asks")))
        for k, m in masks
    ]
    rows = F.concat(entries, F.filter(F.array(*asks), lambda x: x.isNotNull())) if asks else entries
    return classes.withColumn("r", F.explode(rows)).select(*classes.columns, F.col("r.bucket").alias("bucket"), F.col("r.asks").alias("asks"))


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Fingerprints are elements of a vector, or rows of a matrix of words."""
    differ = np.bitwise_count(a ^ b)
    return (differ.sum(axis=-1, dtype=np.int32) if b.ndim > 1 or a.ndim > 1 else differ) <= radius


def _forest(fps: np.ndarray, held: int, radius: int):
    """Links (positions) that connect what is linked between the first `held` fingerprints, and between them and the
    rest: breadth first, each fingerprint once, so memory is linear and a dense group shrinks at the first step."""
    left = np.arange(len(fps))
    while len(left) and left[0] < held:  # what is left of the rest has no link
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _close(fps[left], fps[at], radius)
            if at >= held:
                near &= left < held
            found = left[near]
            if len(found):
                yield np.full(len(found), at), found
                left = left[~near]
                queue.extend(found.tolist())


def _link(buckets: np.ndarray, fps: np.ndarray, asks: np.ndarray, radius: int):
    """Arrays of linked positions within whole buckets."""
    order = np.lexsort((asks, buckets))
    buckets, fps, asks = buckets[order], fps[order], asks[order]
    cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    end = np.append(cut[1:], len(buckets))
    held = np.add.reduceat(~asks, cut)  # table entries of each bucket, which come first
    size = end - cut
    work = held * (size - held) + held * (held - 1) // 2
    small = (work > 0) & (work <= DIRECT)
    # Every entry of a small bucket against all that follows it there.
    row = np.repeat(np.arange(len(cut)), size)
    first = np.flatnonzero(small[row] & ~asks)
    many = end[row[first]] - first - 1
    first, many = first[many > 0], many[many > 0]
    done = 0
    while done < len(first):
        stop = done + max(1, int(np.searchsorted(np.cumsum(many[done:]), 1 << 20, "right")))
        a = np.repeat(first[done:stop], many[done:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many[done:stop]) - many[done:stop], many[done:stop])
        near = _close(fps[a], fps[b], radius)
        yield order[a[near]], order[b[near]]
        done = stop
    for k in np.flatnonzero(work > DIRECT):
        for a, b in _forest(fps[cut[k] : end[k]], int(held[k]), radius):
            yield order[cut[k] + a], order[cut[k] + b]


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b), a < b: links that connect every two fingerprints within radius; classes: distinct fp."""
    return linked(classes.select("fp"), narrow(radius), "fp")


def linked(classes: DataFrame, index: Index, node: str) -> DataFrame:
    """(a, b), a < b: links by way of the index, between values of `node`, a long column of classes."""
    rows = candidates(classes, index)
    held, radius = classes.columns, index.radius
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Buckets that hold more than a block: their rows are dealt to blocks and every two blocks meet.
    hot = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    hot = hot.select("bucket", F.ceil(F.col("size") / F.lit(BLOCK)).cast("long").alias("blocks"))
    rows = rows.join(hot, "bucket", "left").withColumn("mine", F.pmod(F.xxhash64(*index.columns, "asks"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, F.col("mine")) * F.col("blocks") + F.greatest(x, F.col("mine")))
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)
    rows = rows.select("bucket", *held, "asks", F.explode(cells).alias("cell"))

    def work(t, k):
        same = np.cumsum(np.concatenate([[False], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
        fps = [t.column(c).to_numpy().view(np.uint64) for c in index.columns]
        fps = fps[0] if len(fps) == 1 else np.column_stack(fps)
        names = t.column(node).to_numpy()
        asks = t.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        for a, b in _link(same, fps, asks, radius):
            if len(a):
                yield names[a], names[b]

    def run(batches):
        yield from _forests(whole_groups(["bucket", "cell"], work)(batches))

    # Most rows are alone in their cell: they go before Python sees them.
    group = Window.partitionBy("bucket", "cell")
    dealt = rows.repartition(n, "bucket", "cell").withColumn("size", F.count("*").over(group)).filter("size > 1").drop("size").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _forests(found):
    """Batches of a task's links, cut to a spanning forest whenever many have come; found: arrays of (a, b)."""
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    held, many = [], 0
    for link in found:
        held.append(link)
        many += len(link[0])
        if many > FOREST_LINKS:
            a, b = spanning(*map(np.concatenate, zip(*held, strict=True)))
            if 2 * len(a) > FOREST_LINKS:
                yield batch(a, b)
                held, many = [], 0
            else:
                held, many = [(a, b)], len(a)
    if held:
        yield batch(*spanning(*map(np.concatenate, zip(*held, strict=True))))


def merged(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) that connect the same.

    Every task that meets a group returns a tree of it, so a large group comes as many times as there are tasks. The
    links are written, and read again in as many tasks as their bytes need; each cuts what it reads to one forest. This
    goes on while it takes a quarter of the links off.
    """

    def run(batches):
        yield from _forests((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b))

    links = stored(links, "links")
    many = links.count()
    while many:
        links, before = stored(links.mapInArrow(run, "a long, b long"), "merged"), many
        many = links.count()
        if 4 * many > 3 * before:
            break
    return links


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that still connect what all of them connect, as (smaller, larger): each component
    takes one link to a component before it, until none is left."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, kept = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        across = np.flatnonzero(low < high)
        if not len(across):
            return a[kept], b[kept]
        joined, first = np.unique(high[across], return_index=True)
        kept[across[first]] = True
        root[joined] = low[across[first]]
        while (root != root[root]).any():
            root = root[root]


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    data = LOWER_BYTES[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_SPACE)
    return np.unique(shingle_hashes(span_hashes(data, starts, ends), min(n, max(1, len(starts)))))


def _similar_forest(sets: list[np.ndarray], similarity: float):
    """Links (positions) that connect the sets of that Jaccard similarity or more: breadth first, by inverted lists."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(item, kind="stable")
    lists, start = owner[order], np.searchsorted(item[order], np.arange(int(item.max(initial=-1)) + 2))
    of = np.concatenate([[0], np.cumsum(size)])
    left = np.ones(len(sets), bool)
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            at = queue.pop()
            own = item[of[at] : of[at + 1]]
            long = start[own + 1] - start[own]
            every = np.repeat(start[own] - np.cumsum(long) + long, long) + np.arange(long.sum())
            common = np.bincount(lists[every], minlength=len(sets))
            found = np.flatnonzero(left & (common > 0) & (common >= similarity * (size + size[at] - common) - 1e-9))
            if len(found):
                yield np.full(len(found), at), found
                left[found] = False
                queue.extend(found.tolist())


def verified(docs: DataFrame, classes: DataFrame, near: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b), a < b: links of exact similarity within candidate components; near: (node, root), classes: (node, best)."""
    members = near.union(near.select("root", "root")).distinct().toDF("node", "root")
    members = members.join(classes.select("node", F.col("best.doc_id").alias("_id"), F.col("best.text_key").alias("_key")), "node")
    texts = docs.select(*_named(docs), "text").join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "root", "text")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), n).astype("<u8").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["node", "root", "hashes"])

    rows = stored(bounded_batches(texts).mapInArrow(sets, "node long, root long, hashes binary"), "sets")
    again = rows.groupBy("node").count().filter("count > 1").select("node")
    if again.limit(1).count():  # rows that repeat doc_id and text
        rows = rows.join(again, "node", "left_anti").unionByName(rows.join(again, "node", "left_semi").dropDuplicates(["node"]))
    blocks = rows.groupBy("root").agg(F.ceil(F.sum(F.length("hashes")) / F.lit(SET_BYTES)).cast("long").alias("blocks"))
    rows = rows.join(blocks.filter("blocks > 0"), "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, F.col("mine")) * F.col("blocks") + F.greatest(x, F.col("mine")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("root", F.explode(meets).alias("cell"), "node", "hashes").repartition(parts, "root", "cell").sortWithinPartitions("root", "cell")

    def work(t, k):
        cut = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
        names, hashes = t.column("node").to_numpy(), t.column("hashes")
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), t.num_rows], strict=True):
            out = list(_similar_forest([np.frombuffer(hashes[i].as_py(), "<u8") for i in range(low, high)], similarity))
            if out:
                a, b = (names[low + np.concatenate(x)] for x in zip(*out, strict=True))
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    return dealt.mapInArrow(whole_groups(["root", "cell"], work), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge; edges: (a, b) longs.

    Large-star then small-star until a round changes nothing; each round is a written table.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("u", "v").toDF("v", "u"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v")
        edges = stored(small.union(least.select("v", F.col("m").alias("u"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = 4, n: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp, component_id, stays) of each row: component_id is the smallest doc_id that links lead to, its
    own included; text_key the MD5 of the text; stays: whether the row is the one of its component that dedup keeps."""
    prints = stored(fingerprints(docs, n, seed), "prints")
    classes = _classes(prints, ["fp"])
    found = stored(linked(classes.select("fp", "node"), narrow(radius, classes.count()), "node"), "links")
    return _components_of(prints, classes, found, ["fp"])


def similar_documents(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_key, fp0 to fp3, component_id, stays): texts found by WIDE fingerprints link at that Jaccard similarity
    or more of their sets of n-word shingles. Equal sets are one class; equal fingerprints of other sets are candidates."""
    prints = stored(wide_fingerprints(docs, n), "prints")
    columns = [*WIDE.columns, "shingles"]
    classes = _classes(prints, columns)
    alike = classes.groupBy(*WIDE.columns).agg(F.min("node").alias("least"))
    equal = classes.join(alike, WIDE.columns).filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = merged(linked(alike.withColumnRenamed("least", "node"), WIDE, "node"))
    named = merged(verified(docs, classes, components(found.union(equal)), n, similarity))
    return _components_of(prints, classes, named, columns).drop("shingles")


def _row() -> Column:
    """What orders the rows of a component: a doc_id before none, then the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")


def _classes(prints: DataFrame, columns: list[str]) -> DataFrame:
    """columns, best (the first row of the class) and node, a number of its own."""
    return stored(prints.groupBy(*columns).agg(F.min(_row()).alias("best")).withColumn("node", F.monotonically_increasing_id()), "classes")


def _components_of(prints: DataFrame, classes: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """prints with component_id and stays; links: (a, b) between the nodes of classes."""
    rooted = classes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("best").alias("chosen"))
    of_class = rooted.join(first, "root").select(*columns, "chosen")
    found = prints.join(of_class, columns)
    return found.select("doc_id", "text_key", *columns, F.col("chosen.doc_id").alias("component_id"), (_row() == F.col("chosen")).alias("stays"))


def dedup_documents(docs: DataFrame, radius: int = 4, n: int = 4, seed: int = 42) -> DataFrame:
    """docs with one document of each component of near_duplicates()."""
    return one_of_each(docs, near_duplicates(docs, radius, n, seed))


def dedup_similar(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs with one document of each component of similar_documents()."""
    return one_of_each(docs, similar_documents(docs, n))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the one row that stays of each component; found: (doc_id, text_key, stays) of each row."""
    found = stored(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("stays").alias("_stays")).agg(F.count("*").alias("_n")), "stays")
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.coalesce(F.md5(docs["text"]), F.lit("")) == found["_key"])
    kept = docs.join(found.filter("not _stays"), same, "left_anti")
    again = found.filter("_stays and _n > 1")
    if again.limit(1).count():  # rows that repeat both
        rows = docs.join(again, same).select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), found["_id"], found["_key"])
        order = Window.partitionBy("_id", "_key").orderBy(F.to_json("_row"))
        one = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("_row.*")
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept
