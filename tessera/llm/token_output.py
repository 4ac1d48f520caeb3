"""Token ids as patched frame-of-reference blocks.

A segment is a byte string, all numbers little-endian:

    "PFR1", u32 values, u32 values in a block, u32 blocks, u32 start of each block (from the segment's first byte)
    block: u32 minimum, u8 width, u32 exceptions,
           the low `width` bits of value - minimum, most significant bit first, padded to whole bytes,
           u32 position of each exception, u32 value - minimum of each exception

The width is that of a percentile of the block's offsets, the one of PERCENTILES with the smallest block; larger values
are exceptions. Segments are rows of a Parquet table (any store that Spark writes will do) with their documents' ids and
lengths, in ascending doc_id order: by `part`, then `segment`.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_batches, shared_dir
from tessera.llm.tokens import encoder

BLOCK = 4096
PERCENTILES = (0.8, 0.9, 0.95, 0.98, 0.99, 1.0)
SEGMENT_IDS = 1 << 20
#: Bytes of text for a task that encodes, on average.
RANGE_BYTES = 512 << 20
SEGMENTS = "part int, segment int, n_docs long, n_tokens long, doc_ids binary, doc_lengths binary, payload binary"


def _bits(x: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return x.astype(f">u{width // 8}").tobytes()
    wide = x.astype(">u4").view(np.uint8).reshape(-1, 4)
    skip = (32 - width) // 8
    return np.packbits(np.unpackbits(np.ascontiguousarray(wide[:, skip:]), axis=1)[:, 32 - width - 8 * skip :]).tobytes()


def _values(data: bytes, at: int, size: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", size, at).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (size * width + 7) // 8, at), count=size * width).reshape(size, width)
    full = 16 if width < 16 else 32
    padded = np.zeros((size, full), np.uint8)
    padded[:, full - width :] = bits
    return np.packbits(padded, axis=1).view(f">u{full // 8}").ravel().astype(np.uint32)


def _block(values: np.ndarray) -> bytes:
    low = int(values.min())
    x = values - np.uint32(low)
    order = np.sort(x)
    best = None
    for p in PERCENTILES:
        at = order[min(len(order) - 1, int(np.ceil(p * len(order))) - 1 if p else 0)]
        width = int(at).bit_length()
        over = len(x) - int(np.searchsorted(order, (1 << width) - 1, "right"))
        size = (len(x) * width + 7) // 8 + 8 * over
        if best is None or size < best[0]:
            best = size, width
    width = best[1]
    if width == 32:
        over = np.zeros(0, np.int64)
    else:
        over = np.flatnonzero(x >> np.uint32(width))
    packed = _bits(x & np.uint32((1 << width) - 1), width) if width else b""
    return struct.pack("<IBI", low, width, len(over)) + packed + over.astype("<u4").tobytes() + x[over].astype("<u4").tobytes()


def encode_segment(values: np.ndarray, block: int = BLOCK) -> bytes:
    values = np.asarray(values, np.uint32)
    blocks = [_block(values[k : k + block]) for k in range(0, len(values), block)]
    head = struct.pack("<4sIII", b"PFR1", len(values), block, len(blocks))
    starts = len(head) + 4 * len(blocks) + np.cumsum([0, *map(len, blocks)])[:-1]
    return head + starts.astype("<u4").tobytes() + b"".join(blocks)


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values first..last-1; only the blocks that hold them are read, by way of the block starts."""
    magic, n, block, blocks = struct.unpack_from("<4sIII", data)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 segment")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u4", blocks, 16)
    out = []
    for k in range(first // block, (last - 1) // block + 1):
        at = int(starts[k])
        low, width, over = struct.unpack_from("<IBI", data, at)
        size = min(block, n - k * block)
        at += 9
        x = np.zeros(size, np.uint32)
        if width:
            length = (size * width + 7) // 8
            x = _values(data, at, size, width)
            at += length
        if over:
            x[np.frombuffer(data, "<u4", over, at)] = np.frombuffer(data, "<u4", over, at + 4 * over)
        out.append(x + np.uint32(low))
    shift = first // block * block
    return np.concatenate(out)[first - shift : last - shift]


def write_segments(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode (doc_id, text) and write the segment table.

    One shuffle: texts are dealt by ranges of doc_id, sorted, encoded and packed in the same task, so ids never move.
    Null texts are empty ones (just the end id); null doc_ids come first; repeated doc_ids all stay, in the order of a
    hash of the text (so one id with most of the rows is many ranges); equal rows are told apart by where they stand in
    the input, which shows nowhere. An empty table writes no segments. The tokenizer file is read on the driver and sent
    to the executors as its own text. A task sorts RANGE_BYTES of text (spilling beyond its memory) and holds texts of
    1 MB of characters or one longer text, and SEGMENT_IDS ids or those of one such batch.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))

    def pack(batches):
        pieces = encoder(tokenizer.value)
        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, names, held = [], [], [], 0

        def row():
            nonlocal ids, lengths, names, held, number
            values = np.concatenate(ids)
            marks = np.cumsum(lengths) + np.arange(len(lengths))
            values = np.insert(values, np.cumsum(lengths), np.uint32(end_id))
            assert len(values) == marks[-1] + 1
            out = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
                    "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([len(values)], pa.int64()),
                    "doc_ids": pa.array([np.array(names, "<i8").tobytes()], pa.binary()),
                    "doc_lengths": pa.array([(np.array(lengths) + 1).astype("<i8").tobytes()], pa.binary()),
                    "payload": pa.array([encode_segment(values)], pa.binary()),
                }
            )
            ids, lengths, names, held, number = [], [], [], 0, number + 1
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            k = 0
            while k < len(doc_ids):
                taken, chars = [], 0
                first = k
                while k < len(doc_ids) and (chars < 1 << 20 or not taken):
                    taken.append(texts[k].as_py() or "")
                    chars += len(taken[-1])
                    k += 1
                values, counts = pieces.encode(taken)
                ids.append(values)
                lengths.extend(counts.tolist())
                names.extend(NULL_ID if d is None else d for d in doc_ids[first:k])
                held += len(values) + len(counts)
                if held >= SEGMENT_IDS:
                    yield row()
        if names:
            yield row()

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(n, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(pack, SEGMENTS).write.option("compression", "zstd").parquet(path)


#: Stands for a null doc_id in a segment.
NULL_ID = -(1 << 63)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files."""

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values = decode_segment(r["payload"]).astype("<u4")
                lengths = np.frombuffer(r["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                names = np.frombuffer(r["doc_ids"], "<i8")
                view = memoryview(values.tobytes())
                crc = [zlib.crc32(view[4 * (b - m) : 4 * b]) for b, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(names), r["part"], np.int32)), pa.array(np.full(len(names), r["segment"], np.int32)),
                        pa.array(names, mask=names == NULL_ID), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SEGMENTS).parquet(path)
    docs = segments.select("part", "segment", "doc_ids", "doc_lengths", "payload").mapInArrow(
        unpack, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    # Prefix sums in two steps: over the few parts, then over the segments of each part.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    within = Window.partitionBy("part").orderBy("segment")
    bases = segments.select("part", "segment", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("skip")).join(parts, "part")
    return docs.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("skip") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the segment table of docs to the shared folder and return what read_documents() finds in it."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    write_segments(docs, path, tokenizer_path, end_id)
    return read_documents(spark, path)
