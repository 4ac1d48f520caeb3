"""Vectorised text primitives over an Arrow batch: spans of words and 64-bit hashes of any span.

A span's hash takes its last eight bytes and its length as they are, and the groups of four bytes before them as a
polynomial in an odd base modulo 2**64 of their scrambled values; one running sum over the batch gives every span in O(1):
(S[b] - S[a]) * base**-a. Avalanche steps spread the bits. Spans of one length up to eight bytes have no collisions; the
scrambling breaks the texts that collide in every plain polynomial hash modulo a power of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Letters and digits of ASCII and every byte of a longer character are part of a word.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept by the worker process."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", BASE_INV)):
            row = np.full(n, np.uint64(base))
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, most: int = 1 << 20):
    """(first row, rows, bytes, offsets) for runs of rows of about `most` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ALNUM):
    """(starts, ends, row of each word); a word never crosses from one text into the next."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    edge[len(data)] = True
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[a:b] for each span."""
    n, size = len(data), ends - starts
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    # The eight bytes up to each place, then only those of the span.
    last = np.lib.stride_tricks.sliding_window_view(padded, 8)[ends].copy().view("<u8").ravel()
    short = np.minimum(size, 8)
    last = np.where(short == 0, np.uint64(0), last >> (np.uint64(8) * (np.uint64(8) - np.maximum(short, 1).astype(np.uint64))))
    out = mix(last) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    long = np.flatnonzero(size > 8)
    if len(long):
        up, down = powers(n + 1)
        fours = data[:-3].astype(np.uint64)
        for k in (1, 2, 3):
            fours |= data[k : n - 3 + k].astype(np.uint64) << np.uint64(8 * k)
        sums = np.zeros(n - 2, np.uint64)
        np.cumsum(mix(fours + np.uint64(BASE)) * up[: n - 3], out=sums[1:])
        a = starts[long]
        out[long] += mix((sums[ends[long] - 7] - sums[a]) * down[a])  # groups that begin before the last seven bytes
    return mix(out)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; order counts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return mix(total)
