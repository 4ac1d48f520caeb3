"""Whole-text encoding with the tokenizers library, each distinct piece of a text once.

A byte-level BPE first cuts a text into pieces (letters, digits, other marks, white space) and encodes each piece on its
own. The cuts are found here for a whole batch with array operations; the library encodes every distinct piece, so the
ids are its ids (tests compare them with encoding the whole text). A piece is looked up by a hash and then compared
character by character with the piece that is known under it; a text with a piece that only shares a hash goes to the
library whole, as does a text that holds an added token.

Known pieces outlive a task: encoder() keeps one PieceEncoder for each tokenizer in the worker process.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from tessera.llm.textvec import mix, powers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points of the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[WHITE] = SPACE
    return found


@lru_cache(1)
def encoder(tokenizer: str) -> PieceEncoder:
    """The encoder of this process for a tokenizer given as JSON."""
    return PieceEncoder(tokenizer)


class PieceEncoder:
    """Encodes lists of texts; keeps at most max_pieces encoded pieces (about 100 bytes each), then only those that
    several batches held.

    The pieces known so far are an open-addressing table of hashes in arrays, so a batch is looked up at once.
    """

    def __init__(self, tokenizer: str, max_pieces: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_pieces = max_pieces
        self.forget()

    def forget(self) -> None:
        self.n, self.used = 0, 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        # The code points of the known pieces, one after the other, and where each begins.
        self.codes, self.spelt = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._table(16)
        self.known, self.again = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)

    def _table(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            slots = self.slots[at]
            hit = (self.keys[at] == hashes[left]) & (slots >= 0)
            out[left[hit]] = slots[hit]
            on = ~hit & (slots >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        left = np.arange(len(hashes))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = slots[left[free]]
            self.keys[at[free]] = hashes[left[free]]
            on = self.slots[at] != slots[left]
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size, length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (found, texts))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        self._append(hashes, size, ids, length, np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))

    def _append(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray, codes: np.ndarray) -> None:
        n = len(hashes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.spelt + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        while self.n + n > len(self.size):
            self.begin, self.size, self.first, self.length, self.known, self.again = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.first, self.length, self.known, self.again)
            )
        self.flat[self.used : self.used + len(ids)] = ids
        self.codes[self.spelt : self.spelt + len(codes)] = codes
        new = slice(self.n, self.n + n)
        self.begin[new], self.size[new], self.known[new] = self.used + np.cumsum(size) - size, size, hashes
        self.first[new], self.length[new], self.again[new] = self.spelt + np.cumsum(length) - length, length, False
        self.used, self.spelt, self.n = self.used + len(ids), self.spelt + len(codes), self.n + n
        if 2 * self.n > 1 << self.bits:
            self._table((4 * self.n).bit_length())
            self._put(self.known[: self.n], np.arange(self.n, dtype=np.int32))
        else:
            self._put(hashes, np.arange(self.n - n, self.n, dtype=np.int32))

    def _shed(self) -> None:
        """Forget the pieces that only one batch held; all, if that leaves over half."""
        keep = np.flatnonzero(self.again[: self.n])
        keep = keep[: 0 if 2 * len(keep) > self.max_pieces else None]
        size, length, hashes = self.size[keep], self.length[keep], self.known[keep]
        ids, codes = self.flat[_runs(self.begin[keep], size)], self.codes[_runs(self.first[keep], length)]
        self.forget()
        self._append(hashes, size, ids, length, codes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        odd = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        ids, counts, unlike = self._plain([t if i not in odd else "" for i, t in enumerate(texts)])
        odd |= set(unlike)
        if not odd:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in odd:
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids, counts, and the texts whose ids are wrong: those with a piece unlike the known one of its hash."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), []
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        try:
            codes = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(codes, bounds[:-1][lengths > 0])
        ends = np.append(starts[1:], len(codes))
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        slot = self._find(hashes)
        new = np.flatnonzero(slot < 0)
        self.again[slot[slot >= 0]] = True
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if self.n + len(distinct) > self.max_pieces and self.n:
                self._shed()
                slot = self._find(hashes)
                new = np.flatnonzero(slot < 0)
                distinct, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._learn(distinct, [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot[new] = self._find(hashes[new])
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[_runs(self.begin[slot], size)]
        # The pieces themselves: lengths first, then every character.
        unlike = np.flatnonzero(self.length[slot] != ends - starts)
        if not len(unlike):
            same = self.codes[_runs(self.first[slot], ends - starts)] == codes
            unlike = np.searchsorted(starts, np.flatnonzero(~same), "right") - 1
        else:
            unlike = np.arange(len(starts))
        wrong = np.unique(np.searchsorted(bounds, starts[unlike], "right") - 1) if len(unlike) else unlike
        return ids, np.diff(total[np.searchsorted(starts, bounds)]), wrong.tolist()


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def piece_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin. texts: where the non-empty texts begin.

    A piece is a contraction after an apostrophe, or a run of one class with the one plain space before it, or white
    space: all of a run at a text's end, else all but its last character.
    """
    kind = char_classes()[: 256 if codes.dtype == np.uint8 else None][codes]
    start = np.ones(len(codes), bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(codes) + 1, bool)
    first[texts] = True
    start |= first[:-1]
    after = np.flatnonzero(start[1:] & ~first[1:-1] & (kind[:-1] == SPACE)) + 1  # a run right after white space
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    mark = np.flatnonzero((codes == 39) & start)
    mark = mark[mark + 1 < len(codes)]
    mark = mark[~first[mark + 1]]
    if len(mark):
        padded = np.append(codes, [0, 0])
        one, two = padded[mark + 1], padded[mark + 2]
        # The contractions s t m d, re ve ll.
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        long &= ~first[np.minimum(mark + 2, len(codes))]
        short = np.isin(one, [115, 116, 109, 100])
        start[mark[short | long] + 1] = False
        stop = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[stop[stop < len(codes)]] = True
    return np.flatnonzero(start)
