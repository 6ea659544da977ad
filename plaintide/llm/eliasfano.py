"""Elias-Fano sequences and the two-level n-gram trie made of them. All parts are flat buffers that are mapped, not parsed."""
from __future__ import annotations

import mmap
import struct

import numpy as np


class EliasFano:
    """A rising sequence of n integers below a bound in about 2 + log2(bound / n) bits each.

    The low bits of each value are packed; the high bits are a bit vector with a one per value and a zero per bucket.
    ``buffer`` holds everything; the start of each bucket is a directory that is counted when the buffer is mapped.
    """

    def __init__(self, buffer: bytes | memoryview):
        self.n, self.low_bits, n_buckets, low_bytes = struct.unpack_from("<QQQQ", buffer)
        raw = np.frombuffer(buffer, np.uint8)
        self._low = np.lib.stride_tricks.sliding_window_view(raw[32:32 + low_bytes + 8], 8) if self.low_bits else None
        ones = np.unpackbits(raw[32 + low_bytes + 8:], bitorder="little", count=self.n + n_buckets)
        zero = np.flatnonzero(ones == 0)
        self._start = np.concatenate([[0], zero - np.arange(len(zero))])  # values before each bucket

    @staticmethod
    def encode(values: np.ndarray, bound: int) -> bytes:
        n = len(values)
        v = values.astype(np.uint64)
        low_bits = max(0, min(56, (int(bound) // max(n, 1)).bit_length() - 1))
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        n_buckets = (int(bound) >> low_bits) + 1
        packed = np.zeros(-(-n * low_bits // 8) + 8, np.uint8)
        if low_bits:
            low = v & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            spread = low << (bit & 7).astype(np.uint64)  # at most 63 bits
            for lo in range(0, n, 1 << 16):  # a piece at a time, so that little is held
                part = slice(lo, lo + (1 << 16))
                for k in range(-(-(low_bits + 7) // 8)):
                    np.bitwise_or.at(packed, (bit[part] >> 3) + k, ((spread[part] >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8))
        bits = np.zeros(n + n_buckets, np.uint8)
        bits[high + np.arange(n)] = 1
        return struct.pack("<QQQQ", n, low_bits, n_buckets, len(packed) - 8) + packed.tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def _low_of(self, i: np.ndarray) -> np.ndarray:
        if self._low is None:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low_bits
        word = np.ascontiguousarray(self._low[bit >> 3]).view("<u8").ravel()
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value not below each x (n if there is none); ``first``/``last`` confine the search to a range
        of indexes, such as the children of a node."""
        x = x.astype(np.uint64)
        h = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), len(self._start) - 2)
        beyond = (x >> np.uint64(self.low_bits)).astype(np.int64) > len(self._start) - 2
        lo, hi = self._start[h], self._start[h + 1]
        lo = np.where(beyond, hi, lo)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, last)
            hi = np.maximum(lo, hi)
        lo, hi = lo.copy(), hi.copy()
        want = x & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(x), np.uint64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low_of(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at indexes below n."""
        h = np.searchsorted(self._start, i, side="right") - 1
        return (h.astype(np.uint64) << np.uint64(self.low_bits)) | self._low_of(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, -1 where it is missing."""
        at = self.successor(x, first, last)
        ok = at < (self.n if last is None else last)
        out = np.full(len(x), -1, dtype=np.int64)
        some = np.flatnonzero(ok)
        out[some] = np.where(self.get(at[some]) == x[some].astype(np.uint64), at[some], -1)
        return out


class Trie:
    """Level 1: words; level 2: the words before each of them. A word of level 2 is numbered among the words that
    precede anything here, and the numbers under all nodes of level 1 are one rising sequence (node * range + number), so a
    child is found by a successor search within its parent's pointers. Each entry has a 16-bit quantised log
    probability."""

    PARTS = ("words", "before", "pointers", "children")

    def __init__(self, buffer: bytes):
        held = mmap.mmap(-1, max(1, len(buffer)))
        held.write(buffer)
        view, at, parts = memoryview(held), 0, []
        for _ in range(6):
            (size,) = struct.unpack_from("<Q", view, at)
            parts.append(view[at + 8:at + 8 + size])
            at += 8 + size
        self.words, self.before, self.pointers, self.children = (EliasFano(p) for p in parts[:4])
        self.word_code, self.child_code = (np.frombuffer(p, np.uint16) for p in parts[4:])

    @staticmethod
    def encode(words: np.ndarray, word_code: np.ndarray, before: np.ndarray, node: np.ndarray, child: np.ndarray, child_code: np.ndarray) -> bytes:
        """``words``, ``before``: sorted 64-bit hashes; entries (node, child) sorted, as indexes into them."""
        span = max(1, len(before))
        pointers = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(words)))])
        parts = [EliasFano.encode(words, (1 << 64) - 1), EliasFano.encode(before, (1 << 64) - 1), EliasFano.encode(pointers, int(pointers[-1]) + 1),
                 EliasFano.encode(node.astype(np.uint64) * np.uint64(span) + child.astype(np.uint64), max(1, len(words)) * span),
                 word_code.astype(np.uint16).tobytes(), child_code.astype(np.uint16).tobytes()]
        return b"".join(struct.pack("<Q", len(p)) + p for p in parts)

    def lookup(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level 1 index, level 2 index) of each pair, -1 where missing."""
        node, child = self.words.find(word), self.before.find(before)
        out = np.full(len(word), -1, dtype=np.int64)
        both = np.flatnonzero((node >= 0) & (child >= 0))
        if len(both):
            first, last = (self.pointers.get(node[both] + k).astype(np.int64) for k in (0, 1))
            key = node[both].astype(np.uint64) * np.uint64(max(1, self.before.n)) + child[both].astype(np.uint64)
            out[both] = self.children.find(key, first, last)
        return node, out
