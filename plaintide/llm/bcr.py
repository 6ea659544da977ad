"""Burrows-Wheeler transform and common prefixes of a collection, built a column at a time.

Round j inserts, for every string that is long enough, the symbol before its suffix of length j - 1, and with it the row
of its suffix of length j. A round reads the transform and the common prefixes of the rounds before once, front to back,
and writes them anew: the two arrays are the sequential files of the method, held as buffers because a caller bounds the
collection. No suffix array is kept.

A symbol may stand for several bytes. ``repeated`` reads a string in words of eight bytes, once for each of the eight
phases: that is eight times as many strings of an eighth of the length, and an eighth of the work.
"""
from __future__ import annotations

import numpy as np

CAP = 250  # common prefixes are counted up to here, in symbols
WORD = 8


def build(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of the strings of ``size`` symbols that lie end to end in ``text``. Symbols are
    unsigned and above 0; in the transform 0 stands before a string. Ends are ordered by string. Row r's common prefix is
    that with row r - 1, at most CAP."""
    d, end, kind = len(size), np.cumsum(size), text.dtype

    def symbol(who: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix of length j."""
        has = size[who] > j
        out = np.zeros(len(who), kind)
        out[has] = text[end[who[has]] - 1 - j]
        return out
    every = np.arange(d)
    bwt, lcp = symbol(every, 0), np.zeros(d + 1, np.uint8)  # one spare entry ends the last range
    active, row = every[size > 0], every[size > 0]
    for j in range(1, int(size.max(initial=0)) + 1):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")  # rows by symbol: the rows of the next longer suffixes
        done = int(np.count_nonzero(bwt == 0))
        fresh = np.zeros(n, dtype=bool)
        fresh[row] = True
        k = np.flatnonzero(fresh[order])
        into = d + k - done
        by = np.lexsort((row, bwt[row]))
        active = active[by]
        # Common prefixes of the new rows and of the rows after them: one more than the least between their tails.
        kk = np.unique(np.concatenate([k, k + 1]))
        kk = kk[kk < n]
        above = order[np.maximum(kk - 1, 0)]
        same = (kk > done) & (bwt[above] == bwt[order[kk]])
        value = np.zeros(len(kk), np.uint8)
        lo, hi = above[same] + 1, order[kk[same]] + 1
        if len(lo):
            back = np.argsort(-lo, kind="stable")  # falling starts: no work between the ranges
            pairs = np.stack([lo[back], hi[back]], axis=1).ravel()
            least = np.empty(len(lo), np.uint8)
            least[back] = np.minimum.reduceat(lcp, pairs)[::2]
            value[same] = np.minimum(least.astype(np.int16) + 1, CAP)
        grown = n + len(k)
        old = np.ones(grown, dtype=bool)
        old[into] = False
        new_bwt, new_lcp = np.empty(grown, kind), np.zeros(grown + 1, np.uint8)
        new_bwt[old], new_lcp[:-1][old] = bwt, lcp[:-1]
        new_bwt[into] = symbol(active, j)
        new_lcp[d + kk - done] = value
        bwt, lcp = new_bwt, new_lcp
        more = size[active] > j
        active, row = active[more], into[more]
    return bwt, lcp[:-1]


def _longer(bwt: np.ndarray, d: int) -> np.ndarray:
    """For each row whose symbol is not 0, the row of the suffix that this symbol begins."""
    order = np.argsort(bwt, kind="stable")
    done = int(np.count_nonzero(bwt == 0))
    out = np.empty(len(bwt), dtype=np.int64)
    out[order[done:]] = d + np.arange(len(bwt) - done)
    return out


def repeated(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, whether the ``window`` bytes from each start occur at another start of the collection as well."""
    if window % WORD or window // WORD > CAP:
        raise ValueError(f"the window must be a multiple of {WORD} and at most {WORD * CAP}")
    length = np.array([len(s) for s in strings], dtype=np.int64)
    base = np.cumsum(length) - length
    out_base = np.cumsum(np.concatenate([[0], np.maximum(length - window + 1, 0)]))
    flat = np.zeros(out_base[-1], dtype=bool)
    if len(flat):
        raw = np.frombuffer(b"".join(strings) + bytes(WORD), np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(raw, WORD)[:-1]
        words = np.ascontiguousarray(words).view(np.uint64).ravel()
        # One reading per string and phase: the words from the phase on, as far as whole ones fit.
        first = (base[:, None] + np.arange(WORD)).ravel()
        count = np.maximum((length[:, None] - np.arange(WORD)) // WORD, 0).ravel()
        where = np.repeat(first, count) + WORD * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        kinds, code = np.unique(words[where], return_inverse=True)
        code = (code + 1).astype(np.uint16 if len(kinds) < 65_535 else np.uint32)
        bwt, lcp = build(code, count)
        deep = lcp >= window // WORD
        twice = deep.copy()
        twice[:-1] |= deep[1:]
        longer, n_words = _longer(bwt, len(count)), window // WORD
        who = np.flatnonzero(count >= n_words)
        row = who.copy()
        for j in range(1, int(count.max()) + 1):
            row = longer[row]
            if j >= n_words:
                flat[out_base[who // WORD] + who % WORD + WORD * (count[who] - j)] = twice[row]
            more = count[who] > j
            who, row = who[more], row[more]
    return [flat[a:b] for a, b in zip(out_base[:-1], out_base[1:])]
