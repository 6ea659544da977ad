"""Finding many patterns in one reading of a text: a trie in flat arrays, walked from all places of many texts at once.

The first symbol picks a start state from a table; every further step is one search in the sorted array of (state, symbol)
keys for all places that are still on a path. So the cost of a text is the length of the paths that its places follow, and
does not depend on the number of patterns.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = 0x110000
CHUNK = 1 << 20  # symbols walked at once


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and where each text begins, with the end of all."""
    ends = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), ends


@dataclass
class Trie:
    """``first`` and (``keys``, ``to``) are the steps; ``best`` has, for each kind of pattern and each state, the least value of the
    patterns that end there, or ``NONE``."""
    first: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    best: np.ndarray

    NONE = np.iinfo(np.int32).max

    @staticmethod
    def build(patterns: list[str], kinds: np.ndarray, values: np.ndarray, n_kinds: int) -> "Trie":
        """All patterns together, a symbol a round: the distinct (state, symbol) pairs of a round are its new states."""
        at, begin = codes(patterns)
        length, state = np.diff(begin), np.zeros(len(patterns), np.int64)
        keys, states, live, depth = [], 1, np.flatnonzero(length > 0), 0
        while len(live):
            new, place = np.unique(state[live] * SYMBOLS + at[begin[live] + depth], return_inverse=True)
            keys.append(new)
            state[live] = states + place
            states, depth = states + len(new), depth + 1
            live = live[length[live] > depth]
        best = np.full((n_kinds, states), Trie.NONE, np.int32)
        np.minimum.at(best, (kinds, state), values.astype(np.int32))
        best[:, 0] = Trie.NONE  # empty patterns are found nowhere
        all_keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        first, n = np.zeros(SYMBOLS, np.int32), len(keys[0]) if keys else 0
        first[all_keys[:n]] = np.arange(1, n + 1)
        return Trie(first, all_keys[n:], np.arange(n + 1, states, dtype=np.int32), best)

    def walk(self, text: np.ndarray, stop: np.ndarray):
        """(depth, places, states) round by round: the places of ``text`` whose next ``depth`` symbols lead to a state. ``stop`` is
        the end of the text that each place belongs to."""
        place = np.flatnonzero(self.first[text])
        state, depth = self.first[text[place]].astype(np.int64), 1
        while len(place):
            yield depth, place, state
            on = place + depth < stop[place]
            place, state = place[on], state[on]
            if not len(self.keys) or not len(place):
                return
            key = state * SYMBOLS + text[place + depth]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            place, state, depth = place[hit], self.to[found[hit]].astype(np.int64), depth + 1


def find(trie: Trie, texts: list[str], kind: int, longest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, length, place) per text for the patterns of a kind that occur in it: the least value, or with ``longest`` that of
    the longest and then leftmost one. Values of texts without any are ``Trie.NONE``."""
    best = np.full(len(texts), Trie.NONE, np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size, hi = size + len(texts[hi]), hi + 1
        text, begin = codes(texts[lo:hi])
        owner = np.repeat(np.arange(hi - lo), np.diff(begin))
        for depth, place, state in trie.walk(text, begin[1:][owner]):
            value = trie.best[kind, state]
            some = value != Trie.NONE
            if not some.any():
                continue
            value, place_, doc = value[some], place[some] - begin[owner[place[some]]], owner[place[some]] + lo
            if longest:  # rounds come in the order of length; within a round the leftmost place of a text comes first
                doc, one = np.unique(doc, return_index=True)
                best[0][doc], best[1][doc], best[2][doc] = value[one], depth, place_[one]
            else:
                np.minimum.at(best[0], doc, value)
        lo = hi
    return best
