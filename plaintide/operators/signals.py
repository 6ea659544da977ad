"""Many patterns over one text, and decisions over what they find.

Every pattern is reduced to literals one of which it cannot match without. An automaton finds all literals of all
patterns in one reading of the text; only the patterns whose literals occur are then tried. The decision list works on the
arrays of found signals, a batch of texts at a time.
"""
from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from typing import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from plaintide.operators.automaton import CHUNK, Trie, codes

FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "µ": "μ"})  # letters that a pattern takes for others in spite of lower-casing
MOST = 64  # literals of one pattern
ROWS = 256  # texts that are decided at once


def fold(text: str) -> str:
    return text.translate(FOLDED).lower()


def _needs(items: Iterable) -> set[str] | None:
    """Literals one of which is in every match of a parsed sequence; None if there is no such set. Of several sets the one
    whose shortest literal is longest is taken, then the smaller; a run of plain characters counts as one literal."""
    best: set[str] | None = None
    run = ""

    def offer(some: set[str] | None) -> None:
        nonlocal best
        rank = lambda x: (min(map(len, x)), -len(x))
        if some and len(some) <= MOST and (best is None or rank(some) > rank(best)):
            best = some
    for op, arg in items:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        offer({run} if run else None)
        run = ""
        if op is sre.SUBPATTERN:
            offer(_needs(arg[3]))
        elif op is sre.BRANCH:
            each = [_needs(b) for b in arg[1]]
            offer(None if any(e is None for e in each) else set().union(*each))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            offer(_needs(arg[2]))
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            offer({chr(a) for _, a in arg})
    offer({run} if run else None)
    return best


def literals(pattern: str) -> set[str] | None:
    """Folded literals one of which occurs in every text that the pattern is found in; None if the pattern has none."""
    got = _needs(parser.parse(pattern, re.I))
    return {fold(x) for x in got} if got else None


class Signals:
    """Compiled patterns by name."""

    def __init__(self, patterns: Mapping[str, str]):
        self.names, self.patterns = list(patterns), [re.compile(p, re.I) for p in patterns.values()]
        owners: dict[str, list[int]] = {}
        self.always = []
        for i, p in enumerate(patterns.values()):
            some = literals(p)
            if some is None:
                self.always.append(i)
            for x in some or ():
                owners.setdefault(x, []).append(i)
        words = sorted(owners)
        self.owners = np.zeros((len(words), len(self.names)), bool)
        for k, w in enumerate(words):
            self.owners[k, owners[w]] = True
        self.trie = Trie.build(words, np.zeros(len(words), np.int64), np.arange(len(words)), 1)

    def found(self, texts: list[str]) -> dict[str, np.ndarray]:
        """For each name, in which of the texts its pattern is found."""
        may = np.zeros((len(texts), len(self.names)), bool)
        may[:, self.always] = True
        for lo in range(0, len(texts), 256):
            text, begin = codes([fold(t) for t in texts[lo:lo + 256]])
            owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            for _, place, state in self.trie.walk(text, begin[1:][owner]):
                word = self.trie.best[0, state]
                some = word != Trie.NONE
                doc, word = owner[place[some]], word[some]
                for key in np.unique(doc * len(self.owners) + word).tolist():
                    may[lo + key // len(self.owners)] |= self.owners[key % len(self.owners)]
        out = np.zeros_like(may)
        for i, k in zip(*[x.tolist() for x in np.nonzero(may)]):
            out[i, k] = self.patterns[k].search(texts[i]) is not None
        return {n: out[:, k] for k, n in enumerate(self.names)}


def holds(term, found: Mapping[str, np.ndarray], squeezed: Mapping[str, np.ndarray], size: np.ndarray) -> np.ndarray:
    """In which texts a term holds (see the pack for its forms); the empty term holds in all."""
    if isinstance(term, str):
        return found[term]
    if not term:
        return np.ones(len(size), bool)
    kind, *rest = term
    if kind == "squeezed":
        return squeezed[rest[0]]
    if kind == "max":
        return (size > 0) & (size <= rest[0]) & holds(rest[1], found, squeezed, size)
    each = [holds(t, found, squeezed, size) for t in rest]
    if kind == "not":
        return ~each[0]
    return np.logical_or.reduce(each) if kind == "any" else np.logical_and.reduce(each)


def _squeezed_names(term) -> set[str]:
    if isinstance(term, str) or not term:
        return set()
    if term[0] == "squeezed":
        return {term[1]}
    return set().union(*[_squeezed_names(t) for t in term[1:] if not isinstance(t, int)])


def decide(pack: Mapping, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, eligible) of each text: the first blocking code, else the first eligible one, else ``no_capture_pattern``."""
    signals = _compiled(pack)
    bare = [re.sub(r"\s+", "", t) for t in texts]
    size = np.array([len(b) for b in bare], np.int64)
    found = signals.found(texts)
    wanted = set().union(*[_squeezed_names(t) for _, t in pack["eligible"]]) if pack["eligible"] else set()
    squeezed = {n: np.array([len(b) > 0 and signals.patterns[signals.names.index(n)].search(b) is not None for b in bare], bool) for n in wanted}
    for name, term in pack["terms"].items():
        found[name] = holds(term, found, squeezed, size)
    code, eligible = np.full(len(texts), "no_capture_pattern", object), np.zeros(len(texts), bool)
    for name, term in reversed(pack["eligible"]):
        hit = holds(term, found, squeezed, size)
        code[hit] = "eligible:" + name
        eligible |= hit & ~found[pack["named_only"][name]] if name in pack.get("named_only", {}) else hit
    blocked = size == 0
    code[blocked] = "empty_text"
    for name, term in reversed(pack["blocked"]):
        hit = holds(term, found, squeezed, size) & (size > 0)
        code[hit] = "blocked:" + name
        blocked |= hit
    return code, eligible & ~blocked


def slices(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in runs of at most ``ROWS`` rows and ``CHUNK`` symbols; a longer text is a run of its own."""
    some, size = [], 0
    for t in texts:
        if some and (len(some) == ROWS or size + len(t) > CHUNK):
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


_seen: dict[str, Signals] = {}


def _compiled(pack: Mapping) -> Signals:
    key = repr(sorted(pack["signals"].items()))
    return _seen.get(key) or _seen.setdefault(key, Signals(pack["signals"]))


def decision(pack: Mapping) -> Callable[[Column], Column]:
    """A column of (code string, eligible boolean) for a trimmed text."""
    plain = {k: pack[k] for k in ("signals", "terms", "blocked", "eligible")} | {"named_only": dict(pack.get("named_only", {}))}

    @F.pandas_udf("code string, eligible boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts in slices(batch.fillna("")):
                code, eligible = decide(plain, texts)
                yield pd.DataFrame({"code": code, "eligible": eligible})
    return run
