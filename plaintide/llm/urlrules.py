"""URL filters: all glob rules at once by a bit-parallel automaton.

A glob is a chain of states; state j moves to j + 1 on a character of its class, and a wildcard is a state that
also stays. All chains are laid side by side in 64-bit words. One step of all patterns on one character is

    D = ((D << 1) & move[c]) | (D & stay[c])

with the carry passed from word to word. A batch of URLs is stepped together, a column of characters at a time.
In a glob ``*`` is any run without a slash and ``**`` any run.

Edge cases: a NULL url or one without ``://`` has an empty host and path and meets no rule; repeated rows give
repeated results; very long urls only cost steps for themselves; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintide.llm.common import arrow_map, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# The method's own verdict where no rule fits: globs over host and path of what is not wanted.
BLOCKED = ("spam-farm.**", "*.spam-farm.**", "**cheap-pills**", "**casino**", "**/wp-login*", "*.onion/**")


@dataclass
class Automaton:
    """``move``/``stay``: one row of words per character class; ``start``: the state set before the first
    character; ``final``: (pattern, word, bit) of the accepting states; ``alphabet``: sorted code points, the
    last class stands for all others."""
    alphabet: np.ndarray
    move: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    final: list[tuple[int, int, int]]

    @classmethod
    def compile(cls, globs: Sequence[str]) -> "Automaton":
        parsed = []
        for g in globs:
            items: list[str] = []
            i = 0
            while i < len(g):
                step = 2 if g.startswith("**", i) else 1
                items.append(g[i:i + step] if g[i] == "*" else g[i])
                i += step if g[i] == "*" else 1
            parsed.append(items)
        alphabet = np.array(sorted({ord(c) for p in parsed for c in p if c not in ("*", "**")} | {ord("/")}), dtype=np.uint32)
        n_class = len(alphabet) + 1
        total = sum(1 + sum(c not in ("*", "**") for c in p) for p in parsed)
        words = max(1, -(-total // 64))
        move, stay = np.zeros((n_class, words), np.uint64), np.zeros((n_class, words), np.uint64)
        start = np.zeros(words, np.uint64)
        slash = int(np.searchsorted(alphabet, ord("/")))
        final, at = [], 0
        for k, p in enumerate(parsed):
            bit = lambda s: (s // 64, np.uint64(1) << np.uint64(s % 64))
            w, m = bit(at)
            start[w] |= m
            for c in p:
                w, m = bit(at)
                if c in ("*", "**"):
                    for q in range(n_class):
                        if c == "**" or q != slash:
                            stay[q, w] |= m
                else:
                    at += 1
                    w, m = bit(at)
                    move[int(np.searchsorted(alphabet, ord(c))), w] |= m
            final.append((k, at // 64, at % 64))
            at += 1
        return cls(alphabet, move, stay, start, final)

    def match(self, urls: Sequence[str]) -> np.ndarray:
        """Boolean (url, pattern): which globs fit the whole url."""
        n, words = len(urls), len(self.start)
        raw = [np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32) for u in urls]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        off = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        flat = np.concatenate([raw[i] for i in order]) if n else np.zeros(0, np.uint32)
        k = np.searchsorted(self.alphabet, flat)
        code = np.where((k < len(self.alphabet)) & (self.alphabet[np.minimum(k, len(self.alphabet) - 1)] == flat), k, len(self.alphabet))
        state = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        longest = size[order]
        for t in range(int(longest[0]) if n else 0):
            live = int(np.searchsorted(-longest, -t, side="left"))  # urls longer than t come first
            c = code[off[:live] + t]
            d = state[:live]
            moved = d << one
            if words > 1:
                moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.move[c]) | (d & self.stay[c])
        hit = np.zeros((n, len(self.final)), dtype=bool)
        for p, w, b in self.final:
            hit[order, p] = (state[:, w] >> np.uint64(b)) & one == one
        return hit


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there to
    ``?``, ``#`` or the end. Both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
                blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """(key, host, path, rule, verdict). A rule (verdict, host, path) fits its host and all subdomains where the
    path starts with its own; the longest fitting rule wins (of equal ones the first). Where none fits,
    ``blocked`` globs decide and the rest is allowed."""
    globs: list[str] = []
    for _, host, path in rules:
        globs += [f"{host}{path}**", f"*.{host}{path}**"]
    machine = Automaton.compile(globs + list(blocked))
    names = [h + p for _, h, p in rules]
    ranked = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    n_rules = len(rules)
    host, path = host_and_path(F.col(url))
    kind = pages.schema[key].dataType.simpleString()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
        hit = machine.match([h + p for h, p in zip(hosts, paths)])
        best = np.full(len(hosts), -1)
        for i in reversed(ranked):
            best[hit[:, 2 * i] | hit[:, 2 * i + 1]] = i
        own = hit[:, 2 * n_rules:].any(axis=1)
        rule = [names[i] if i >= 0 else None for i in best]
        verdict = [rules[i][0] if i >= 0 else "block" if o else "allow" for i, o in zip(best, own)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                          ["id", "host", "path", "rule", "verdict"])
    thin = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    return arrow_map(thin, work, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", key)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url."""
    return filter_urls(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^?#]*') AS upto FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(upto, length(raw) + 1) AS path FROM b
), d AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?s)^([^/]*\.)?spam-farm\..*$') OR contains(host || path, 'cheap-pills')
    OR contains(host || path, 'casino') OR regexp_matches(host || path, '(?s)/wp-login[^/]*$')
    OR regexp_matches(host || path, '(?s)^[^/]*\.onion/') THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""
