"""Rule tables compiled to columns: ordered patterns, weighted words, keyword routes.

A rule table is plain data. Long word lists are counted by one higher-order function over a
constant array, so the expression does not grow with the list.
"""
from __future__ import annotations

import re
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from plaintide.functions.common import all_of, any_case, bound, swapped

TRIPLE = "struct<l1:string,l2:string,l3:string,confidence:double,match_type:string>"


def triple(l1, l2, l3, confidence, match_type) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(l1).cast("string").alias("l1"), lit(l2).cast("string").alias("l2"), lit(l3).cast("string").alias("l3"),
                    lit(confidence).cast("double").alias("confidence"), lit(match_type).cast("string").alias("match_type"))


def no_triple() -> Column:
    return F.lit(None).cast(TRIPLE)


def has(t: Column, pattern: str) -> Column:
    return any_case(t, pattern, "s")


def plain_words(pattern: str) -> list[str]:
    """The words of a pattern that is a choice of plain words in a to z; none for any other."""
    return pattern.split("|") if re.fullmatch("[a-z]+([|][a-z]+)*", pattern) else []


def has_word(t: Column, words: Sequence[str]) -> Column:
    """Whether any word occurs. Bytes are compared, word by word up to the first hit, which is faster than one pattern of all."""
    if not words:
        return F.lit(False)
    return bound(t, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)))


def word_count(t: Column, words: Sequence[str]) -> Column:
    """How many words of the list occur (a word listed twice counts twice)."""
    if not words:
        return F.lit(0)
    return bound(t, lambda x: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))))


def sequence_match(t: Column, parts: Sequence[str], deny: str = "", alone: Callable = has) -> Column:
    """The parts occur in this order. Each part is first looked for alone: a linear test that spares
    most texts the backtracking of the joined pattern."""
    tests = [alone(t, p) for p in parts]
    if len(parts) > 1:
        tests.append(has(t, ".*".join(f"(?:{p})" for p in parts)))
    if deny:
        tests.append(~alone(t, deny))
    return all_of(tests) if len(tests) > 1 else tests[0]


def first_rule_lower(low: Column, rules: Sequence[Mapping], match_type: str = "rule") -> Column:
    """``first_rule`` on a lower-cased text. Plain words are looked for without a pattern: of the letters that lower case leaves,
    only the long s folds to one of a to z."""
    def found(folded: Column) -> Column:
        return first_rule(low, rules, match_type, lambda t, p: has_word(folded, plain_words(p)) if plain_words(p) else has(t, p))
    return bound(swapped(low, "ſ", "s"), found)


def first_rule(t: Column, rules: Sequence[Mapping], match_type: str = "rule", alone: Callable = has) -> Column:
    """Labels of the first rule that holds, as a triple; NULL if none. ``alone`` looks for a single part or for what is denied."""
    out = None
    for r in rules:
        cond = sequence_match(t, r["parts"], r.get("deny", ""), alone)
        value = triple(r["l1"], r["l2"], r["l3"], r["confidence"], match_type)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if out is not None else no_triple()


def weighted_score(t: Column, low: Column, entries: Sequence[Mapping]) -> Column:
    """Sum of weights. ``each`` scores every word that occurs, otherwise one hit scores once;
    ``also`` lists groups of which one word each must occur, ``unless`` words that cancel."""
    total = F.lit(0.0)
    for e in entries:
        body = low if e.get("lower") else t
        n = word_count(body, e["words"]) if e.get("each", True) else F.when(has_word(body, e["words"]), 1).otherwise(0)
        gate = [has_word(t, g) for g in e.get("also", ())]
        if e.get("unless"):
            gate.append(~has_word(t, e["unless"]))
        score = n * F.lit(float(e["weight"]))
        total = total + (F.when(all_of(gate), score).otherwise(0.0) if gate else score)
    return total


def route(t: Column, low: Column, entries: Sequence[Mapping]) -> Column:
    """Target of the heaviest group that occurs, the earliest on a tie; NULL if none."""
    options = []
    for pos, e in enumerate(entries):
        cond = has_word(low if e.get("lower") else t, e["words"])
        if e.get("also"):
            cond = cond & has_word(t, e["also"])
        if e.get("unless"):
            cond = cond & ~has_word(low, e["unless"])
        options.append(F.when(cond, F.struct(F.lit(e["weight"]).alias("w"), F.lit(-pos).alias("p"), F.lit(e["target"]).alias("t"))))
    if not options:
        return F.lit(None).cast("string")
    return F.array_max(F.array(*options))["t"]


def ordered_case(pairs: Sequence[tuple[Column, Column | str]], default=None) -> Column:
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))
