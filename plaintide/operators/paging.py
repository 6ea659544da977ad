"""One page of an ordering, without sorting the rows before it.

A count per range of the first order column says in which ranges a page lies and how many rows come before them. If the
first of these ranges is large, its rows alone are counted by finer ranges, and so on through the order columns, until the
rows before the page within its range are few. Then one range is read and sorted. The counts also give the total.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NEAR = 10_000  # rows that may be sorted before a page's first row
FAN = 1024  # ranges of a number column in one count


@dataclass(frozen=True)
class By:
    """An order column, text or integer; NULL comes last either way. A text is divided by its first ``steps`` characters in
    turn, then by two more at a time."""
    name: str
    descending: bool = False
    steps: Sequence[int] = (2,)

    def order(self) -> Column:
        return F.desc_nulls_last(self.name) if self.descending else F.asc_nulls_last(self.name)


def _divisions(rows: DataFrame, by: By) -> Iterator[Column]:
    """Ever finer range keys of a column, in its order; the last one tells all values apart."""
    if isinstance(rows.schema[by.name].dataType, T.StringType):
        longest = rows.agg(F.max(F.length(by.name))).first()[0] or 0
        steps = [n for n in by.steps if n < longest]
        for n in [*steps, *range((steps[-1] if steps else 0) + 2, longest, 2), max(1, longest)]:
            yield F.substring(by.name, 1, n)
        return
    lo, hi = rows.agg(F.min(by.name), F.max(by.name)).first()
    width = hi - lo + 1 if lo is not None else 1
    while width > 1:
        width = -(-width // FAN)
        yield F.floor(F.col(by.name) / F.lit(width)) if width > 1 else F.col(by.name)


def _ranges(rows: DataFrame, key: Column, descending: bool) -> list[tuple]:
    """(key, number of rows) in order, NULL last."""
    got = [tuple(r) for r in rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()]
    known = sorted([x for x in got if x[0] is not None], key=lambda x: x[0], reverse=descending)
    return known + [x for x in got if x[0] is None]


def _within(key: Column, keys: list) -> Column:
    known = [k for k in keys if k is not None]
    return F.coalesce(key.between(F.lit(min(known)), F.lit(max(known))), F.lit(None in keys)) if known else key.isNull()


def page_rows(rows: DataFrame, order: Sequence[By], page: int, size: int, near: int = NEAR) -> tuple[DataFrame, int]:
    """(rows of the page in order, number of all rows). Pages count from one; a page past the end is empty. The order should
    tell all rows apart, or rows that share a place change places from page to page."""
    first, here, total, parts = (page - 1) * size, rows, None, []
    sort = [b.order() for b in order]
    for by, key in ((by, key) for by in order for key in _divisions(here, by)):
        ranges = _ranges(here, key, by.descending)
        if total is None:
            total = sum(n for _, n in ranges)
        if first >= sum(n for _, n in ranges):
            return rows.limit(0), total
        i = 0
        while ranges[i][1] <= first:
            first, i = first - ranges[i][1], i + 1
        j, held = i, ranges[i][1]
        while held < first + size and j + 1 < len(ranges):
            j, held = j + 1, held + ranges[j + 1][1]
        keys = [k for k, _ in ranges[i:j + 1]]
        if first <= near:
            here = here.filter(_within(key, keys))
            break
        # Only the first of these ranges is divided further; what the page takes of the others are their first rows.
        if j > i:
            left = first + size - ranges[i][1]
            parts.append(here.filter(_within(key, keys[1:])).orderBy(*sort).limit(left))
            size -= left
        here = here.filter(_within(key, keys[:1]))
    got = here.orderBy(*sort).offset(first).limit(size)
    for p in parts:
        got = got.unionByName(p)
    return got.orderBy(*sort) if parts else got, total or 0
