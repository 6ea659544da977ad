"""Keyed building blocks that stay safe when one key holds a large share of the rows."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pick_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by ``order``.

    An aggregate, not a ranking window: map tasks keep one row per key, so a key that holds a
    third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def scalar_agg(df: DataFrame, agg: Column) -> Column:
    """A one-value aggregate as a scalar subquery, which spares a cross join."""
    return df.agg(agg.alias("v")).scalar()
