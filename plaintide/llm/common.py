"""What the operators of this subpackage share: table access, the held-out split, text columns for Arrow."""
from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintide.functions.common import look_up  # noqa: F401

WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, modulus: int, rest: int) -> Column:
    """True for the rows kept from learning: crc32 of the id as text, modulo ``modulus``. A NULL id counts as
    the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def texts(df: DataFrame, key: str = "doc_id", body: str = "text", *more: Column) -> DataFrame:
    """(id, body, ...): the key and the text as UTF-8 bytes, NULL read as empty. Other columns of the input
    are left out, so that their names cannot clash."""
    return df.select(F.col(key).alias("id"), F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("body"), *more)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives back to the system what a task has freed; its Python process goes on to serve other tasks."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch for each input batch; empty batches give nothing."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows and (out := work(b)) is not None:
                yield out
        b = out = None
        release()
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_kept: dict = {}


def kept(name: tuple, make: Callable):
    """What a task leaves in its Python process for later tasks: one thing at a time, because the tasks of all stages of a
    session share these processes, and what each stage left there would add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]
