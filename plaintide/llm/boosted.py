"""Quality rules: boosted trees over document statistics behind plain base rules.

Trees are flattened into node arrays and score whole batches. Constraints: more symbols, more repeated lines
and more repeated words can never raise a score.

Edge cases: NULL and empty texts fail the base rules; repeated rows give repeated results; without labels the
method keeps what passes the base rules; other columns are ignored.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaintide.llm import trees
from plaintide.llm.common import held_out, table
from plaintide.llm.textstats import COUNTS, FEATURES, labelled_sample, with_stats

FALLING = ("f_symbols", "f_dup_lines", "f_repeats")


def score(stats: DataFrame, flat: dict[str, np.ndarray], features: list[str] = FEATURES) -> DataFrame:
    """Adds ``score``, the probability of label 1, to a table of statistics."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
            yield b.append_column("score", pa.array(trees.sigmoid(trees.margin(flat, x)), pa.float64()))
    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def judge(documents: DataFrame, labels: DataFrame, label: str = "quality", max_labels: int = 20_000, keep_from: float = 0.5,
          modulus: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept). Learns from at most ``max_labels`` labelled documents outside
    the held-out share; every document is judged on its whole text."""
    x, y = labelled_sample(documents, labels, label, max_labels, ~held_out("doc_id", modulus, rest))
    model = trees.fit(x, y, monotone={FEATURES.index(f): -1 for f in FALLING})
    if not len(y):
        model = trees.Forest(40.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (score(with_stats(documents), model.flat())
            .select("doc_id", *COUNTS, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= keep_from)).alias("kept")))


def op10_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and boosted verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
