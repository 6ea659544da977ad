"""Term share per document and per class."""
from __future__ import annotations

import re
from collections import Counter
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.functions.text import keyword_tokens
from plaintide.packs import words as wp


def keyword_counts(df: DataFrame, by: Sequence[str], body: str, drop: Sequence[str] = wp.STOP_WORDS + wp.GENERAL_WORDS) -> DataFrame:
    """(by..., label, n): how often each of the ``keyword_tokens`` occurs in the texts of a group. A task counts the words of a
    batch, so that distinct words are judged and sent on, and not their places."""
    thin = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lower(F.col(body)).alias("body"))
    keys, unwanted = thin.columns[:-1], frozenset(drop)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[一-龥a-z0-9]+").findall
        for b in it:
            first, found = {}, {}
            for i, key in enumerate(zip(*[b.column(k).to_pylist() for k in keys]) if keys else [()] * b.num_rows):
                t = b.column("body")[i].as_py()
                if t:
                    found.setdefault(first.setdefault(key, i), Counter()).update(runs(t))
            at = [(i, w, n) for i, c in found.items() for w, n in c.items() if len(w) >= 2 and w not in unwanted and not w.isdigit()]
            row, label, n = zip(*at) if at else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(row, pa.int64())) for k in keys] + [pa.array(label, pa.string()), pa.array(n, pa.int64())],
                                             [*keys, "label", "n"])
    kinds = "".join(f"{k} {thin.schema[k].dataType.simpleString()}, " for k in keys)
    counted = thin.mapInArrow(run, kinds + "label string, n long").groupBy(*keys, "label").agg(F.sum("n").alias("n"))
    return counted.toDF(*by, "label", "n")


def token_counts(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, token, n). Map tasks pre-aggregate before the shuffle."""
    return (df.select(key, F.explode(keyword_tokens(body)).alias("token"))
            .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")))


def keyword_tf(df: DataFrame, key: str = "doc_id", body: str = "text", top: int = 20,
               with_idf: bool = False) -> DataFrame:
    """Top terms of each document by share of its tokens. ``with_idf`` weights by the real
    inverse document frequency.

    Texts are dealt by key once; counts, totals and ranks stay in that dealing, and one order of a document's distinct words
    serves both windows. The group is bounded by one text's distinct words.
    """
    # A stated number of partitions: the texts are small beside the work on them.
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = token_counts(df.select(key, body).repartition(n, key), key, body)
    own = Window.partitionBy(key)
    if with_idf:
        docs = df.agg(F.count_distinct(key).alias("d")).scalar()
        freq = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        scored = counts.withColumn("score", F.col("n") / F.sum("n").over(own)).join(freq, "token").withColumn(
            "score", F.col("score") * F.ln((docs + 1) / (F.col("df") + 1)) + F.lit(0.0))
        ranked = scored.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), F.asc("token"))))
    else:
        ranked = counts.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), F.asc("token")))).withColumn("score", F.col("n") / F.sum("n").over(own))
    return ranked.filter(F.col("rank") <= top).select(key, "token", "n", "score", "rank")


def keyword_text(df: DataFrame, key: str, body: str, top: int = 20) -> DataFrame:
    """(key, extracted_keywords): the top terms joined by commas in rank order."""
    ranked = keyword_tf(df, key, body, top)
    terms = F.array_sort(F.collect_list(F.struct("rank", "token")))
    return ranked.groupBy(key).agg(F.concat_ws(",", F.transform(terms, lambda t: t["token"])).alias("extracted_keywords"))


def class_top_words(df: DataFrame, label: Column | str, body: str, min_count: int = 3, top: int = 50,
                    known: DataFrame | None = None) -> DataFrame:
    """Words of each class that occur at least ``min_count`` times, the top ones, merged with the
    words already known for the class."""
    lab = F.col(label) if isinstance(label, str) else label
    counts = (df.select(lab.alias("label"), F.explode(keyword_tokens(body)).alias("word"))
              .groupBy("label", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))
    # A class may hold most words of the vocabulary: rank inside salted slices first.
    from plaintide.functions.common import top_rows
    ranked = top_rows(counts, ["label"], [F.desc("n"), F.asc("word")], top, salt_by=["word"]).drop("rn")
    if known is None:
        return ranked
    return (ranked.unionByName(known.select("label", "word", F.lit(0).cast("bigint").alias("n")))
            .groupBy("label", "word").agg(F.max("n").alias("n")))


def keyword_weights(df: DataFrame, label: str, words: Column, boost: float = 1.08, cap: float = 6.0,
                    keep: int = 280) -> DataFrame:
    """Weight of (class, word) after n reviews that named it: min(cap, boost^n), four digits;
    the newest ``keep`` words per class."""
    from plaintide.functions.common import top_rows

    counts = (df.select(F.col(label).alias("label"), "id", F.explode(words).alias("word"))
              .filter((F.col("label") != "") & (F.length("word") >= 2))
              .groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")))
    ranked = top_rows(counts, ["label"], [F.desc("first_id"), F.asc("word")], keep, salt_by=["word"]).drop("rn")
    return ranked.select("label", "word", "n", F.round(
        F.least(F.lit(cap), F.pow(F.lit(boost), F.col("n"))), 4).alias("weight"))


def keyword_stats(df: DataFrame) -> DataFrame:
    """Words per class with the grand total as class ``*``."""
    return (df.rollup("label").agg(F.count(F.lit(1)).alias("words"))
            .select(F.coalesce("label", F.lit("*")).alias("label"), "words"))
