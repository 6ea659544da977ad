"""Models of one's own on a column of texts: the predict and the embed hook.

A hook is a loader: a function without arguments that gives a function from a list of texts to a list of answers. It is
called once in each task, where it may read a file or open a client, and never on the driver. Texts reach the model in
batches of a bounded number and size, whatever the size of Spark's own batches. A batch that fails is tried text by text, so one
bad text costs only its own answer; its error stands beside it.
"""
from __future__ import annotations

import hashlib
from typing import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Model = Callable[[list[str]], Sequence]
Loader = Callable[[], Model]
ROWS = 512  # texts whose answers are held at once


def _slices(texts: list[str], most: int, most_chars: int) -> Iterator[list[str]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and hi - lo < most and size + len(texts[hi]) <= most_chars:
            size, hi = size + len(texts[hi]), hi + 1
        yield texts[lo:hi]
        lo = hi


def _answers(model: Model, texts: list[str]) -> list[tuple]:
    """(answer, error) of each text."""
    try:
        got = list(model(texts))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} answers for {len(texts)} texts")
        return [(x, None) for x in got]
    except Exception as e:  # whatever a model may raise
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:300])]
        return [a for t in texts for a in _answers(model, [t])]


def apply_model(df: DataFrame, load: Loader, body: str = "original_text", out: str = "prediction", kind: str = "string",
                most: int = 64, most_chars: int = 200_000) -> DataFrame:
    """``df`` with the model's answer in ``out`` and, where it failed, what it raised in ``out`` + ``_error``. NULL texts are not
    given to the model and have no answer."""
    @F.pandas_udf(f"answer {kind}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        # Answers leave in small batches of their own, so that no batch of Spark's is held with all its answers.
        for texts in (b.iloc[lo:lo + ROWS] for b in batches for lo in range(0, len(b), ROWS)):
            rows: list[tuple] = [(None, None)] * len(texts)
            some = np.flatnonzero(texts.notna().to_numpy()).tolist()
            got = [a for part in _slices([texts.iat[i] for i in some], most, most_chars) for a in _answers(model, part)]
            for i, a in zip(some, got):
                rows[i] = a
            yield pd.DataFrame(rows, columns=["answer", "error"])
    d = df.withColumn("_answer", run(F.col(body)))
    return d.withColumns({out: F.col("_answer.answer"), f"{out}_error": F.col("_answer.error")}).drop("_answer")


def keyword_model(pack: Mapping) -> Loader:
    """The default predict hook: the class of the largest weight of words that occur, the earlier class on a tie, else empty."""
    classes = [(cls, weight, [w.lower() for w in words]) for cls, weight, words in pack["weights"]]

    def load() -> Model:
        def answer(text: str) -> str:
            low = text.lower()
            scores = [weight * sum(w in low for w in words) for _, weight, words in classes]
            best = int(np.argmax(scores))
            return classes[best][0] if scores[best] else ""
        return lambda texts: [answer(t) for t in texts]
    return load


def hashing_model(dim: int = 256, ngram: int = 3) -> Loader:
    """The default embed hook: signed counts of hashed character n-grams at unit length, the vectors of ``hashing_embedding``."""
    def load() -> Model:
        place: dict[str, tuple[int, int]] = {}

        def vector(text: str) -> list[float]:
            t = "".join(text.lower().split())
            t = (t + "·" * ngram)[:ngram] if len(t) < ngram else t
            v = np.zeros(dim)
            for i in range(len(t) - ngram + 1):
                g = t[i:i + ngram]
                if g not in place:
                    if len(place) > 500_000:
                        place.clear()
                    h = int(hashlib.md5(g.encode()).hexdigest(), 16)
                    place[g] = (h % dim, 1 if h >> 8 & 1 else -1)
                at, sign = place[g]
                v[at] += sign
            length = np.linalg.norm(v)
            return (v / length if length else v).tolist()
        return lambda texts: [vector(t) for t in texts]
    return load


def embed(df: DataFrame, load: Loader | None = None, body: str = "original_text", out: str = "vector", **limits: int) -> DataFrame:
    """``df`` with a vector of each text; NULL texts count as empty."""
    d = df.withColumn("_body", F.coalesce(F.col(body), F.lit("")))
    return apply_model(d, load or hashing_model(), "_body", out, "array<double>", **limits).drop("_body")
