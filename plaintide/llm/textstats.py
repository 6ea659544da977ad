"""Statistics of whole texts, computed once per document inside Arrow batches."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaintide.llm.common import WHITE, arrow_map, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
ENDS = b".!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_log_words", "f_word_len", "f_symbols", "f_upper", "f_digits", "f_marks", "f_dup_lines", "f_repeats",
            "f_distinct", "f_lines", "f_longest", "f_line_words"]
_K = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(ids: np.ndarray, size: int = 5) -> int:
    """Number of words inside ``size``-word windows that occur twice or more in the text."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * _K + ids[j:j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def document_stats(body: bytes) -> tuple:
    """The five counts and the twelve ratios of one text; all of them are zero for a text without words."""
    words = body.split()
    n = len(words)
    if not n:
        return (0, 0, len(body) - len(body.translate(None, SYMBOLS)), 0, 0) + (0.0,) * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    bare = body.translate(None, WHITE)
    chars = len(bare.decode("utf-8", "replace"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in body.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeat_words(ids)
    k = 1.0 / max(chars, 1)
    return (n, chars, symbols, dup, rep,
            float(np.log1p(n)), chars / n, symbols * k, (len(bare) - len(bare.translate(None, UPPER))) * k,
            (len(bare) - len(bare.translate(None, DIGITS))) * k, (len(bare) - len(bare.translate(None, ENDS))) / n,
            dup / len(lines), rep / n, len(seen) / n, len(lines) / n, float(np.log1p(max(map(len, seen)))), float(np.log1p(n / len(lines))))


def with_stats(df: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, counts, ratios) per row. NULL and empty texts get zeros; repeated rows stay repeated."""
    kind = df.schema[key].dataType.simpleString()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [document_stats(x) for x in b.column("body").to_pylist()]
        cols = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.float64()) for c in cols[5:]]
        return pa.RecordBatch.from_arrays([b.column("id"), *arrays], ["id", *COUNTS, *FEATURES])
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)
    return arrow_map(texts(df, key, body), work, schema).withColumnRenamed("id", key)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, learn) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled documents, drawn by a hash of the id from the
    rows that ``learn`` (a Column over doc_id) admits. A document labelled more than once takes its larger
    label; NULL labels and ids are left out. The bound holds for what reaches the driver and for the broadcast."""
    ids = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
           .groupBy("doc_id").agg(F.max(label).alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    thin = documents.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    stats = with_stats(thin).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in FEATURES])
    rows = stats.join(F.broadcast(ids), "doc_id").orderBy("doc_id").select("y", *FEATURES).toPandas()
    return rows[FEATURES].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64)
