"""Approximate nearest neighbours by an inverted multi-index.

Each vector is halved and each half is quantised by its own codebook, so K + K centroids name K * K cells. A query walks
cells in order of the summed distance of its halves to the two centroids, with a heap over the sorted halves, until the
cells visited hold its share of the entries; those are reranked by the exact distance.

Codebooks are fitted on a bounded sample (``sample_rows``, by a hash of the id). The share is calibrated on the same
sample, so that queries drawn from it find ``recall`` of their true neighbours: clustered data needs a few cells, data
without structure a large part of all. Every vector is indexed.

Entries are laid out in blocks of bounded size by the first half's cell and a salt, queries in blocks as well; a pair of
blocks is one group, which returns at most k rows per query. Cell sizes (K * K numbers, K at most ``max_centroids``)
pass the driver.

Edge cases: NULL vectors, vectors with NULL, NaN or infinite components and zero vectors take no part, nor do vectors of
another length than the commonest; equal distances go to the smaller id; equal rows (id and vector) count once, as
queries and as candidates; an id on different vectors is one query for each of them, told apart by ``query_vec``, a hash
of the vector, and one candidate for each of them; rows are no candidates of rows with their own id; a table with fewer
candidates returns them all; other columns are ignored.
"""
from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaintide.llm.common import table
from plaintide.session import materialise

ENTRY_BLOCK = 4096
QUERY_BLOCK = 1024


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0.0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centroids by Lloyd's rounds; an empty centroid moves to the worst-served point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = squared(x, c)
        a = d.argmin(1)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
        for j, far in zip(np.flatnonzero(n == 0), np.argsort(-d.min(1))):
            c[j] = x[far]
    return c


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells i * K2 + j in order of d1[i] + d2[j], until they hold ``wanted`` entries: a heap holds the next cell of
    each row of the sorted grid."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, k2 = [(s1[0] + s2[0], 0, 0)], len(d2)
    cells, got = [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k2 + int(o2[j])
        if sizes[cell]:
            cells.append(cell)
            got += int(sizes[cell])
        if j + 1 < k2:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return cells


@dataclass
class MultiIndex:
    """``entries``: (id, v, i, cell); ``first``/``second``: the codebooks; ``sizes``: entries per cell; ``share``: the part of
    all entries a query visits."""
    entries: DataFrame
    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.first.shape[1]


def calibrate(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float, probes: int, seed: int = 5) -> float:
    """Share of the entries after which the sample's own queries have met ``recall`` of their k true neighbours."""
    h = c1.shape[1]
    cell = squared(x[:, :h], c1).argmin(1) * len(c2) + squared(x[:, h:], c2).argmin(1)
    sizes = np.bincount(cell, minlength=len(c1) * len(c2))
    need: list[np.ndarray] = []
    for q in np.random.default_rng(seed).choice(len(x), min(probes, len(x)), replace=False):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[:min(k, len(x) - 1)]
        order = (squared(x[q:q + 1, :h], c1)[0][:, None] + squared(x[q:q + 1, h:], c2)[0][None, :]).ravel().argsort(kind="stable")
        reach = np.empty(len(sizes))
        reach[order] = np.cumsum(sizes[order])
        need.append(reach[cell[true]] / len(x))
    return float(np.quantile(np.concatenate(need), recall)) if need and len(need[0]) else 1.0


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 10_000, per_cell: int = 50,
          max_centroids: int = 256, k: int = 10, recall: float = 0.97, probes: int = 200) -> MultiIndex | None:
    """Fits the codebooks on at most ``sample_rows`` vectors and indexes all. None if no vector can take part."""
    fine = usable(vectors, key, vector)
    lengths = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return None
    dim, n = lengths[0]["d"], lengths[0]["n"]
    fine = fine.filter(F.size("v") == dim).distinct()
    rows = fine.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    x = np.array([r["v"] for r in rows])
    half = max(1, dim // 2)
    x2 = x[:, half:] if dim > 1 else np.zeros((len(x), 1))
    kc = int(min(max_centroids, max(2, round(math.sqrt(n / per_cell)))))
    c1, c2 = codebook(x[:, :half], kc), codebook(x2, kc)
    share = calibrate(x if dim > 1 else np.concatenate([x, x2], axis=1), c1, c2, k, recall, probes)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
                w = v[:, half:] if dim > 1 else np.zeros((len(v), 1))
                i, j = squared(v[:, :half], c1).argmin(1), squared(w, c2).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array((i * len(c2) + j).astype(np.int32))], ["id", "v", "i", "cell"])
    kind = fine.schema["id"].dataType.simpleString()
    entries = materialise(fine.mapInArrow(assign, f"id {kind}, v array<double>, i int, cell int"))
    sizes = np.zeros(len(c1) * len(c2), np.int64)
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    return MultiIndex(entries, c1, c2, sizes, share)


def search(index: MultiIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score, query_vec): the k nearest found of each distinct query (columns id, v of ``queries``),
    the query's own id left out. A query is known by its id and ``query_vec``, the hash of its vector."""
    queries = queries.select("id", "v", F.xxhash64("v").alias("vec")).distinct()
    c1, c2, sizes, half = index.first, index.second, index.sizes, index.half
    k2, total = len(c2), int(sizes.sum())
    wanted = min(total, max(int(math.ceil(index.share * total)), 4 * k) + 1)
    row_size = sizes.reshape(len(c1), k2).sum(1)
    entry_blocks = np.maximum(1, -(-row_size // ENTRY_BLOCK))
    kind = index.entries.schema["id"].dataType.simpleString()
    n_query = queries.count()
    query_blocks = max(1, -(-n_query // QUERY_BLOCK))

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            w = v[:, half:] if v.shape[1] > 1 else np.zeros((len(v), 1))
            d1, d2 = squared(v[:, :half], c1), squared(w, c2)
            take, grp, mask = [], [], []
            for q in range(len(v)):
                cells = np.array(walk(d1[q], d2[q], sizes, wanted))
                row = cells // k2
                for i in np.unique(row):
                    m = np.zeros(k2, dtype=bool)
                    m[cells[row == i] % k2] = True
                    raw = np.packbits(m).tobytes()
                    for e in range(int(entry_blocks[i])):
                        take.append(q)
                        grp.append((int(i) << 24) | e)
                        mask.append(raw)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(take, pa.int64())) for c in b.columns],
                                              pa.array(grp, pa.int64()), pa.array(mask, pa.binary())], ["id", "v", "vec", "grp", "mask"])
    qb = F.pmod(F.xxhash64("id", "vec"), F.lit(query_blocks)).cast("int")
    left = queries.mapInArrow(visits, f"id {kind}, v array<double>, vec long, grp long, mask binary").withColumn("qb", qb)
    blocks_of = F.array(*[F.lit(int(x)) for x in entry_blocks])
    salt = F.pmod(F.xxhash64("id", "v"), F.element_at(blocks_of, F.col("i") + 1))
    right = index.entries.select("id", "v", "cell", (F.shiftleft(F.col("i").cast("long"), 24) + salt).alias("grp"),
                                 F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def rerank(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "query_vec": [], "vec_id": [], "score": []})
        if not len(a) or not len(e):
            return empty
        e = e.sort_values("id", kind="stable")
        ids, v, cell = e["id"].to_numpy(), np.vstack(e["v"].to_numpy()), e["cell"].to_numpy() % k2
        norm = (v * v).sum(1)
        q, h, c, s = [], [], [], []
        for qid, vec, qv, raw in zip(a["id"], a["vec"], a["v"], a["mask"]):
            seen = np.unpackbits(np.frombuffer(raw, np.uint8), count=k2).astype(bool)[cell] & (ids != qid)
            at = np.flatnonzero(seen)
            if not len(at):
                continue
            qv = np.asarray(qv)
            rough = norm[at] - 2 * (v[at] @ qv) + qv @ qv
            if len(at) > k:  # all that rounding could bring into the first k
                limit = np.partition(rough, k - 1)[k - 1]
                at = at[rough <= limit + 1e-9 * (1.0 + abs(limit) + qv @ qv + norm.max())]
            exact = np.sqrt(((v[at] - qv) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))[:k]
            q += [qid] * len(best)
            h += [vec] * len(best)
            c += ids[at][best].tolist()
            s += exact[best].tolist()
        return pd.DataFrame({"query_id": q, "query_vec": h, "vec_id": c, "score": s}) if q else empty
    found = left.groupBy("grp", "qb").cogroup(right.groupBy("grp", "qb")).applyInPandas(rerank, f"query_id {kind}, query_vec long, vec_id {kind}, score double")
    order = Window.partitionBy("query_id", "query_vec").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_vec")


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, **how) -> DataFrame:
    """The k nearest rows of each row that ``is_query`` (a Column over ``id``) selects."""
    index = build(vectors, key, vector, k=k, **how)
    if index is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double, query_vec long")
    return search(index, index.entries.filter(is_query), k)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
