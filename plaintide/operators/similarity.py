"""Hashed text vectors, similar pairs and similarity clusters.

**Pairs** come from an inverted index over the vectors' cells. Cells are ordered by how few vectors have them, and a vector is
listed under its first cells only: as soon as the length of what is left, times the greatest length of any vector, falls
below the threshold, the rest cannot carry a pair. Two vectors that reach the threshold share a listed cell. A list is cut into
blocks, dealt by the nearest of some pivots; two blocks meet in a tile, one group of one Spark stage, unless the triangle
inequality on angles rules them out. A block holds a constant share of the vectors, up to a constant size that a task can hold: a
vector is sent a constant number of times until then. In a tile, products in single precision rule out most pairs, with the
error they can have; the others are judged in double precision. Which blocks meet is a join of block statistics, so that no
list of pairs or tiles exists anywhere. Where the lists together send more vectors to tiles than one list of all vectors would
(vectors with most cells filled), all meet under one list.

**Forests** need no exchange of vectors where lists would send them more than ``LIST_SENDS`` times: each vector is dealt to its block once,
blocks are kept as one row each, and every two of them meet in a Cartesian product, whose tasks read the two rows from where they
are kept. So vectors take the same room on disk however many blocks there are; the angles rule out pairs of blocks as above.

**Clusters.** A tile returns a maximum spanning forest, never its pairs: any dropped edge has a path of at least its own
similarity inside the tile. Borůvka rounds make one forest of all tiles, with fewer edges than vectors and the components of
the full graph at every threshold. Its merge tree over a grid of thresholds comes from dividing the grid: components at the
middle are the nodes of the lower half, edges above the middle the upper half, so all thresholds cost a logarithmic number of
component runs. The tree's cuts give the sizes at every threshold, and the search for a threshold reads nothing else. The forest
starts at the search's own start and is made anew from a lower floor only if the search goes there.
"""
from __future__ import annotations

import hashlib
import math
from functools import reduce, wraps
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from plaintide.functions.common import WS
from plaintide.session import checkpoint_dir, materialise

BLOCKS = 16  # blocks that all vectors make, until a block is as large as it may be
LEAST_ROWS = 512  # rows of a block at least
BLOCK_CELLS = 1 << 21  # cells of a block at most
LIST_SENDS = 2  # exchanges of a vector, up to which forests use lists by cell
PART = 1024  # rows and columns of a tile whose forest is found at once
MAX_PIVOTS = 256
SYMBOLS = 1 << 19  # symbols of texts whose n-grams are counted at once
SPARSE = 8  # candidates for each vector of a part, up to which they are judged one by one
DIGITS = 9  # similarities are rounded to so many decimals before they meet a threshold


def _tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives back what it has freed at its end: processes of Python wait for the next stage with all that they hold."""
    @wraps(work)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(it)
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()
    return run


def hashing_embedding(df: DataFrame, key: str = "doc_id", body: str = "text", dim: int = 256, ngram: int = 3) -> DataFrame:
    """Sparse (key, dim, value): signed counts of hashed character n-grams, scaled to unit length.

    The index is the 128-bit digest modulo the size, the sign is bit 8 of the digest. N-grams are counted as numbers, some texts at a
    time; only counts are dealt and sorted by key, so that the rows of a key follow each other in one task.
    """
    if not 0 < dim < 1 << 31:
        raise ValueError("the size must be positive and below 2^31")
    t = F.regexp_replace(F.lower(F.coalesce(F.col(body), F.lit(""))), WS + "+", "")
    t = F.when(F.length(t) < ngram, F.substring(F.concat(t, F.lit("·" * ngram)), 1, ngram)).otherwise(t)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("key"), t.alias("text"))
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(n, "key")  # a table of a few files is small beside the work on it
    kind = rows.schema["key"].dataType
    key_type = to_arrow_type(kind)
    place_type = np.min_scalar_type(dim - 1)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: dict[str, tuple[int, int]] = {}
        for part in _pieces(it, ngram):
            place, sign, own = _hashed_grams([t for _, t in part], ngram, dim, hashed)
            cells, at = np.unique(own * dim + place, return_inverse=True)
            total = np.bincount(at, sign, len(cells)).astype(np.int64)
            cells, total = cells[total != 0], total[total != 0]
            ends = np.searchsorted(cells, np.arange(len(part) + 1) * dim)
            packed = [_packed((cells[a:b] % dim).astype(place_type), total[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], key_type), pa.array(packed, pa.binary())], ["key", "cells"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells, sums = [], np.zeros(0, np.int64), np.zeros(0)  # the last key so far and its cells
        for batch in it:
            for lo in range(0, batch.num_rows, PART):
                some = batch.slice(lo, PART)
                # Keys by number; the last one of the rows before may go on.
                keys, at, add = list(held), [cells], [sums]
                for k, packed in zip(some.column("key").to_pylist(), some.column("cells").to_pylist()):
                    if not keys or not (k == keys[-1] or (k != k and keys[-1] != keys[-1])):
                        keys.append(k)
                    place, counts = _unpacked(packed, place_type)
                    at.append((len(keys) - 1) * dim + place.astype(np.int64))
                    add.append(counts)
                new, own = np.unique(np.concatenate(at), return_inverse=True)
                total = np.bincount(own, np.concatenate(add), len(new))
                last = int(np.searchsorted(new, (len(keys) - 1) * dim))
                yield _unit_cells(keys, key_type, new[:last], total[:last], dim)
                held, cells, sums = keys[-1:], new[last:] % dim, total[last:]
        if held:
            yield _unit_cells(held, key_type, cells, sums, dim)
    counts = rows.mapInArrow(_tidy(count), StructType([StructField("key", kind), StructField("cells", BinaryType())]))
    dealt = counts.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_tidy(run), StructType([StructField("key", kind), StructField("dim", IntegerType()), StructField("value", DoubleType())])).withColumnRenamed("key", key)


def _packed(place: np.ndarray, counts: np.ndarray) -> bytes:
    """Places and whole counts in as few bytes as the largest of them takes."""
    kind = np.result_type(np.min_scalar_type(-int(np.abs(counts).max(initial=0)) - 1))
    return bytes([kind.itemsize]) + place.tobytes() + counts.astype(kind).tobytes()


def _unpacked(packed: bytes, place_type: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    n = (len(packed) - 1) // (place_type.itemsize + packed[0])
    return np.frombuffer(packed, place_type, n, 1), np.frombuffer(packed, f"i{packed[0]}", n, 1 + n * place_type.itemsize)


def _pieces(it: Iterator[pa.RecordBatch], ngram: int) -> Iterator[list[tuple]]:
    """Lists of (key, text) of at most ``SYMBOLS`` symbols and some. A longer text comes in pieces that share no n-gram and lose none."""
    some, size = [], 0
    for batch in it:
        keys = batch.column("key").to_pylist()
        for k, t in zip(keys, batch.column("text")):
            t = t.as_py()
            for lo in range(0, len(t) - ngram + 1, SYMBOLS):
                some.append((k, t[lo:lo + SYMBOLS + ngram - 1]))
                size += len(some[-1][1])
                if size >= SYMBOLS:
                    yield some
                    some, size = [], 0
    if some:
        yield some


def _hashed_grams(texts: list[str], ngram: int, dim: int, hashed: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, sign, text's number) of every n-gram of the texts. ``hashed`` remembers n-grams."""
    whole = "".join(texts)
    symbol = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts])
    own = np.repeat(np.arange(len(texts)), size)
    start = np.flatnonzero(np.arange(len(symbol)) + ngram <= np.cumsum(size)[own])
    code = symbol[start]
    for k in range(1, ngram):
        if k > 2:  # three symbols fill a word: go on with the number of what was seen so far
            code = np.unique(code, return_inverse=True)[1]
        code = code << 21 | symbol[start + k]
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    got = np.empty((len(first), 2), np.int64)
    for i, p in enumerate(start[first].tolist()):
        g = whole[p:p + ngram]
        if g not in hashed:
            if len(hashed) > 500_000:
                hashed.clear()
            h = int(hashlib.md5(g.encode()).hexdigest(), 16)
            hashed[g] = (h % dim, 1 if h >> 8 & 1 else -1)
        got[i] = hashed[g]
    return got[at, 0], got[at, 1], own[start]


def _unit_cells(keys: list, key_type: pa.DataType, cells: np.ndarray, sums: np.ndarray, dim: int) -> pa.RecordBatch:
    """(key, dim, value) of the cells (number of the key times the size, plus place) that are not zero, at unit length for each key."""
    cells, sums = cells[sums != 0], sums[sums != 0]
    number = cells // dim
    norm = np.sqrt(np.bincount(number, sums * sums, len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type).take(pa.array(number)), pa.array((cells % dim).astype(np.int32)), pa.array(sums / norm[number])], ["key", "dim", "value"])


def dense_vectors(cells: DataFrame, key: str = "doc_id", dim: int = 256) -> DataFrame:
    """(key, vector): one array per key; at most ``dim`` cells are gathered per key. Rows of a key that follow each other are one
    vector before they are dealt by key; a cell that comes twice is an error."""
    rows = cells.select(F.col(key).alias("key"), F.col("dim").cast("int").alias("dim"), F.col("value").cast("float").alias("value"))
    out = StructType([StructField("key", rows.schema["key"].dataType), StructField("vector", ArrayType(FloatType()))])

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            if batch.column("dim").null_count:
                raise ValueError("a cell without a number")
            own, first = _runs(batch.column("key"))
            place, value = batch.column("dim").to_numpy(), batch.column("value").fill_null(0.0).to_numpy(zero_copy_only=False)
            inside = (place >= 0) & (place < dim)
            at = own[inside] * dim + place[inside]
            if len(np.unique(at)) < len(at):
                raise ValueError("a cell comes twice")
            v = np.zeros(len(first) * dim, np.float32)
            v[at] = value[inside]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(first)), _lines(v.reshape(-1, dim))], ["key", "vector"])

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, v = None, np.zeros((0, dim), np.float32)  # the last key and its vector, which may go on
        for batch in it:
            for lo in range(0, batch.num_rows, PART):
                some = batch.slice(lo, PART)
                keys = some.column("key") if key is None else pa.concat_arrays([key, some.column("key")])
                v = np.concatenate([v, some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)])
                _, first = _runs(keys)
                if np.add.reduceat(v != 0, first, dtype=np.int64).max() > 1:
                    raise ValueError("a cell comes twice")
                keys, v = keys.take(pa.array(first)), np.add.reduceat(v, first)
                yield pa.RecordBatch.from_arrays([keys.slice(0, len(first) - 1), _lines(v[:-1])], ["key", "vector"])
                key, v = keys.slice(len(first) - 1), v[-1:]
        if key is not None:
            yield pa.RecordBatch.from_arrays([key, _lines(v)], ["key", "vector"])
    n = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(_tidy(gather), out).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_tidy(fold), out).withColumnRenamed("key", key)


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows' numbers of their runs of equal values, and the first row of each run."""
    code = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()
    begins = np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]])
    return np.cumsum(begins) - 1, np.flatnonzero(begins)


def _lines(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(v.shape[1])), pa.array(v.reshape(-1)))


def representatives(vectors: DataFrame, key: str) -> DataFrame:
    """(rep, id): equal vectors fold into the smallest id, so a mass of copies is one point."""
    digest = F.md5(F.to_json("vector"))
    first = vectors.groupBy(digest.alias("_m")).agg(F.min(key).alias("rep"))
    return vectors.select(F.col(key).alias("id"), digest.alias("_m")).join(first, "_m").select("rep", "id")


def _folded(vectors: DataFrame, key: str) -> DataFrame:
    """(id, rep, vector), kept: ``rep`` is the smallest id with an equal vector, NULL without id or vector; one row of those with the
    same ``rep`` has the vector. Of equal vectors a task sends one with each batch, and ids of the others."""
    if getattr(vectors, "_is_folded", False):
        return vectors
    rows = vectors.select(F.col(key).alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    kind = rows.schema["id"].dataType
    vector = StructField("vector", ArrayType(FloatType()))

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            known, got, first = batch.column("id").is_valid().to_pylist(), [], []
            seen: set[bytes] = set()
            for i, v in enumerate(batch.column("vector")):
                if known[i] and v.is_valid:
                    d = hashlib.blake2b(v.values.to_numpy(zero_copy_only=False).astype(np.float32).tobytes(), digest_size=16).digest()
                    first.append(d not in seen)
                    seen.add(d)
                else:  # fewer bytes: stands for itself
                    d = hashlib.blake2b(str(batch.column("id")[i].as_py() if known[i] else i).encode(), digest_size=8).digest()
                    first.append(False)
                got.append(d)
            bare = pc.if_else(pa.array(first, pa.bool_()), batch.column("vector"), pa.scalar(None, batch.column("vector").type))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.binary()), bare], ["id", "digest", "vector"])

    def reps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rep, there = None, None, False  # the last digest, its least id and whether its vector has come
        for batch in it:
            if not batch.num_rows:
                continue
            digest, ids = batch.column("digest"), batch.column("id")
            own, first = _runs(digest)
            goes_on = digest[0].as_py() == last
            rep_of = ids.take(pa.array(first))
            if goes_on:
                rep_of = pa.concat_arrays([pa.array([rep], ids.type), rep_of.slice(1)])
            full = np.flatnonzero(batch.column("vector").is_valid().to_numpy(zero_copy_only=False))
            run, at = np.unique(own[full], return_index=True)
            if goes_on and there:
                at, run = at[run != 0], run[run != 0]
            keep = np.zeros(batch.num_rows, bool)
            keep[full[at]] = True
            real = pc.equal(pc.binary_length(digest), 16)
            yield pa.RecordBatch.from_arrays([ids, pc.if_else(real, rep_of.take(pa.array(own)), pa.scalar(None, ids.type)), pc.if_else(pa.array(keep), batch.column("vector"), pa.scalar(None, batch.column("vector").type))],
                                             ["id", "rep", "vector"])
            there = bool(own[-1] in run) or (goes_on and there and own[-1] == 0)
            last, rep = digest[-1].as_py(), rep_of[-1].as_py()
    n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = rows.mapInArrow(_tidy(digests), StructType([StructField("id", kind), StructField("digest", BinaryType()), vector]))
    out = materialise(named.repartition(n, "digest").sortWithinPartitions("digest", "id").mapInArrow(_tidy(reps), StructType([StructField("id", kind), StructField("rep", kind), vector])))
    out._is_folded = True
    return out


def _block_rows(n: int, width: int) -> int:
    return max(1, min(max(LEAST_ROWS, -(-n // BLOCKS)), BLOCK_CELLS // max(1, width)))


def _lists(points: DataFrame, threshold: float, block_rows: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, vector, pivot, angle, len, lists): for each vector the numbers of the cells it is listed under, in order; and the pivots.

    The driver sees the cells' counts and at most ``MAX_PIVOTS`` vectors, both bounded by the vectors' size and not by their
    number. A cell that every vector is listed under ends all lists: any two vectors meet there or before. Lists that cost more
    than one list of all vectors give way to it.
    """
    n, longest = points.agg(F.count(F.lit(1)), F.max(F.expr("sqrt(aggregate(vector, 0D, (s, x) -> s + double(x) * x))"))).first()
    cells = points.select(F.posexplode("vector").alias("dim", "value")).filter("value <> 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()
    order = np.array([c["dim"] for c in sorted(cells, key=lambda c: (c["n"], c["dim"]))], np.int64)
    width = _width(points)
    block_rows = block_rows or _block_rows(n, width)
    n_pivots = min(MAX_PIVOTS, max(1, 2 * math.isqrt(n // block_rows)))
    pivots = np.array([r["vector"] for r in points.orderBy(F.md5(F.col("id").cast("string"))).limit(n_pivots).collect()], np.float64).reshape(-1, max(1, width))
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    kind = points.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("vector"))
            length = np.linalg.norm(v, axis=1)
            cos = np.clip(v @ pivots.T / np.maximum(length, 1e-300)[:, None], -1, 1)
            near = cos.argmax(axis=1)
            listed = _listed(v, order, longest, threshold)
            ends = np.concatenate([[0], np.cumsum(listed.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(listed)[1].astype(np.int32)))
            angle = np.arccos(cos[np.arange(len(v)), near])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(near.astype(np.int32)), pa.array(angle), pa.array(length), lists],
                                             ["id", "vector", "pivot", "angle", "len", "lists"])
    placed = materialise(points.mapInArrow(_tidy(run), f"id {kind}, vector array<float>, pivot int, angle double, len double, lists array<int>").filter(F.size("lists") > 0))
    counts = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    n = placed.count()
    sent = lambda k: k * -(-k // block_rows)
    if sum(sent(c["n"]) for c in counts) >= sent(n):
        return placed.withColumn("lists", F.array(F.lit(0))), pivots
    shared = min((c["list"] for c in counts if c["n"] == n), default=None)
    return placed if shared is None else placed.withColumn("lists", F.filter("lists", lambda x: x <= shared)), pivots


def _listed(v: np.ndarray, order: np.ndarray, longest: float, threshold: float) -> np.ndarray:
    """Which cells, in order, a vector is listed under."""
    w = v[:, order]
    left = np.sqrt(np.cumsum(w[:, ::-1] ** 2, axis=1)[:, ::-1])  # length of a cell and all after it
    return (left * longest >= threshold - 1e-9) & (w != 0)


def _width(points: DataFrame) -> int:
    one = points.select(F.size("vector").alias("n")).first()
    return one["n"] if one else 0


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _tiles(points: DataFrame, threshold: float, block_rows: int | None = None):
    """The vectors of two blocks of a list, grouped: each vector goes to every tile of its block. (list, lo, hi) name a tile,
    ``block`` the vector's own side of it."""
    block_rows = block_rows or _block_rows(points.count(), _width(points))
    listed, pv = _lists(points, threshold, block_rows)
    spark = points.sparkSession
    postings = listed.select("*", F.explode("lists").alias("list"))
    groups = materialise(postings.groupBy("list", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.max("len").alias("len")))
    groups = groups.withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int"))
    # At most MAX_PIVOTS^2 rows.
    turn = np.arccos(np.clip(pv @ pv.T, -1, 1))
    turns = spark.createDataFrame([(i, j, float(turn[i, j])) for i in range(len(pv)) for j in range(len(pv))], "pivot int, partner int, turn double")
    other = groups.select("list", F.col("pivot").alias("partner"), F.col("angle").alias("angle2"), F.col("len").alias("len2"), F.col("blocks").alias("blocks2"))
    meets = groups.join(turns, "pivot").join(other, ["list", "partner"])
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(float(threshold)) / F.greatest(F.col("len") * F.col("len2"), F.lit(1e-300)))))
    meets = meets.filter((F.col("pivot") == F.col("partner")) | (F.col("turn") - F.col("angle") - F.col("angle2") <= reach + 1e-9)).select("list", "pivot", "partner", "blocks", "blocks2")
    name = lambda pivot, sub: F.struct(F.col(pivot).alias("pivot"), sub.cast("int").alias("sub"))
    sent = postings.drop("angle", "len").join(meets, ["list", "pivot"])
    sent = sent.withColumn("block", name("pivot", F.pmod(F.xxhash64("id"), F.col("blocks")))).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    sent = sent.withColumn("met", name("partner", F.col("sub")))
    return sent.select("list", F.least("block", "met").alias("lo"), F.greatest("block", "met").alias("hi"), (F.col("block") == F.least("block", "met")).alias("first"),
                       (F.col("block") == F.col("met")).alias("own"), "id", "vector", "lists").groupBy("list", "lo", "hi")


def _sides(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, bool]:
    """The tile's rows by id, their vectors, the places of both sides, and whether they are one block. A tile of one block holds its
    own pairs; a tile of two holds only the pairs between them."""
    t = t.sort_by("id")
    first, own = t.column("first").to_numpy(zero_copy_only=False), bool(t.column("own")[0].as_py())
    every = np.arange(t.num_rows)
    return t, _matrix(t.column("vector")), every if own else np.flatnonzero(first), every if own else np.flatnonzero(~first), own


def _screen(v: np.ndarray, threshold: float) -> tuple[type, float]:
    """The precision of products, and the least product of a pair that may reach the threshold. Products are taken in single precision,
    less the most that these can err; vectors too long for that are multiplied in double precision."""
    longest = float(np.max(np.einsum("ij,ij->i", v, v, dtype=np.float64), initial=0.0))
    # d roundings of products and sums, each by 2^-24 of at most the product of the lengths, and those of the vectors; doubled.
    return (np.float32, threshold - longest * (v.shape[1] + 4) * 2.0 ** -23 - 1e-8) if longest < 1e30 else (np.float64, threshold - 1e-8)


def _near(v: np.ndarray, rows: np.ndarray, cols: np.ndarray, kind: type, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of a part's pairs that may reach the threshold."""
    s = v[rows].astype(kind, copy=False) @ v[cols].astype(kind, copy=False).T
    return np.divmod(np.flatnonzero(s >= least), s.shape[1])


def _split(rows: np.ndarray, cols: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and columns of a tile's parts."""
    for a in range(0, len(rows), PART):
        for b in range(a if own else 0, len(cols), PART):
            yield rows[a:a + PART], cols[b:b + PART]


def _judged(v: np.ndarray, i: np.ndarray, j: np.ndarray, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose rounded similarity reaches the threshold, and the similarity. In a tile of one block a pair counts
    where it stands in order."""
    if own:
        i, j = i[i < j], j[i < j]
    step = max(1, BLOCK_CELLS // max(1, v.shape[1]))
    s = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", v[i[lo:lo + step]].astype(np.float64), v[j[lo:lo + step]].astype(np.float64)) for lo in range(0, len(i), step)]])
    keep = np.flatnonzero(np.round(s, DIGITS, out=s) >= threshold)
    return i[keep], j[keep], s[keep]


def _parts(t: pa.Table, threshold: float) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of a tile the tile's rows by id and the places (i, j) of the pairs that reach the threshold, with their similarity."""
    t, v, rows, cols, own = _sides(t)
    screen = _screen(v, threshold)
    for r, c in _split(rows, cols, own):
        i, j = _near(v, r, c, *screen)
        yield t, *_judged(v, r[i], c[j], own, threshold)


def _candidates(t: pa.Table, threshold: float) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """``_parts`` of a tile in one."""
    got = list(_parts(t, threshold))
    return got[0][0], *[np.concatenate(x) for x in list(zip(*got))[1:]]


def _prim(v: np.ndarray, rows: np.ndarray, cols: np.ndarray, own: bool, floor: float) -> list[tuple[int, int, float]]:
    """Edges (i, j, sim) of a maximum spanning forest of the pairs of two sides from ``floor`` up, by Prim's rule on their matrix: a step
    joins one vector and reads one line of the matrix, however many pairs reach the floor."""
    s = v[rows].astype(np.float64) @ v[cols].astype(np.float64).T
    np.round(s, DIGITS, out=s)
    split = 0 if own else len(rows)
    place = rows if own else np.concatenate([rows, cols])
    n = len(place)
    best, near, free = np.full(n, -np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    across, edges, unused = s if own else np.ascontiguousarray(s.T), [], 0
    for _ in range(n):
        x = int(best.argmax())
        if best[x] >= floor:
            edges.append((place[near[x]], place[x], best[x]))
        else:  # nothing reaches what is joined so far: the next tree
            while not free[unused]:
                unused += 1
            x = unused
        free[x], best[x] = False, -np.inf
        if own:
            line, to = s[x], slice(0, n)
        else:
            line, to = (s[x], slice(split, n)) if x < split else (across[x - split], slice(0, split))
        better = np.flatnonzero((line > best[to]) & free[to])
        best[to][better] = line[better]
        near[to][better] = x
    return edges


def _tile_forest(t: pa.Table, floor: float) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The tile's rows by id and the edges (i, j, sim) of a maximum spanning forest of its pairs from ``floor`` up: that of the forests of
    its parts, whose matrices stay in the processor's cache. A part with few pairs gives them all; of one with many Prim's rule makes the
    forest."""
    t, v, rows, cols, own = _sides(t)
    return t, *_forest(v, rows, cols, own, floor)


def _forest(v: np.ndarray, rows: np.ndarray, cols: np.ndarray, own: bool, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (i, j, sim) of a maximum spanning forest of the pairs of two sides from ``floor`` up: that of the forests of its parts,
    whose matrices stay in the processor's cache. A part with few pairs gives them all; of one with many Prim's rule makes the forest,
    and that of the ``SPARSE`` parts after it without a look at their pairs."""
    some, held, dense = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, 0
    screen = _screen(v, floor)

    def forest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, sim = (np.concatenate(x) for x in zip(*some))
        keep = _heaviest(i, j, sim, len(v))
        return i[keep], j[keep], sim[keep]
    for r, c in _split(rows, cols, own):
        got = None
        if dense % (SPARSE + 1) == 0:
            i, j = _near(v, r, c, *screen)
            dense = 0
            if len(i) <= SPARSE * (len(r) + len(c)):
                got = _judged(v, r[i], c[j], own, floor)
        if got is None:
            dense += 1
            edges = _prim(v, r, c, own and r[0] == c[0], floor)
            got = tuple(np.array(x) for x in zip(*edges)) if edges else some[0]
        some.append(got)
        held += len(got[0])
        if held > 8 * len(v) + 100_000:
            some = [forest()]
            held = len(some[0][0])
    return forest()


def _edge_table(ids: pa.Array, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.Table:
    lo, hi = np.minimum(i, j), np.maximum(i, j)  # rows are in the order of ids
    return pa.Table.from_arrays([ids.take(pa.array(lo)), ids.take(pa.array(hi)), pa.array(s.astype(np.float64))], ["a", "b", "sim"])


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "id", block_rows: int | None = None) -> DataFrame:
    """(a, b, sim) of all distinct vectors whose dot product reaches the threshold, a < b; the threshold is positive.
    Copies of a vector are folded first; ``representatives`` names them. A pair is judged under the first cell that both
    are listed under."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    points = _points(vectors, key)
    kind = points.schema["id"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = None
        for t, i, j, s in _parts(pa.Table.from_batches(batches), threshold):
            if lists is None:
                here, lists = t.column("list")[0].as_py(), [frozenset(x) for x in t.column("lists").to_pylist()]
                only = all(len(x) == 1 for x in lists)
            if not only:
                keep = np.array([min(lists[x] & lists[y]) == here for x, y in zip(i.tolist(), j.tolist())], bool)
                i, j, s = i[keep], j[keep], s[keep]
            yield from _edge_table(t.column("id").combine_chunks(), i, j, s).to_batches()
    return _tiles(points, threshold, block_rows).applyInArrow(pairs, f"a {kind}, b {kind}, sim double")


def _points(vectors: DataFrame, key: str) -> DataFrame:
    reps = representatives(vectors, key).select(F.col("rep").alias(key)).distinct()
    return materialise(vectors.join(reps, key, "left_semi").select(F.col(key).alias("id"), F.col("vector").cast("array<float>").alias("vector")))


class _Sets:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _heaviest(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a maximum spanning forest, by Kruskal's rule."""
    order, sets, keep = np.argsort(-s, kind="stable"), _Sets(n), []
    a, b = i[order].tolist(), j[order].tolist()
    for k, x, y in zip(order.tolist(), a, b):
        if sets.join(x, y):
            keep.append(k)
    return np.array(keep, np.int64)


def _numbered(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct ids of edges in order, and the edges' ends as places among them."""
    codes = pa.concat_arrays([t.column("a").combine_chunks(), t.column("b").combine_chunks()]).dictionary_encode()
    order = pc.array_sort_indices(codes.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[codes.indices.to_numpy(zero_copy_only=False)]
    return codes.dictionary.take(pa.array(order)), at[:t.num_rows], at[t.num_rows:]


def _per_partition(edges: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if batches:
            yield from work(pa.Table.from_batches(batches)).to_batches()
    return edges.mapInArrow(_tidy(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields))


def _thinned(edges: DataFrame) -> DataFrame:
    """Each partition's own spanning forest: an edge that closes a cycle in its partition is no edge of the whole forest."""
    def work(t: pa.Table) -> pa.Table:
        ids, i, j = _numbered(t)
        return t.take(pa.array(_heaviest(i, j, t.column("sim").to_numpy(), len(ids))))
    return _per_partition(edges, work)


def _stars(edges: DataFrame) -> DataFrame:
    """(part, a, b) with the components of the edges (part, a, b): each partition's nodes with the least node they reach inside it."""
    def work(t: pa.Table) -> pa.Table:
        ids, i, j = _numbered(t)
        part = t.column("part").to_numpy()
        keys, at = np.unique(np.concatenate([part, part]) * len(ids) + np.concatenate([i, j]), return_inverse=True)
        sets = _Sets(len(keys))
        for x, y in zip(at[:len(i)].tolist(), at[len(i):].tolist()):
            sets.join(x, y)
        least = np.array([sets.find(x) for x in range(len(keys))], np.int64)
        some = np.flatnonzero(least != np.arange(len(keys)))
        name = lambda k: ids.take(pa.array(keys[k] % len(ids)))
        return pa.Table.from_arrays([pa.array(keys[some] // len(ids)), name(some), name(least[some])], ["part", "a", "b"])
    return _per_partition(edges, work)


def components(edges: DataFrame, part: str | None = None) -> DataFrame:
    """(id, component): smallest id of each component of edges (a, b). With ``part``, an integer column, ids of different parts are
    different nodes, and the column is returned too.

    Partitions first shrink to stars; where that leaves more than one partition, the stars are joined by ``connected_components``.
    """
    out = ["part", "id", "component"]
    e = edges.select((F.lit(0) if part is None else F.col(part)).cast("long").alias("part"), "a", "b").filter("a <> b").distinct()
    stars = materialise(_stars(e))
    if stars.rdd.getNumPartitions() > 1:
        node = lambda c: F.struct("part", F.col(c).alias("id"))
        got = connected_components(stars.select(node("a").alias("a"), node("b").alias("b"))).select("id.part", "id.id", F.col("component.id").alias("component"))
    else:
        roots = stars.select("part", "b").distinct()
        got = stars.select("part", F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("part", F.col("b").alias("id"), F.col("b").alias("component")))
    return got.drop("part") if part is None else got.select(*out).withColumnRenamed("part", part)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, sim): a maximum spanning forest of any edges (a, b, sim) with a < b, in Borůvka rounds: every component takes its
    heaviest edge, ties by the ends, until no edge joins two components. No component is gathered anywhere."""
    best = F.max(F.struct("sim", F.col("a").alias("x"), F.col("b").alias("y")))
    e = materialise(_thinned(edges.select("a", "b", "sim").repartition("a")).groupBy("a", "b").agg(F.max("sim").alias("sim")))
    e = materialise(_thinned(e.withColumns({"ca": F.col("a"), "cb": F.col("b")})))
    if e.rdd.getNumPartitions() == 1:
        return e.select("a", "b", "sim")
    taken = []
    while not e.isEmpty():
        ends = e.select(F.col("ca").alias("c"), "a", "b", "sim", "ca", "cb").unionByName(e.select(F.col("cb").alias("c"), "a", "b", "sim", "ca", "cb"))
        heaviest = F.max(F.struct("sim", "a", "b", "ca", "cb")).alias("e")
        chosen = materialise(ends.groupBy("c").agg(heaviest).select("e.*").distinct())
        taken.append(chosen.select("a", "b", "sim"))
        comp = materialise(components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        for side in ("ca", "cb"):
            e = e.join(comp.select(F.col("id").alias(side), F.col("component").alias("_c")), side).drop(side).withColumnRenamed("_c", side)
        # Of several edges between two components only the heaviest can be taken.
        pair = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
        e = materialise(e.filter("ca <> cb").select("a", "b", "sim", *pair).groupBy("ca", "cb").agg(best.alias("e")).select(
            F.col("e.x").alias("a"), F.col("e.y").alias("b"), F.col("e.sim").alias("sim"), "ca", "cb"))
    return reduce(DataFrame.unionByName, taken) if taken else e.select("a", "b", "sim")


def _lists_pay(points: DataFrame, n: int, floor: float, block_rows: int | None = None) -> bool:
    """Whether lists by cell would send vectors to tiles fewer than ``LIST_SENDS`` times each, and less often than one list of all."""
    if not n:
        return False

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                v = _matrix(batch.column("vector"))
                longest = np.linalg.norm(v, axis=1).max()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.shape[1])), pa.array((v != 0).sum(axis=0)), pa.array(np.full(v.shape[1], longest))], ["cell", "n", "longest"])
    got = points.select("vector").mapInArrow(_tidy(cells), "cell long, n long, longest double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).collect()
    order, longest = np.array([c["cell"] for c in sorted(got, key=lambda c: (c["n"], c["cell"]))], np.int64), max((c["longest"] for c in got), default=0.0)

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                some = _listed(_matrix(batch.column("vector")), order, longest, floor)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, some.shape[1])), pa.array(np.concatenate([[some.any(axis=1).sum()], some.sum(axis=0)]))], ["list", "n"])
    counts = {r["list"]: r["n"] for r in points.select("vector").mapInArrow(_tidy(listed), "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()}
    block_rows = block_rows or _block_rows(n, len(order))
    sent = lambda k: k * -(-k // block_rows)
    return sum(sent(k) for c, k in counts.items() if c >= 0) < min(sent(counts.get(-1, 0)), LIST_SENDS * n)


def _blocks(points: DataFrame, n: int, block_rows: int | None = None) -> DataFrame:
    """(block, pivot, angle, len, turns, ids, cells), kept: a block of vectors in each partition, as one row. ``ids`` are in order, ``cells`` are
    the vectors in single precision; ``angle`` is the largest to the block's pivot, ``turns`` are the angles between that pivot and all.

    A block has the vectors nearest to a pivot, or a share of them. The driver sees at most ``MAX_PIVOTS`` vectors and their counts.
    """
    width = max(1, _width(points))
    block_rows = block_rows or _block_rows(n, width)
    n_pivots = min(MAX_PIVOTS, max(1, 2 * math.isqrt(n // block_rows)))
    pivots = np.array([r["vector"] for r in points.orderBy(F.md5(F.col("id").cast("string"))).limit(n_pivots).collect()], np.float64).reshape(-1, width)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def near(batch: pa.RecordBatch) -> np.ndarray:
        return (_matrix(batch.column("vector")) @ pivots.T).argmax(axis=1)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                pivot, n = np.unique(near(batch), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(n)], ["pivot", "n"])
    sizes = np.zeros(max(1, len(pivots)), np.int64)
    for r in points.select("vector").mapInArrow(_tidy(count), "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect():
        sizes[r["pivot"]] = r["n"]
    shares = np.maximum(1, -(-sizes // block_rows))
    ends = np.cumsum(shares)
    kind = points.schema["id"].dataType

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                pivot = near(batch)
                block = ends[pivot] - 1 - batch.column("turn").to_numpy() % shares[pivot]
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), batch.column("id"), batch.column("vector")], ["block", "id", "vector"])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).sort_by("id")
        block, v = t.column("block")[0].as_py(), _matrix(t.column("vector"))
        pivot = int(np.searchsorted(ends, block, side="right"))
        length = np.linalg.norm(v, axis=1)
        angle = np.nanmax(np.arccos(np.clip(v @ pivots[pivot] / np.maximum(length, 1e-300), -1, 1)))
        turns = np.arccos(np.clip(pivots @ pivots[pivot], -1, 1))
        ids = t.column("id").combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pivot], pa.int32()), pa.array([angle]), pa.array([np.nanmax(length)]), pa.array([turns.tolist()], pa.list_(pa.float64())),
                                          pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["block", "pivot", "angle", "len", "turns", "ids", "cells"])
    placed = points.select("id", "vector", F.xxhash64("id").alias("turn")).mapInArrow(_tidy(place), StructType([StructField("block", IntegerType()), StructField("id", kind), StructField("vector", ArrayType(FloatType()))]))
    return materialise(placed.repartitionById(int(ends[-1]), F.col("block")).mapInArrow(_tidy(pack), f"block int, pivot int, angle double, len double, turns array<double>, ids array<{kind.simpleString()}>, cells binary"))


def _block_forests(points: DataFrame, floor: float, block_rows: int | None = None) -> DataFrame:
    """(a, b, sim): maximum spanning forests, from ``floor`` up, of the pairs of every two blocks and of every block."""
    n = points.count()
    kind = points.schema["id"].dataType.simpleString()
    if _lists_pay(points, n, floor, block_rows):
        def tile(t: pa.Table) -> pa.Table:
            t, i, j, s = _tile_forest(t, floor)
            return _edge_table(t.column("id").combine_chunks(), i, j, s)
        return _tiles(materialise(points), floor, block_rows).applyInArrow(tile, f"a {kind}, b {kind}, sim double")
    blocks = _blocks(points, n, block_rows)
    left, right = (blocks.select(*[F.col(c).alias(f"{c}{side}") for c in blocks.columns]) for side in "12")
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(float(floor)) / F.greatest(F.col("len1") * F.col("len2"), F.lit(1e-300)))))
    close = (F.col("pivot1") == F.col("pivot2")) | (F.get("turns1", F.col("pivot2")) - F.col("angle1") - F.col("angle2") <= reach + 1e-9)
    met = left.hint("shuffle_replicate_nl").join(right, (F.col("block1") <= F.col("block2")) & close).select((F.col("block1") == F.col("block2")).alias("own"), "ids1", "cells1", "ids2", "cells2")

    def forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                own = batch.column("own")[k].as_py()
                sides = "1" if own else "12"
                ids = pa.concat_arrays([batch.column(f"ids{x}")[k].values for x in sides])
                v = np.concatenate([np.frombuffer(batch.column(f"cells{x}")[k].as_buffer(), np.float32) for x in sides]).reshape(len(ids), -1)
                order = pc.array_sort_indices(ids)
                rank = np.empty(len(ids), np.int64)
                rank[order.to_numpy()] = np.arange(len(ids))
                split = 0 if own else len(batch.column("ids1")[k])
                i, j, s = _forest(v, np.arange(split or len(ids)), np.arange(split, len(ids)), own, floor)
                yield from _edge_table(ids.take(order), rank[i], rank[j], s).to_batches()
    return met.mapInArrow(_tidy(forest), f"a {kind}, b {kind}, sim double")


def similarity_forest(vectors: DataFrame, floor: float, key: str = "id", block_rows: int | None = None) -> DataFrame:
    """(a, b, sim): fewer edges than vectors, with the components of the full graph at any threshold from ``floor``
    up. Copies hang on their representative with the similarity of the vector to itself, if that reaches the floor."""
    if floor <= 0:
        raise ValueError("the floor must be positive")
    folded = _folded(vectors, key)
    points = folded.filter(F.col("vector").isNotNull()).select(F.col("rep").alias("id"), "vector")
    edges = spanning_forest(_block_forests(points, floor, block_rows))
    own = F.round(F.expr("aggregate(vector, 0D, (s, x) -> s + double(x) * x)"), DIGITS)
    copies = folded.filter(F.col("rep") != F.col("id")).select("rep", "id").join(points.select(F.col("id").alias("rep"), own.alias("sim")), "rep")
    return edges.unionByName(copies.filter(F.col("sim") >= floor).select(F.col("rep").alias("a"), F.col("id").alias("b"), "sim"))


def merge_tree(forest: DataFrame, grid: list[float]) -> DataFrame:
    """(level, child, child_size, parent, size): how the components of a forest merge as the threshold falls along the ascending
    ``grid``. At ``grid[level]`` the children, components of the next higher threshold named by their smallest id, become one
    component ``parent``. A component that does not change has no row, so there are fewer than twice as many rows as ids.

    The grid is halved in step for all parts: a part's edges from its middle up are the upper half over the same nodes; their
    components are the nodes of the lower half, with the sizes of what they hold.
    """
    level = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= F.col("sim"))) - 1
    e = forest.select(F.lit(0).alias("lo"), F.lit(len(grid)).alias("hi"), "a", "b", level.alias("level")).filter("level >= 0")
    e = materialise(e)
    w = materialise(e.select("lo", "a").unionByName(e.select("lo", F.col("b").alias("a"))).distinct().select("lo", F.col("a").alias("node"), F.lit(1).cast("long").alias("w")))

    def joined(edges: DataFrame) -> DataFrame:
        """(lo, node, component) within each part."""
        return materialise(components(edges, "lo").select(F.col("lo").cast("int").alias("lo"), F.col("id").alias("node"), "component"))
    for _ in range(max(0, math.ceil(math.log2(max(1, len(grid)))))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        cut = e.withColumn("mid", mid)
        upper = cut.filter("level >= mid AND hi - lo > 1")
        comp = joined(upper.select("lo", "a", "b"))
        up = upper.select(F.col("mid").alias("lo"), "hi", "a", "b", "level")
        low = cut.filter("level < mid OR hi - lo = 1").select("lo", F.when(F.col("hi") - F.col("lo") > 1, F.col("mid")).otherwise(F.col("hi")).alias("hi"), "a", "b", "level")
        for side in ("a", "b"):
            low = low.join(comp.select("lo", F.col("node").alias(side), "component"), ["lo", side], "left").withColumn(side, F.coalesce("component", side)).drop("component")
        up_w = comp.join(w, ["lo", "node"]).join(upper.select("lo", "mid").distinct(), "lo").select(F.col("mid").alias("lo"), "node", "w")
        low_w = w.join(comp, ["lo", "node"], "left").groupBy("lo", F.coalesce("component", "node").alias("node")).agg(F.sum("w").alias("w"))
        e, w = materialise(up.unionByName(low.select("lo", "hi", "a", "b", "level"))), materialise(low_w.unionByName(up_w))
    merged = joined(e.select("lo", "a", "b")).join(w, ["lo", "node"])
    sizes = merged.groupBy("lo", "component").agg(F.sum("w").alias("size"))
    return merged.join(sizes, ["lo", "component"]).select(F.col("lo").alias("level"), F.col("node").alias("child"), F.col("w").alias("child_size"), F.col("component").alias("parent"), "size")


def tree_cuts(tree: DataFrame, levels: int, min_size: int) -> list[tuple[int, int]]:
    """(components of at least ``min_size``, size of the largest or 0) at each level of the grid: one small aggregate of the tree."""
    merges = tree.groupBy("level", "parent").agg(F.first("size").alias("size"), F.count_if(F.col("child_size") >= min_size).alias("gone"))
    rows = merges.groupBy("level").agg(F.sum((F.col("size") >= min_size).cast("long") - F.col("gone")).alias("n"), F.max("size").alias("largest")).collect()
    by, out, n, largest = {r["level"]: r for r in rows}, [(0, 0)] * levels, 0, 0
    for k in reversed(range(levels)):
        if k in by:
            n, largest = n + by[k]["n"], max(largest, by[k]["largest"])
        out[k] = (n, largest if largest >= min_size else 0)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id of each component, by alternating large-star and small-star steps up to
    the fixed point, whatever number of rounds that takes.

    Every step is one aggregate and one join on the node, so a node with very many neighbours only
    meets a one-row minimum. Lineage is cut by a checkpoint each round.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint(eager=True)
    nodes = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id"))).distinct()
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(m2, "u")
        e = (j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(m2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().checkpoint(eager=True))
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return nodes.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


FLOOR, CEILING = 0.25, 0.95
LOWER = 0.12  # how far below the threshold that is asked for a forest is made anew


def _search(start: float, n: int, cuts: Callable[[float], tuple[int, int]], max_clusters: int, min_size: int, max_frac: float, tries: int) -> tuple[float, str]:
    """The threshold at which the search ends, and why."""
    thr, used, reason = start, start, "rounds"
    for _ in range(tries):
        used = round(thr, 6)
        count, largest = cuts(used)
        before = thr
        if count == 0:
            thr, reason = max(FLOOR, thr - 0.04), "none"
        elif largest > max(int(n * max_frac), min_size * 4):
            thr, reason = min(CEILING, thr + 0.03), "too_large"
        elif count > max_clusters:
            thr, reason = max(start, thr - 0.02), "too_many"
        else:
            return used, "ok"
        if round(thr, 6) == round(before, 6):
            break
    return used, reason


def similarity_clusters(vectors: DataFrame, key: str = "id", min_sim: float = 0.55, max_clusters: int = 15,
                        min_size: int = 3, max_frac: float = 0.35, keep: int | None = None, tries: int = 24, block_rows: int | None = None) -> DataFrame:
    """(id, cluster, size, threshold, reason): components at a threshold that is searched as follows.
    None left: 0.04 lower, not under 0.25. Largest too large: 0.03 higher, not over 0.95. Too many:
    0.02 lower, not under the start. At most ``tries``; the last one stands. ``max_clusters`` steers the search only;
    all clusters of the threshold it ends at are returned, or the ``keep`` largest.

    The search moves in steps of 0.01 from the start and the two limits, so these values are the grid of the merge tree, and
    every try reads one of its cuts. Pairs below the start matter only if no cluster is found there: then the forest and its tree are
    made anew from further down.
    """
    vectors = _folded(vectors, key)
    n, start = vectors.count(), float(min_sim)
    span = [round(x + 0.01 * i, 6) for x in (start, FLOOR, CEILING) for i in range(-100, 101)]
    floor, forest, known = math.inf, None, {}

    def cuts(used: float) -> tuple[int, int]:
        nonlocal floor, forest, known
        if used < floor:
            lowest = min(FLOOR, start)
            floor = used if floor == math.inf else max(lowest, round(used - LOWER, 6))
            forest = materialise(similarity_forest(vectors, floor, key, block_rows))
            grid = sorted({g for g in span if floor <= g <= max(CEILING, round(start, 6))})
            known = dict(zip(grid, tree_cuts(merge_tree(forest, grid), len(grid), min_size)))
        return known[used]
    used, reason = _search(start, n, cuts, max_clusters, min_size, max_frac, tries)
    comp = components(forest.filter(F.col("sim") >= used))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    members = comp.join(sizes, "component")
    if keep is not None:
        top = members.select("component", "size").distinct().orderBy(F.desc("size"), F.asc("component")).limit(keep)
        members = members.drop("size").join(top, "component")
    return members.select(
        "id", F.col("component").alias("cluster"), "size", F.lit(used).alias("threshold"), F.lit(reason).alias("reason"))
