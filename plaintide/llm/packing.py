"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest. The rests' lengths form a histogram of at most
``capacity`` rows, whatever the input size, and that histogram is all that the driver sees. Over it a linear program
chooses how often each pattern (a multiset of lengths that fits a sequence) is used; a knapsack by dynamic
programming prices new patterns from the dual values. The solution is rounded down; what is left of the histogram, at most
a few pieces per pattern, is packed by filling one sequence at a time as far as subset sums allow. Then the r-th rest of each
length, ranked by a hash of its id within buckets, goes to the place that the patterns keep for rank r.

Edge cases: NULL and empty texts are one end token; repeated rows are packed each for itself; an empty table packs
nothing; very long texts become many full sequences; other columns are ignored.
"""
from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass
from functools import cached_property
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaintide.llm.common import kept, release, shuffle_parts, table
from plaintide.session import materialise

CAPACITY = 1024
SPECIAL = "<|endoftext|>"
MAX_REMEMBERED = 400_000  # words whose ids a task remembers


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of whole texts as little-endian 32-bit words.

    The byte-level pre-tokeniser always starts a new token at a space that a non-space follows, so a text is encoded by
    such pieces, and the ids of the first pieces met are remembered. Texts with white space of other shapes at a piece's
    start, or with the special token's text, are encoded in one go. The slower library is only loaded when it is needed.
    """

    def __init__(self, path: str):
        self.path = path
        self.seen: dict[str, bytes] = {}
        self.fast = self._fast(path)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def _fast(self, path: str):
        """The same vocabulary and merges in the quicker of the two libraries, if its file lies beside; checked on first use."""
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def _encode(self, piece: str) -> bytes:
        ids = self.fast.encode_ordinary(piece) if self.fast else self.whole.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = text.split(" ")
        if len(parts) == 1:
            return self._encode(text) if text else b""
        # A piece that is empty or starts with white space would change where its space belongs.
        for p in parts[1:]:
            if not p or p[0].isspace():
                return self._encode(text)
        seen, out = self.seen, []
        out.append(self._encode(parts[0]) if parts[0] else b"")
        for p in parts[1:]:
            got = seen.get(p)
            if got is None:
                got = self._encode(" " + p)
                if len(seen) < MAX_REMEMBERED and len(p) < 64:
                    seen[p] = got
            out.append(got)
        return b"".join(out)


def token_pieces(documents: DataFrame, path: str, capacity: int, key: str = "doc_id", body: str = "text", end_id: int = 0) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids with the end id, cut at every ``capacity``."""
    kind = documents.schema[key].dataType.simpleString()
    thin = documents.select(F.col(key).alias("id"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    end = struct.pack("<I", end_id)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(("bpe", path), lambda: ByteBpe(path))
        for b in it:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("body")):
                raw = bpe.ids(text.as_py()) + end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    part = raw[4 * s:4 * (s + capacity)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                                             ["id", "start", "length", "ids_crc32", "doc_tokens"])
        release()
    return thin.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def _price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded knapsack of the capacity: its value and the count of each length."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        if not k:
            continue
        v = best[c - lengths[:k]] + value[:k]
        j = int(v.argmax())
        if v[j] > best[c - 1]:
            best[c], last[c] = v[j], j
        else:
            best[c], last[c] = best[c - 1], -2
    count, c = np.zeros(len(lengths), dtype=np.int64), capacity
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            count[last[c]] += 1
            c -= int(lengths[last[c]])
    return float(best[capacity]), count


def first_basis(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feasible basis, its inverse and its uses: again and again the fullest pattern of the lengths that are left,
    used (in fractions) until one of them is exhausted. Later patterns lack that length, so the columns are
    triangular in this order and elimination touches only the few lengths of each pattern."""
    m = len(lengths)
    basis, x, left, order = np.zeros((m, m)), np.zeros(m), counts.astype(np.float64), []
    while left.any():
        column = fullest(lengths, np.where(left > 0, capacity // lengths, 0), capacity)
        use = np.where(column > 0, left / np.maximum(column, 1), np.inf)
        i = int(use.argmin())
        basis[:, i], x[i] = column, use[i]
        order.append(i)
        left = left - column * use[i]
        left[i] = 0.0
        left[left < 1e-9 * counts] = 0.0
    for i in np.flatnonzero(basis.diagonal() == 0):  # exhausted together with another length
        basis[i, i] = capacity // lengths[i]
        order.append(int(i))
    inverse = np.eye(m)
    for i in order:
        inverse[i] /= basis[i, i]
        for r in np.flatnonzero(basis[:, i]):
            if r != i:
                inverse[r] -= basis[r, i] * inverse[i]
    return basis, inverse, x


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int, tolerance: float = 1e-3, max_columns: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): least total use of patterns that covers the counts, by the revised simplex method from a full
    basis. A priced pattern enters while it saves more than ``tolerance`` and the sequences are not yet as full as
    that. ``max_columns`` only bounds the refinement: the basis covers all counts at every step."""
    least = float((lengths * counts).sum()) / capacity
    basis, inverse, x = first_basis(lengths, counts, capacity)
    for _ in range(max_columns):
        if x.sum() <= least * (1 + tolerance):
            break
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        value, column = _price(np.maximum(dual, 0.0), lengths, capacity)
        if value <= 1 + tolerance:
            break
        some = np.flatnonzero(column)
        d = (inverse[:, some] * column[some]).sum(axis=1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * d, 0.0)
        x[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
    return basis.T.astype(np.int64), x


@dataclass
class Plan:
    """``places``: (length, first rank, rank count, sequence base, per sequence, offset). The rest of rank r of this length
    goes to sequence base + (r - first) // per, at offset + ((r - first) % per) * length."""
    places: list[tuple[int, int, int, int, int, int]]
    sequences: int


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Places for ``counts[i]`` rests of ``lengths[i]``, all below the capacity."""
    places: list[tuple[int, int, int, int, int, int]] = []
    if not len(lengths):
        return Plan(places, 0)
    patterns, uses = column_generation(lengths, counts, capacity)
    used, base = np.zeros(len(lengths), np.int64), 0

    def lay(column: np.ndarray, times: int) -> None:
        nonlocal base
        offset = 0
        for i in np.flatnonzero(column):
            places.append((int(lengths[i]), int(used[i]), int(column[i]) * times, base, int(column[i]), offset))
            used[i] += int(column[i]) * times
            offset += int(column[i]) * int(lengths[i])
        base += times
    for column, x in zip(patterns, uses):
        fit = (counts - used)[column > 0] // column[column > 0]
        times = int(min(np.floor(x + 1e-6), fit.min() if len(fit) else 0))
        if times > 0:
            lay(column, times)
    # What rounding left: sequences are filled one by one, each with the fullest pattern of what remains.
    left = counts - used
    while left.any():
        column = fullest(lengths, left, capacity)
        lay(column, max(1, int((left[column > 0] // column[column > 0]).min())))
        left = counts - used
    return Plan(places, base)


def fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts, within ``left``, of a pattern that fills the capacity as far as possible; the longest piece is in it."""
    column = np.zeros(len(lengths), np.int64)
    first = int(np.flatnonzero(left)[-1])
    column[first] = 1
    room = capacity - int(lengths[first])
    reach = np.full(room + 1, -1, dtype=np.int64)  # index of the piece that reached this sum
    reach[0] = len(lengths)
    spare = left.copy()
    spare[first] -= 1
    for i in np.flatnonzero(spare)[::-1]:
        size = int(lengths[i])
        for _ in range(min(int(spare[i]), room // size if size else 0)):
            from_ = np.flatnonzero(reach[:room + 1 - size] >= 0)
            new = from_[reach[from_ + size] < 0] + size
            if not len(new):
                break
            reach[new] = i
        if reach[room] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        i = int(reach[at])
        column[i] += 1
        at -= int(lengths[i])
    return column


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    spark = documents.sparkSession
    all_pieces = materialise(token_pieces(documents, path or default_tokenizer(), capacity, key, body))
    rests, full = all_pieces.filter(F.col("length") < capacity), all_pieces.filter(F.col("length") == capacity)
    # Rank within a length, in buckets: a length that most rests share is still ranked in many tasks.
    n_bucket = shuffle_parts(spark)
    rests = rests.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(n_bucket)).cast("int"))
    sizes = materialise(rests.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("length", "bucket").orderBy(F.xxhash64("id"), "id", "ids_crc32")
    ranked = rests.withColumn("r", F.row_number().over(within)).join(sizes.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r") - 1)

    histogram = sizes.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # below ``capacity`` rows
    made = plan(np.array([h["length"] for h in histogram], np.int64), np.array([h["n"] for h in histogram], np.int64), capacity)
    places = spark.createDataFrame(made.places, "length long, first long, ranks long, base long, per long, offset long")
    placed = place(ranked, places)
    numbered = number_full(full, made.sequences)
    cols = [F.col("id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*cols).unionByName(numbered.select(*cols))


def place(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """Each ranked rest at its place: the places of a length, sorted by first rank, are one array, and the last
    whose first rank does not exceed the rest's is its own. The arrays come from the histogram, not from the rows."""
    arrays = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "base", "per", "offset"))).alias("at"))
    joined = ranked.join(F.broadcast(arrays), "length")
    one = F.element_at(F.filter("at", lambda a: a["first"] <= F.col("rank")), -1)
    k = F.col("rank") - F.col("p.first")
    return (joined.withColumn("p", one).withColumn("sequence_id", F.col("p.base") + F.floor(k / F.col("p.per")))
            .withColumn("offset", F.col("p.offset") + F.pmod(k, F.col("p.per")) * F.col("length")))


def number_full(full: DataFrame, first: int) -> DataFrame:
    """Full sequences numbered from ``first``: partition number and row are enough, as numbers need not be dense."""
    return full.withColumn("sequence_id", F.lit(first) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset."""
    return pack(table(spark, sf_dir, "documents"))
