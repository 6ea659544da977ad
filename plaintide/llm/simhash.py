"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within radius R share a point within R / 2 of both. So every fingerprint stands for all its
variants with at most R / 2 flipped bits, variants meet, and fingerprints that meet on one are linked. Variants
are not shuffled one by one: a variant belongs to the slice named by its leading bits, a fingerprint is sent once
to each slice that any of its variants can reach, and the variants of a slice are made and sorted in its group.
That is the same set of meetings at about a twentieth of the shuffled bytes. A slice that is still too large is cut
by further leading bits inside the task, so memory is bounded. All fingerprints on one variant are within R of each
other, so neighbours in the sorted run link them all; a slice returns a spanning forest, never its pairs.

Edge cases: NULL and empty texts have fingerprint zero and are linked like any other; equal texts share one
fingerprint and enter the search once; NULL ids take part and never name a component unless alone; other columns
are ignored.
"""
from __future__ import annotations

import math
from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide.llm.common import arrow_map, table, texts
from plaintide.operators.similarity import connected_components
from plaintide.session import materialise

MAX_VARIANTS = 4_000_000  # made at once in one task
CHUNK = 1 << 16


def shingle_hashes(body: bytes, size: int, seed: int) -> list[int]:
    words = body.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, seed)]
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(length + 1) - 1
    return [digest(joined[s:e], seed) for s, e in zip((end - length).tolist(), end[size - 1:].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit word for each run of ``counts`` hashes: a bit is set if it is set in over half of the run.

    Bits are unpacked to one byte each and summed eight bytes to a word, in pieces of at most 255 rows so that no
    byte overflows."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    n = counts[some]
    start = np.cumsum(n) - n
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(start, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    part = np.add.reduceat(bits, at, axis=0).view(np.uint8).astype(np.int64)
    total = np.add.reduceat(part, first, axis=0)
    out[some] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", body: str = "text", shingle: int = 4, seed: int = 42, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, more..., fp): the 64-bit fingerprint of each whole text as a signed long; ``more``: columns to carry along."""
    kept = [f"id {df.schema[key].dataType.simpleString()}"] + [f"{c} {df.schema[c].dataType.simpleString()}" for c in more]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        done, hashes, counts = [], [], []

        def flush() -> None:
            done.append(majority_bits(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)))
            hashes.clear()
            counts.clear()
        for x in b.column("body"):
            h = shingle_hashes(x.as_py(), shingle, seed)
            hashes += h
            counts.append(len(h))
            if len(hashes) >= CHUNK:
                flush()
        flush()
        return pa.RecordBatch.from_arrays([*b.drop_columns("body").columns, pa.array(np.concatenate(done).view(np.int64))], ["id", *more, "fp"])
    return arrow_map(texts(df, key, body, *map(F.col, more)), work, ", ".join([*kept, "fp long"]))


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For r = 0..most: all masks with at most r of the low ``bits`` bits set."""
    masks = [[0]]
    for r in range(1, most + 1):
        masks.append(masks[-1] + [sum(1 << b for b in c) for c in combinations(range(bits), r)])
    return [np.array(m, dtype=np.uint64) for m in masks]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each element's component under the links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _meetings(fps: np.ndarray, used: np.ndarray, prefix_bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that meet on a variant of this slice; ``used``: flips already spent on the prefix."""
    rest = 64 - prefix_bits
    masks = flips(rest, half)
    cost = sum(int((used == a).sum()) * len(masks[half - a]) for a in range(half + 1))
    if cost > MAX_VARIANTS and rest > 6:
        step = min(6, rest - 1)
        own = ((fps >> np.uint64(rest - step)) & np.uint64((1 << step) - 1)).astype(np.uint64)
        for q in range(1 << step):
            a = used + np.bitwise_count(own ^ np.uint64(q))
            at = np.flatnonzero(a <= half)
            if len(at) > 1:
                for i, j in _meetings(fps[at], a[at], prefix_bits + step, half):
                    yield at[i], at[j]
        return
    low = fps & np.uint64((1 << rest) - 1)
    value, index = [], []
    for a in range(half + 1):
        at = np.flatnonzero(used == a)
        m = masks[half - a]
        value.append((low[at][:, None] ^ m[None, :]).ravel())
        index.append(np.repeat(at, len(m)))
    v, k = np.concatenate(value), np.concatenate(index)
    if len(fps) <= 1 << prefix_bits:  # the index fits beside the variant: one plain sort
        packed = np.sort((v << np.uint64(prefix_bits)) | k.astype(np.uint64))
        v, k = packed >> np.uint64(prefix_bits), (packed & np.uint64((1 << prefix_bits) - 1)).astype(np.int64)
    else:
        order = np.argsort(v, kind="stable")
        v, k = v[order], k[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    if len(same):
        yield k[same], k[same + 1]


def ball_links(fps: DataFrame, radius: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) within ``radius`` bits, at most a spanning
    forest for each slice; their components are those of all links. The slice count follows the number of rows."""
    half = (radius + 1) // 2
    if prefix_bits is None:
        prefix_bits = min(24, max(8, math.ceil(math.log2(max(fps.count(), 1) / 32 + 1))))
    near = flips(prefix_bits, half)[half].astype(np.int64)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            fp = np.concatenate(held).view(np.uint64)
            held.clear()
            out_slice, out_blob = [], []
            for lo in range(0, len(fp), CHUNK):
                part = fp[lo:lo + CHUNK]
                to = ((part >> np.uint64(64 - prefix_bits)).astype(np.int64)[:, None] ^ near[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, ordered = to[order], part[order // len(near)]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                raw, end = ordered.tobytes(), np.append(cut[1:], len(to))
                out_slice.append(to[cut])
                out_blob += [raw[8 * s:8 * e] for s, e in zip(cut.tolist(), end.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_slice)), pa.array(out_blob, pa.binary())], ["slice", "fps"])
        for b in it:
            held.append(b.column("fp").to_numpy())
            if sum(map(len, held)) >= CHUNK:
                yield packed()
        if held:
            yield packed()

    def meet(t: pa.Table) -> pa.Table:
        fp = np.sort(np.frombuffer(b"".join(t.column("fps").to_pylist()), np.uint64))
        own = np.uint64(t.column("slice")[0].as_py())
        used = np.bitwise_count((fp >> np.uint64(64 - prefix_bits)) ^ own).astype(np.int64)
        label = np.arange(len(fp))
        for i, j in _meetings(fp, used, prefix_bits, half):
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius  # verified; always so for an even radius
            pair = np.unique(np.stack([i[ok], j[ok]], axis=1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
            chain = np.concatenate([pair, np.stack([np.arange(len(fp)), label], axis=1)])
            label = _forest(len(fp), chain[:, 0], chain[:, 1])
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[label[at]].view(np.int64)), "b": pa.array(fp[at].view(np.int64))})
    if radius % 2:
        raise ValueError("the radius must be even: then all that meet on a variant are within it")
    return fps.select("fp").mapInArrow(send, "slice long, fps binary").groupBy("slice").applyInArrow(meet, "a long, b long")


def rooted(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, rep, root): each distinct fingerprint, its smallest id and the fingerprint that stands for its component."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    links = ball_links(distinct, radius).distinct()
    comp = connected_components(links).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    return distinct.join(comp, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_groups(df: DataFrame, key: str = "doc_id", body: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(key, fp, component_id) per row: the component's smallest id."""
    fps = materialise(fingerprints(df, key, body, shingle, seed))
    roots = rooted(fps, radius)
    named = roots.join(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", body: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` (all its columns) with exactly one document of each near-duplicate group: the one with the
    smallest id (NULL comes last), then the smallest hash of its text and of its whole row; of equal rows, one. A document
    is its row and not its id, so different texts under one id stay apart. Groups are settled over ids and hashes."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of the input meets one used here
    k, t = f"c{names.index(key)}", f"c{names.index(body)}"
    hashed = [f"c{i}" for i, f in enumerate(docs.schema.fields) if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    marked = plain.withColumn("h", F.xxhash64(F.lit(1), t)).withColumn("row", F.xxhash64(*hashed, *[F.col(c).isNull() for c in hashed]))
    fps = materialise(fingerprints(marked, k, t, shingle, seed, ("h", "row")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "row"))
    of_fp = fps.groupBy("fp").agg(first.alias("least"))
    keep = of_fp.join(rooted(fps, radius), "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.h", "least.row")
    # Equal rows are folded before they are dealt, so that a frequent one is at most one row of each task.
    kept = marked.dropDuplicates(["h", "row"]).join(keep, ["h", "row"], "left_semi")
    return kept.select(*plain.columns).toDF(*names)


def op8_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
