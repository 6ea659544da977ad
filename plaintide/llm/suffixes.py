"""Exact substring dedup: bytes covered by a window (200 bytes) that starts anywhere else as well.

1. Anchors. Every window is filed under its minimiser, the least hashed 64-byte gram inside it. Consecutive windows with
   the same minimiser are one segment, so a text has about one segment for 69 bytes. Equal windows have equal
   minimisers at equal places, so they meet under one anchor, wherever they stand.
2. Segments. An anchor that occurs once has nothing that repeats. Segments with equal bytes are folded and counted;
   their windows all repeat. What is left are segments that differ but share their anchor.
3. Common prefixes. The distinct segments of whole anchors are dealt into collections of bounded size, and each
   collection's Burrows-Wheeler transform and common prefixes are built column by column (``bcr``): the windows with a common prefix of a
   window's length with a neighbour are those that repeat. An anchor with very many different segments is first cut
   into single windows, which are filed under their own bytes.
4. Removal. Each text's repeated windows are joined to spans and cut out.

Windows are judged on the input; nothing is removed before all are known, and none crosses a document.

Edge cases: NULL and empty texts, and texts shorter than a window, lose nothing; repeated rows are documents of their
own and remove each other; texts of any length are worked through in overlapping pieces; other columns are kept by
``without_repeats`` and ignored by ``repeats``.
"""
from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide.llm import bcr
from plaintide.llm.common import mix64, table
from plaintide.session import materialise

WINDOW = 200
GRAM = 64
PIECE = 1 << 19  # window starts worked on at once
DEAL = 8192  # segments in one group, about
COLLECTION = 256  # segments in one transform, about
CROWDED = 8192  # different segments of one anchor from which it is cut into windows
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 64 bytes from each place, by doubling."""
    h = _LETTER[b]
    for level in range(6):
        half = 1 << level
        h = h[:-half] * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + h[half:]
        h ^= h >> np.uint64(29)
    return mix64(h)


def segments(b: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, windows, anchor hash) of each segment. ``starts``: rising places at which a window of one text
    starts; a segment never spans two texts, because its anchor lies inside each of its windows."""
    h = gram_hashes(b)
    wide = window - GRAM + 1
    low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the first place
    n = 1
    while 2 * n <= wide:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if wide > n:
        low = np.minimum(low[:len(low) - (wide - n)], low[wide - n:])
    at = (low[starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    size = np.diff(np.append(first, len(starts)))
    return starts[first], size, h[at[first]]


def _segment_rows(docs: DataFrame, window: int) -> DataFrame:
    """(id, mark, s, n, h, c): each document's segments: first window start, windows, anchor, hash of the bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bodies, out = b.column("body"), []
            held: list[tuple[int, int, bytes]] = []  # (row, place in the text, bytes)
            size = 0

            def flush() -> None:
                buf = b"".join(x for _, _, x in held)
                length = np.array([len(x) for _, _, x in held])
                base = np.cumsum(length) - length
                starts = np.concatenate([np.arange(s, s + n - window + 1) for s, n in zip(base, length)])
                s, n, h = segments(np.frombuffer(buf, np.uint8), starts, window)
                which = np.searchsorted(base, s, side="right") - 1
                digest = xxhash.xxh3_64_intdigest
                c = np.array([digest(buf[x:y]) for x, y in zip(s.tolist(), (s + n + window - 1).tolist())], dtype=np.uint64)
                row, place = np.array([r for r, _, _ in held]), np.array([p for _, p, _ in held])
                out.append((row[which], s - base[which] + place[which], n, h.view(np.int64), c.view(np.int64)))
                held.clear()
            for i in range(b.num_rows):
                x = bodies[i].as_py()
                for p in range(0, len(x) - window + 1, PIECE):
                    part = x[p:p + PIECE + window - 1]
                    if size + len(part) > PIECE + window and held:
                        flush()
                        size = 0
                    held.append((i, p, part))
                    size += len(part)
            if held:
                flush()
            if out:
                row, s, n, h, c = (np.concatenate(z) for z in zip(*out))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("mark").take(take), pa.array(s.astype(np.int64)), pa.array(n.astype(np.int32)),
                                                  pa.array(h), pa.array(c)], ["id", "mark", "s", "n", "h", "c"])
    return docs.mapInArrow(run, f"id {kind}, mark long, s long, n int, h long, c long")


def _bodies(df: DataFrame, key: str, body: str) -> DataFrame:
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    return df.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("body"))


def _cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted segments (id, mark, parts: array of (s, n, h, times)), one row each. A repeated row gives
    its segments again, which changes nothing: they occur more than once as it is."""
    kind = docs.schema["id"].dataType.simpleString()
    same = docs["id"].eqNullSafe(wanted["id"]) & (docs["mark"] == wanted["mark"])
    joined = docs.join(wanted, same).select(docs["id"], docs["mark"], "body", "parts")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, s, h, t, raw = [], [], [], [], []
            for i, (x, parts) in enumerate(zip(b.column("body"), b.column("parts"))):
                x = x.as_py()
                for p in parts.as_py():
                    row.append(i)
                    s.append(p["s"])
                    h.append(p["h"])
                    t.append(p["times"])
                    raw.append(x[p["s"]:p["s"] + p["n"] + window - 1])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("mark").take(take), pa.array(s, pa.int64()), pa.array(h, pa.int64()),
                                              pa.array(t, pa.int64()), pa.array(raw, pa.binary())], ["id", "mark", "s", "h", "times", "raw"])
    return joined.mapInArrow(run, f"id {kind}, mark long, s long, h long, times long, raw binary")


def _single_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(id, mark, s, w): each window of the wanted segments with the hash of its bytes (128 bits as text of bytes)."""
    kind = docs.schema["id"].dataType.simpleString()
    same = docs["id"].eqNullSafe(wanted["id"]) & (docs["mark"] == wanted["mark"])
    joined = docs.join(wanted, same).select(docs["id"], docs["mark"], "body", "s", "n")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, s, w = [], [], []
            for i, (x, p, n) in enumerate(zip(b.column("body"), b.column("s").to_pylist(), b.column("n").to_pylist())):
                x = x.as_py()[p:p + n + window - 1]
                for j in range(n):
                    row.append(i)
                    s.append(p + j)
                    w.append(xxhash.xxh3_128_digest(x[j:j + window]))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("mark").take(take), pa.array(s, pa.int64()), pa.array(w, pa.binary())], ["id", "mark", "s", "w"])
    return joined.mapInArrow(run, f"id {kind}, mark long, s long, w binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _compare(pieces: DataFrame, n_pieces: int, window: int) -> DataFrame:
    """(id, mark, a, b): runs of window starts that repeat, of the segments that occur once. Anchors are dealt whole."""
    kind = pieces.schema["id"].dataType.simpleString()
    n = max(1, -(-n_pieces // DEAL))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        raw, h = t.column("raw").to_pylist(), t.column("h").to_numpy()
        once = np.flatnonzero(t.column("times").to_numpy() == 1)
        new = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
        flags, at = [], 0
        while at < len(h):  # whole anchors, until a collection is full
            stop = int(new[np.searchsorted(new, min(at + COLLECTION, len(h)))])
            flags += bcr.repeated(raw[at:stop], window)
            at = stop
        start = t.column("s").to_numpy()
        row, lo, hi = [], [], []
        for i in once:
            a, b = _runs(flags[i])
            row += [i] * len(a)
            lo += (start[i] + a).tolist()
            hi += (start[i] + b).tolist()
        take = pa.array(row, pa.int64())
        return pa.table({"id": t.column("id").take(take), "mark": t.column("mark").take(take), "a": pa.array(lo, pa.int64()), "b": pa.array(hi, pa.int64())})
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("h"), F.lit(n)))
    return dealt.groupBy("deal").applyInArrow(run, f"id {kind}, mark long, a long, b long")


def repeats(documents: DataFrame, key: str = "doc_id", body: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, mark, runs): for each document with a repeated window, the runs [a, b) of window starts that occur at
    another start as well. ``mark`` is xxhash64 of the text."""
    docs = _bodies(documents, key, body)
    found = materialise(_segment_rows(docs.filter(F.octet_length("body") >= window), window))
    # Written before it is joined: the join then deals both sides itself and a crowded anchor can be split.
    anchors = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), (F.min("c") != F.max("c")).alias("mixed")).filter("times > 1"))
    again = materialise(found.join(anchors.select("h", "mixed"), "h"))
    alike = again.filter("NOT mixed").select("id", "mark", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))

    mixed = again.filter("mixed")
    folded = materialise(mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "mark", "s", "n")).alias("one")))
    crowded = folded.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWDED).select("h", F.lit(True).alias("crowd"))
    several = mixed.join(folded.filter("times > 1").select("h", "c"), ["h", "c"], "left_semi")
    copies = several.select("id", "mark", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))

    ready = materialise(folded.join(crowded, "h", "left").select("h", "times", "one.*", F.coalesce("crowd", F.lit(False)).alias("crowd")))
    plain = ready.filter("NOT crowd")
    lists = plain.groupBy("id", "mark").agg(F.collect_list(F.struct("s", "n", "h", "times")).alias("parts"))
    prefixes = _compare(_cut_out(docs, lists, window), plain.count(), window)
    parts = [alike, copies, prefixes]
    crowd = ready.filter("crowd")
    if not crowd.isEmpty():
        single = materialise(_single_windows(docs, crowd.select("id", "mark", "s", "n"), window))
        counts = single.groupBy("w").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        parts.append(single.join(counts, "w", "left_semi").select("id", "mark", F.col("s").alias("a"), (F.col("s") + 1).alias("b")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def spans(runs: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the windows that start in the runs."""
    out: list[list[int]] = []
    for a, e in sorted((r["a"], r["b"] - 1 + window) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def keep(body: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, e in cut:
        out.append(body[at:a])
        at = e
    return b"".join(out + [body[at:]])


def removal(documents: DataFrame, key: str = "doc_id", body: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    docs, found = _bodies(documents, key, body), repeats(documents, key, body, window)
    kind = documents.schema[key].dataType.simpleString()
    joined = docs.join(found, docs["id"].eqNullSafe(found["id"]) & (docs["mark"] == found["mark"]), "left").select(docs["id"], "body", "runs")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[], [], [], []]
            for x, r in zip(b.column("body"), b.column("runs")):
                x, cut = x.as_py(), spans(r.as_py() or [], window)
                for c, v in zip(cols, (len(x), sum(e - a for a, e in cut), len(cut), hashlib.sha256(keep(x, cut)).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", key)


def without_repeats(documents: DataFrame, key: str = "doc_id", body: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows and columns of ``documents`` with repeated spans cut out of the text; a character that a cut splits goes
    as a whole. ``n_chars``, if present, follows the text."""
    names, found = documents.columns, repeats(documents, key, body, window)
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    k, t = plain[f"c{names.index(key)}"], plain[f"c{names.index(body)}"]
    joined = plain.join(found, k.eqNullSafe(found["id"]) & (F.xxhash64(F.coalesce(t, F.lit(""))) == found["mark"]), "left").select(*plain.columns, "runs")
    at = names.index(body)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = b.column(at).to_pylist()
            for i, r in enumerate(b.column(len(names))):
                if r.is_valid and text[i] is not None:
                    text[i] = keep(text[i].encode(), spans(r.as_py(), window)).decode("utf-8", "ignore")
            cols = b.columns[:-1]
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    got = joined.mapInArrow(run, schema).toDF(*names)
    return got.withColumn("n_chars", F.length(body).cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else got


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document."""
    return removal(table(spark, sf_dir, "documents"))
