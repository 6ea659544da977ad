"""Language-model scoring with Elias-Fano n-gram tries.

The model is a smoothed bigram model over lower-cased words and an end token. With c the learned counts,

    p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),   p(w | v) = (c(v, w) + mu * p1(w)) / (c(v) + mu),

so the log probability of a text is a sum of a term for each (v, w), which needs the counts of w and of the pair, and a
term for each word as a context, which needs its own count. All are known where w is, so the corpus is dealt by w: a shard
holds the pairs of its words from every document, counts what may be learned from, encodes the trie of its words, looks up
every pair of every document in it, and returns sums per document. A word with a large share of all tokens is dealt by
(v, w); its count is known from the first pass. Nothing but totals and the few such words reaches the driver.

1. Vocabulary pass: distinct words of each block with learned counts, dealt by word: N, V and the frequent words.
2. Scoring pass: each block's distinct (w, v, document) packed by shard; shards return sums per block; blocks add them up.

A block is a run of documents of one input partition, so a rerun task makes the same blocks.

Edge cases: NULL and empty texts are one end token; repeated rows are scored and learned each for itself; nothing to learn
from leaves N = V = 0 and the smoothed unigram; words are told apart by 64-bit hashes; other columns are ignored.
"""
from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide.llm.common import held_out, mix64, shuffle_parts, table, texts
from plaintide.llm.eliasfano import Trie

BLOCK_TOKENS = 2_000_000
SHARD_TOKENS = 2_000_000
LOOKUPS = 1 << 17  # pairs looked up at once
BLOCK_DOCS = 1 << 19
END, BOS = np.uint64(0x5AFE), np.uint64(0xB05)  # hashes of the two marks
SCALE, SHIFT = 2048, 12.0  # a code is round((log10 + SHIFT) * SCALE)


@dataclass
class Block:
    number: int
    ids: pa.Array
    held: np.ndarray  # documents are renumbered: held-out ones first
    rank: np.ndarray
    size: np.ndarray
    token: np.ndarray
    hashes: np.ndarray


def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of (id, body, held) rows. Token 0 is the end, 1 the mark before a text."""
    task = TaskContext.get().partitionId()
    number = 0
    ids: list[pa.Array] = []
    held: list[bool] = []
    size: list[int] = []
    token: list[np.ndarray] = []
    vocabulary: dict[bytes, int] = {}
    n = 0

    def close() -> Block:
        nonlocal number, n
        h = np.array(held)
        rank = np.empty(len(h), np.int64)
        rank[np.argsort(~h, kind="stable")] = np.arange(len(h))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in vocabulary), np.uint64, len(vocabulary))
        b = Block((task << 24) | number, pa.concat_arrays(ids), h, rank, np.array(size, np.int64), np.concatenate(token), np.concatenate([[END, BOS], hashes]))
        number, n = number + 1, 0
        for x in (ids, held, size, token, vocabulary):
            x.clear()
        return b
    for batch in it:
        body, hold = batch.column("body"), batch.column("held").to_pylist()
        for i in range(batch.num_rows):
            words = body[i].as_py().lower().split()
            put = vocabulary.setdefault
            token.append(np.array([put(w, len(vocabulary) + 2) for w in words] + [0], dtype=np.int32))
            ids.append(batch.column("id").slice(i, 1))
            held.append(hold[i])
            size.append(len(words) + 1)
            n += len(words) + 1
            if n >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                yield close()
    if held:
        yield close()


def narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in the least width that holds them all."""
    top = int(x.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    raw = x.astype(kind).tobytes()
    return struct.pack("<IB", len(x), np.dtype(kind).itemsize) + raw


def widen(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", raw, at)
    return np.frombuffer(raw, f"<u{width}", n, at + 5), at + 5 + n * width


def vocabulary(docs: DataFrame, n_shards: int, per_shard: int = 16) -> tuple[int, int, dict[int, int]]:
    """(N, V, frequent words): all learned tokens, distinct ones, and the counts of each shard's most frequent words."""
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(it):
            learned = np.bincount(b.token, np.repeat(~b.held, b.size), len(b.hashes)).astype(np.int64)
            some = np.flatnonzero(learned)
            shard = (mix64(b.hashes[some]) % np.uint64(n_shards)).astype(np.int64)
            order = np.lexsort((b.hashes[some], shard))
            cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
            rows = [(s, narrow(b.hashes[some[order[x:y]]]) + narrow(learned[some[order[x:y]]])) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "raw"])

    def add(t: pa.Table) -> pa.Table:
        word, count = [], []
        for raw in t.column("raw").to_pylist():
            w, at = widen(raw, 0)
            word.append(w.astype(np.uint64))
            count.append(widen(raw, at)[0].astype(np.int64))
        kinds, back = np.unique(np.concatenate(word), return_inverse=True)
        total = np.bincount(back, np.concatenate(count)).astype(np.int64)
        top = np.argsort(-total, kind="stable")[:per_shard]
        return pa.table({"n": pa.array([int(total.sum())]), "v": pa.array([len(kinds)], pa.int64()),
                         "words": pa.array([kinds[top].view(np.int64).tolist()], pa.list_(pa.int64())), "counts": pa.array([total[top].tolist()], pa.list_(pa.int64()))})
    rows = docs.mapInArrow(send, "shard long, raw binary").groupBy("shard").applyInArrow(add, "n long, v long, words array<long>, counts array<long>").collect()
    frequent = {int(np.int64(w).view(np.uint64)): c for r in rows for w, c in zip(r["words"], r["counts"])}
    return sum(r["n"] for r in rows), sum(r["v"] for r in rows), frequent


def score_texts(documents: DataFrame, key: str = "doc_id", body: str = "text", modulus: int = 5, rest: int = 1, mu: float = 500.0) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 probabilities."""
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    docs = texts(documents, key, body, held_out(key, modulus, rest).alias("held"))
    total, distinct, frequent = vocabulary(docs, shuffle_parts(spark))
    n_shards = max(1, -(-total // SHARD_TOKENS))
    frequent = {w: c for w, c in frequent.items() if c * 4 * n_shards >= total}  # at most 4 words a shard
    hot = np.array(sorted(frequent), dtype=np.uint64)
    hot_count = np.array([frequent[int(w)] for w in hot], dtype=np.int64)
    norm = total + 0.5 * (distinct + 1)
    # The mark before a text is followed once by each learned text.
    start_cost = float(np.log10(docs.filter("NOT held").count() + mu))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(it):
            before = np.empty_like(b.token)
            before[1:] = b.token[:-1]
            before[np.cumsum(b.size) - b.size] = 1
            doc = np.repeat(b.rank, b.size)
            if len(b.hashes) < 1 << 22 and len(b.held) < 1 << 20:
                packed = np.sort((b.token.astype(np.uint64) << np.uint64(42)) | (before.astype(np.uint64) << np.uint64(20)) | doc.astype(np.uint64))
                first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
                packed = packed[first]
                w, v, d = (((packed >> np.uint64(k)) & np.uint64((1 << m) - 1)).astype(np.int32) for k, m in ((42, 22), (20, 22), (0, 20)))
                del packed
            else:
                order = np.lexsort((doc, before, b.token))
                w, v, d = b.token[order], before[order], doc[order].astype(np.int32)
                first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1])]))
                w, v, d = w[first], v[first], d[first]
            del before, doc
            times = np.diff(np.append(first, len(b.token))).astype(np.int32)
            start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
            width = np.diff(np.append(start, len(w)))
            pw, pv = w[start], v[start]
            del w, v, first
            mixed = mix64(b.hashes)
            split = np.isin(b.hashes, hot)
            to = np.where(split[pw], mix64(mixed[pw] ^ b.hashes[pv]), mixed[pw]) % np.uint64(n_shards)
            order = np.lexsort((pw, to))
            to, pw, pv, width, start = to[order].astype(np.int64), pw[order], pv[order], width[order], start[order]
            at = np.concatenate([[0], np.cumsum(width)])
            take = np.repeat(start - at[:-1], width) + np.arange(at[-1])
            d, times = d[take], times[take]
            del take
            shards, cut = np.unique(to, return_index=True)
            cut = np.append(cut, len(to))
            raws = []
            for x, y in zip(cut[:-1], cut[1:]):
                new = np.flatnonzero(np.concatenate([[True], pw[x + 1:y] != pw[x:y - 1]]))
                hv = b.hashes[pv[x:y]]
                raws.append(narrow(b.hashes[pw[x:y][new]]) + narrow(np.diff(np.append(new, y - x))) + narrow(hv & np.uint64(0xFFFFFFFF))
                            + narrow((hv >> np.uint64(32)) & np.uint64(0xFFFF)) + narrow(width[x:y]) + narrow(d[at[x]:at[y]]) + narrow(times[at[x]:at[y]]))
            k = len(raws)
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(shards.tolist() + [b.number % n_shards], pa.int64()), pa.array([b.number] * (k + 1), pa.int64()),
                pa.array([int(b.held.sum())] * (k + 1), pa.int64()), pa.concat_arrays([pa.array(raws, pa.binary()), none]),
                pa.concat_arrays([pa.nulls(k, pa.list_(b.ids.type)), pa.ListArray.from_arrays([0, len(b.ids)], b.ids)]),
                pa.array([None] * k + [narrow(b.rank) + narrow(b.size)], pa.binary())], ["shard", "block", "n_held", "raw", "ids", "sizes"])

    def shard(t: pa.Table) -> pa.Table:
        raws = t.column("raw").to_pylist()
        number, n_held = t.column("block").to_pylist(), t.column("n_held").to_pylist()
        W, V, width, counted, held = [], [], [], [], []
        where = [i for i, r in enumerate(raws) if r is not None]
        for i in where:
            raw, parts, at = raws[i], [], 0
            for _ in range(7):
                x, at = widen(raw, at)
                parts.append(x)
            w, per, low, high, wd, d, n = parts
            W.append(np.repeat(w.astype(np.uint64), per))
            V.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
            first = np.cumsum(wd, dtype=np.int64) - wd
            width.append(wd)
            counted.append(np.add.reduceat(np.where(d >= n_held[i], n, 0).astype(np.int64), first))
            held.append((d, n))  # views of the blob, in its own width
        out_block, out_raw = [], []
        if where:
            cat = np.concatenate
            uw, wi = np.unique(cat(W), return_inverse=True)
            uv, vi = np.unique(cat(V), return_inverse=True)
            del W, V
            pairs, pi = np.unique((wi.astype(np.uint64) << np.uint64(32)) | vi.astype(np.uint64), return_inverse=True)
            del wi, vi
            c_pair = np.bincount(pi, cat(counted), len(pairs))
            pw, pv = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            c_word = np.bincount(pw, c_pair, len(uw))
            at = np.searchsorted(hot, uw)
            is_hot = (at < len(hot)) & (np.append(hot, 0)[np.minimum(at, len(hot))] == uw)
            c_word[is_hot] = hot_count[at[is_hot]]
            # The trie of what was learned here, and every pair looked up in it.
            p1 = (c_word + 0.5) / norm
            code = lambda x: np.clip(np.rint((np.log10(x) + SHIFT) * SCALE), 0, 65_535).astype(np.int64)
            known_word, known_pair = np.flatnonzero(c_word > 0), np.flatnonzero(c_pair > 0)
            node = np.cumsum(c_word > 0) - 1
            trie = Trie(Trie.encode(uw[known_word], code(mu * p1[known_word]), uv, node[pw[known_pair]], pv[known_pair],
                                    code(c_pair[known_pair] + mu * p1[pw[known_pair]])))
            value = np.full(len(pairs), int(code(np.array([mu * 0.5 / norm]))[0]))
            for lo in range(0, len(pairs), LOOKUPS):
                part = slice(lo, lo + LOOKUPS)
                n1, n2 = trie.lookup(uw[pw[part]], uv[pv[part]])
                some = value[part]
                some[n1 >= 0] = trie.word_code[n1[n1 >= 0]]
                some[n2 >= 0] = trie.child_code[n2[n2 >= 0]]
            as_context = np.where(uw == END, int(SHIFT * SCALE), np.rint((np.log10(c_word + mu) + SHIFT) * SCALE)).astype(np.int64)
            value = value - as_context[pw]
            base, known = np.log10(c_word + 0.5)[pw], (c_word > 0)[pw]
            at = 0
            for i, wd, (d, m) in zip(where, width, held):
                e = np.repeat(pi[at:at + len(wd)], wd)
                at += len(wd)
                size = int(d.max()) + 1
                q = np.bincount(d, value[e] * m, size).astype("<i8")  # a term is above 2^13: 32 bits end at some 10^5 tokens
                part = np.bincount(d, base[e] * m, size).astype("<f8")
                g = np.bincount(d, known[e] * m, size).astype(np.int64)
                out_block.append(number[i])
                out_raw.append(struct.pack("<I", size) + q.tobytes() + part.tobytes() + narrow(g))
        heads = [i for i, r in enumerate(raws) if r is None]
        head_col = t.column("ids").combine_chunks()
        ids = pa.concat_arrays([pa.nulls(len(out_block), head_col.type), head_col.take(pa.array(heads, pa.int64()))])
        return pa.table({"block": pa.array(out_block + [number[i] for i in heads], pa.int64()), "raw": pa.array(out_raw + [None] * len(heads), pa.binary()),
                         "n_held": pa.array([0] * len(out_block) + [n_held[i] for i in heads], pa.int64()), "ids": ids,
                         "sizes": pa.concat_arrays([pa.nulls(len(out_block), pa.binary()), t.column("sizes").combine_chunks().take(pa.array(heads, pa.int64()))])})

    def together(t: pa.Table) -> pa.Table:
        raws = t.column("raw").to_pylist()
        head = next(i for i, r in enumerate(raws) if r is None)
        rank, at = widen(t.column("sizes")[head].as_py(), 0)
        size, _ = widen(t.column("sizes")[head].as_py(), at)
        n, size = len(size), size.astype(np.int64)
        q, s, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        for raw in raws:
            if raw is not None:
                (m,) = struct.unpack_from("<I", raw)
                q[:m] += np.frombuffer(raw, "<i8", m, 4)
                s[:m] += np.frombuffer(raw, "<f8", m, 4 + 8 * m)
                known[:m] += widen(raw, 4 + 16 * m)[0].astype(np.int64)
        r = rank.astype(np.int64)
        ids = t.column("ids").combine_chunks()[head].values
        return pa.table({"id": ids, "held_out": pa.array(r < t.column("n_held")[head].as_py()), "n_tokens": pa.array(size),
                         "n_known": pa.array(known[r]), "train_tokens": pa.array(np.full(n, total, np.int64)),
                         "base_score": pa.array(s[r] - size * np.log10(norm)), "score": pa.array(q[r] / SCALE - start_cost)})
    return (docs.mapInArrow(deal, f"shard long, block long, n_held long, raw binary, ids array<{kind}>, sizes binary").groupBy("shard")
            .applyInArrow(shard, f"block long, raw binary, n_held long, ids array<{kind}>, sizes binary").groupBy("block")
            .applyInArrow(together, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("id", key))


def op2_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score_texts(table(spark, sf_dir, "documents"))
