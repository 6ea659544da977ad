"""Alignment of two tokenizers by divide and conquer at shared cuts.

The tokens of both tokenizers cover the same bytes, so a byte offset where tokens of both end cuts the text in two parts that
can be aligned apart. An interval is divided at the shared cut nearest to its middle token, found by bisecting the other
tokenizer's ends, and both halves are divided further. An interval without a shared cut inside is a leaf, a group of tokens of
either side that stand for the same bytes. All intervals of a block of documents are divided side by side.

Spark deals documents in blocks of some 300,000 tokens. A block hands on its distinct pairs of linked ids with the number of
its documents that hold each; their corpus counts are an aggregate with a map-side combine, and come back to the blocks
that asked by a join on the pair (frequent pairs by a broadcast of bounded size, see ``look_up``). So what travels grows with
blocks and their distinct pairs, not with tokens; no task sees all pairs and none travels to the driver.
"""
from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintide.llm.common import look_up, table
from plaintide.session import materialise

BLOCK_TOKENS = 300_000
MAX_REMEMBERED = 400_000  # words whose ids a task remembers
CHUNK_CHARS = 500_000  # characters whose new words are encoded together
NEAR = 8  # places on either side of the middle that are probed for all intervals side by side


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: a printable byte is itself, the others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both tokenizers: ids of a text, and the bytes of every id.

    Neither joins a token over a space that a non-space follows, so words are encoded one by one and remembered; texts with
    white space of another shape are encoded in one go.
    """

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.fast = self._fast(byte_level)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        with open(byte_level, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            if all(c in alphabet for c in word):
                self.bytes_a[i] = bytes(alphabet[c] for c in word)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        # Pieces that hold a space behind another character would join words.
        self.by_word = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.seen: dict[str, tuple[bytes, bytes, bool]] = {}
        # How an id is written inside and at the end of its side of a group.
        self.written = [f"{i}{s}" for i in range(self.n_a) for s in ",|"] + [f"{i}{s}" for i in range(self.n_b) for s in ",;"]

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def _fast(self, path: str):
        """The same vocabulary and merges in the quicker of the two libraries, if its file lies beside."""
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        """For a space and each text: the ids of both as bytes, and whether both stand for exactly these bytes."""
        if self.fast:
            all_a = [self.fast.encode_ordinary(" " + t) for t in texts]
        else:
            all_a = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        for t, a, b in zip(texts, all_a, self.b.encode(texts, num_threads=1)):
            want = (" " + t).encode()
            same = b"".join([self.bytes_a[i] for i in a]) == want and b"".join([self.bytes_b[i] for i in b]) == want
            yield struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b), same

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for a space and each text; None for the empty text and where either does not stand for exactly these bytes."""
        lo, out = 0, []
        while lo < len(texts):  # words of some texts at a time: as Python strings they take many times their bytes
            hi, size = lo, 0
            while hi < len(texts) and size < CHUNK_CHARS:
                size, hi = size + len(texts[hi]), hi + 1
            out += self._some(texts[lo:hi])
            lo = hi
        return out

    def _some(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        split = [t.split(" ") if t else [] for t in texts]
        for k, words in enumerate(split):
            if not self.by_word or any([not w or w[0].isspace() for w in words]):
                split[k] = [texts[k]] if texts[k] else []
        seen = self.seen
        new = list({w for words in split for w in words if w not in seen})
        now = dict(zip(new, self._encode(new)))
        out = []
        for t, words in zip(texts, split):
            got = [seen.get(w) or now[w] for w in words]
            if not got or not all([x[2] for x in got]) and (len(got) == 1 or not next(self._encode([t]))[2]):
                out.append(None)
            else:
                out.append(tuple(np.frombuffer(b"".join([x[side] for x in got]), "<u4").astype(np.int64) for side in (0, 1)))
        for w, x in now.items():
            if len(seen) >= MAX_REMEMBERED:
                break
            if len(w) < 64:
                seen[w] = x
        return out


_coders: dict[tuple[str, str], Coders] = {}


def shared_groups(a: np.ndarray, b: np.ndarray, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf intervals (la, ha, lb, hb) in order. ``a`` and ``b`` are the ascending ends of the tokens; the given intervals of
    token numbers, halves open, end at shared cuts."""
    leaves = []
    while len(la):
        one = (ha - la < 2) | (hb - lb < 2)  # no end inside on one side
        leaves.append(np.stack([la, ha, lb, hb])[:, one])
        la, ha, lb, hb = la[~one], ha[~one], lb[~one], hb[~one]
        middle, cut = (la + ha - 2) // 2, np.full(len(la), -1, np.int64)
        for d in range(NEAR + 1):
            for at in (middle + d, middle - d):
                todo = np.flatnonzero((cut < 0) & (at >= la) & (at < ha - 1))
                i = at[todo]
                hit = b[np.searchsorted(b, a[i])] == a[i]
                cut[todo[hit]] = i[hit]
            if (cut >= 0).all():
                break
        for k in np.flatnonzero((cut < 0) & (ha - la > 2 * NEAR + 2)):  # long stretches without a shared cut near the middle
            inside = a[la[k]:ha[k] - 1]
            hits = np.flatnonzero(b[np.searchsorted(b, inside)] == inside)
            if len(hits):
                p = int(np.searchsorted(hits, middle[k] - la[k]))
                near = [int(hits[q]) for q in (p - 1, p) if 0 <= q < len(hits)]
                cut[k] = la[k] + min(near, key=lambda h: abs(h - (middle[k] - la[k])))
        none = cut < 0
        leaves.append(np.stack([la, ha, lb, hb])[:, none])
        la, ha, lb, hb, cut = la[~none], ha[~none], lb[~none], hb[~none], cut[~none]
        other = np.searchsorted(b, a[cut])
        # Halves stay side by side, so that all bisections of a round run through the ends in order.
        la, ha = np.stack([la, cut + 1], 1).ravel(), np.stack([cut + 1, ha], 1).ravel()
        lb, hb = np.stack([lb, other + 1], 1).ravel(), np.stack([other + 1, hb], 1).ravel()
    if not leaves:
        return (np.zeros(0, np.int64),) * 4
    out = np.concatenate(leaves, axis=1)
    return tuple(out[:, np.argsort(out[0])])


@dataclass
class Block:
    """Documents under collection and their tokens."""
    ids: list = field(default_factory=list)
    a: list = field(default_factory=list)
    b: list = field(default_factory=list)
    tokens: int = 0

    def add(self, doc, pair: tuple[np.ndarray, np.ndarray] | None) -> None:
        none = np.zeros(0, np.int64)
        self.ids.append(doc)
        a, b = pair if pair is not None else (none, none)
        self.a.append(a)
        self.b.append(b)
        self.tokens += len(a) + 1


@dataclass
class Aligned:
    """Columns per document, the groups as text, and the block's distinct linked pairs: ``pairs`` ascending, ``held`` the
    documents that hold each, and per document the places of its pairs (``at``) with how often they are linked (``times``)."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    held: np.ndarray
    at: np.ndarray
    times: np.ndarray
    distinct: np.ndarray


def align(coders: Coders, a_docs: list[np.ndarray], b_docs: list[np.ndarray]) -> Aligned:
    """Groups and links of some documents, given their ids. The documents lie end to end, so the end of each is a shared cut."""
    n = len(a_docs)
    n_a, n_b = np.array([len(x) for x in a_docs], np.int64), np.array([len(x) for x in b_docs], np.int64)
    a_ids, b_ids = np.concatenate(a_docs), np.concatenate(b_docs)
    a, b = np.cumsum(coders.len_a[a_ids]), np.cumsum(coders.len_b[b_ids])
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    full = n_a > 0
    la, ha, lb, hb = shared_groups(a, b, (ends_a - n_a)[full], ends_a[full], (ends_b - n_b)[full], ends_b[full])
    doc_of = np.repeat(np.arange(n), n_a)
    n_groups = np.bincount(doc_of[la], minlength=n) if len(la) else np.zeros(n, np.int64)
    # The written groups: each group's ids of one side, then of the other, in one merged sequence over all documents.
    merged = np.zeros(len(a_ids) + len(b_ids), np.int64)
    code_a, code_b = a_ids * 2, 2 * coders.n_a + b_ids * 2
    code_a[ha - 1] += 1
    code_b[hb - 1] += 1
    merged[np.arange(len(a_ids)) + np.repeat(lb, ha - la)] = code_a
    merged[np.arange(len(b_ids)) + np.repeat(ha, hb - lb)] = code_b
    stop, groups = ends_a + ends_b, []
    for lo, hi in zip((stop - n_a - n_b).tolist(), stop.tolist()):
        groups.append("".join([coders.written[k] for k in merged[lo:hi].tolist()])[:-1])
    # Two tokens overlap in exactly one stretch between neighbouring ends of either side.
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    left = np.searchsorted(a, ends)
    pair, doc = a_ids[left] * coders.n_b + b_ids[np.searchsorted(b, ends)], doc_of[left]
    span = coders.n_a * coders.n_b
    key = np.sort(doc * span + pair)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    pairs, at = np.unique(key[new] % span, return_inverse=True)
    return Aligned(n_a, n_b, n_groups, np.bincount(doc, minlength=n), groups, pairs, np.bincount(at, minlength=len(pairs)), at, times,
                   np.bincount(key[new] // span, minlength=n))


def aligned_blocks(documents: DataFrame, byte_level: str, pieces: str, key: str, body: str, block_tokens: int) -> DataFrame:
    """One row per block: its documents with their counts and digests, and its distinct pairs (see ``Aligned``)."""
    thin = documents.select(F.col(key).alias("id"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    kind = thin.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders.get((byte_level, pieces)) or _coders.setdefault((byte_level, pieces), Coders(byte_level, pieces))
        first, count, block, id_type = TaskContext.get().partitionId() << 33, 0, Block(), None

        def done() -> pa.RecordBatch:
            x = align(coders, block.a, block.b)
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups]
            lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (x.n_a, x.n_b, x.n_groups, x.n_links, x.distinct)]
            blobs = [pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in ((x.pairs, "<i8"), (x.held, "<u4"), (x.at, "<u4"), (x.times, "<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([first + count], pa.int64()), pa.array([block.ids], pa.list_(id_type))] + lists + [pa.array([sha])] + blobs,
                                              ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "sha", "pairs", "held", "at", "times"])
        for batch in it:
            id_type = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, pair in zip(part.column("id").to_pylist(), coders.ids(part.column("body").to_pylist())):
                    block.add(doc, pair)
                    if block.tokens >= block_tokens:
                        yield done()
                        block, count = Block(), count + 1
        if block.ids:
            yield done()
    return thin.mapInArrow(run, f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, "
                                "sha array<string>, pairs binary, held binary, at binary, times binary")


def token_groups(documents: DataFrame, byte_level: str | None = None, pieces: str | None = None, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, groups): each document's groups of token ids that stand for the same bytes, written ``a1,a2|b1;a3|b2,b3``; an empty
    text where a document has no tokens (see ``link_counts``)."""
    byte_level, pieces = byte_level or _public("byte_bpe_50k.json"), pieces or _public("piece_bpe_32k.model")
    thin = documents.select(F.col(key).alias("id"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders.get((byte_level, pieces)) or _coders.setdefault((byte_level, pieces), Coders(byte_level, pieces))
        for batch in it:
            groups = [align(coders, [got[0]], [got[1]]).groups[0] if got else "" for got in coders.ids(batch.column("body").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(groups, pa.string())], ["id", "groups"])
    return thin.mapInArrow(run, f"id {thin.schema['id'].dataType.simpleString()}, groups string").withColumnRenamed("id", key)


def pair_counts(asks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best, weight): the documents that hold a pair, whether that is its first id's highest, and the blocks that ask."""
    counts = materialise(asks.groupBy("pair").agg(F.sum("held").alias("n"), F.count(F.lit(1)).alias("weight")).withColumn("a", F.floor(F.col("pair") / F.lit(n_b)).cast("long")))
    tops = materialise(counts.groupBy("a").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("_pairs")))
    total = tops.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    return materialise(look_up(counts, tops, ["a"], "_pairs", total).select("pair", "n", (F.col("n") == F.col("top")).alias("best"), "weight"))


def link_counts(documents: DataFrame, byte_level: str | None = None, pieces: str | None = None, key: str = "doc_id", body: str = "text",
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    A text is read as a space and the text by both tokenizers; special tokens are plain text. NULL and empty texts, and texts
    that a tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest. Every row counts as a document,
    repeated ones and those of NULL keys too. Other columns are ignored; an empty table gives an empty one.
    """
    byte_level, pieces = byte_level or _public("byte_bpe_50k.json"), pieces or _public("piece_bpe_32k.model")
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    kind = documents.schema[key].dataType.simpleString()
    blocks = materialise(aligned_blocks(documents, byte_level, pieces, key, body, block_tokens))

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, p, h in zip(*[batch.column(c).to_pylist() for c in ("block", "pairs", "held")]):
                p, h = np.frombuffer(p, "<i8"), np.frombuffer(h, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block, np.int64)), pa.array(p), pa.array(h)], ["block", "pair", "held"])
    asks = blocks.select("block", "pairs", "held").mapInArrow(ask, "block long, pair long, held long")
    counts = pair_counts(asks, n_b)
    total = counts.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    answers = look_up(asks.drop("held"), counts, ["pair"], "weight", total)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["n_pairs", "n_a", "n_b", "n_groups", "n_links"]).to_pylist()[0]
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        at, times = np.frombuffer(left.column("at")[0].as_py(), "<u4"), np.frombuffer(left.column("times")[0].as_py(), "<u4").astype(np.int64)
        doc = np.repeat(np.arange(len(row["n_pairs"])), row["n_pairs"])
        sums = [np.zeros(len(row["n_pairs"]), np.int64) for _ in range(2)]
        if len(at):
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * n[at])
        columns = [left.column("ids")[0].values] + [pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays(columns + [pa.array(s) for s in sums] + [left.column("sha")[0].values],
                                    ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    out = blocks.drop("pairs", "held").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", key)


def _public(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links, and how its links stand in the corpus."""
    return link_counts(table(spark, sf_dir, "documents"))
