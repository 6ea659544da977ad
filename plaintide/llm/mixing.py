"""Mixing sources to target weights.

Each source's words form a stream that is cut into blocks of fixed length. Output shards of equally many slots get
source counts by multinomial draws over what the sources still owe, so the shards' counts add up to the targets.
The k-th slot of a source takes block perm(k): a keyed Feistel permutation of its block numbers, a new one for each
pass over the source. Slots and blocks meet in a join on (source, block).

A stream is laid out in buckets of documents (a hash of the row), so a source of any size is spread over many tasks;
each bucket ends its last block early. Small sources have shorter blocks, so that a source of few words is not taken as one.

A document is known by its text's hash, its row's hash and its number among equal rows. Equal rows are counted, not
sorted, so a mass of them costs what other rows do; texts meet their taken words row by row.

The shards' counts come from halving: the slots of a run of shards are drawn for its first half, the rest are the second
half's, each half with a seed of its own. So a task draws its shards from the root down, without the ones before them.

Edge cases: NULL texts have size 0, take part in nothing and get taken = 0; a NULL source is a source of its own and
comes last; rows with equal ids and texts are separate documents, each of its own source; an empty table gives no rows and no
shards; other columns are ignored. The number of sources is taken to fit the driver, as the weights are a setting.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaintide.functions.common import MAX_BROADCAST_ROWS
from plaintide.llm.common import mix64, shuffle_parts, table
from plaintide.session import materialise

BLOCK = 64
BUCKET_DOCS = 4096
SHARD_SLOTS = 1 << 16
SHARDS_OF_TASK = 16
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 under a key, element by element: a four-round Feistel network on the
    least even number of bits that holds n, walked until the value is below n."""
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64)
    half = (bits + np.uint64(1)) >> np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = k.astype(np.uint64)
    limit = n.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(key[todo].astype(np.uint64) + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def targets(size: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words due from each source: ``share`` of all words split by the repeating weights, no source above ``most``
    times its size, and what exceeds that split again by weight among the others until none is above."""
    w = [weights[i % len(weights)] for i in range(len(size))]
    out, open_ = [0.0] * len(size), set(range(len(size)))
    left = share * sum(size)
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > most * size[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * size[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def drawn(left: np.ndarray, need: int, seed: list[int]) -> np.ndarray:
    """``need`` slots drawn multinomially from what is left of each source, never more than that; what such a limit sets free
    is drawn again."""
    rng, got = np.random.default_rng(seed), np.zeros(len(left), np.int64)
    while need:
        rest = left - got
        draw = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        got += draw
        need -= int(draw.sum())
    return got


def shard_counts(due: np.ndarray, slots: int, seed: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots per source, slots per source in all shards before) of the shards lo..hi-1, all by default. Every shard has
    ``slots`` slots, the last one what remains."""
    due = due.astype(np.int64)
    shards = -(-int(due.sum()) // slots)
    hi = shards if hi is None else min(hi, shards)
    todo = [(0, shards, due, np.zeros(len(due), np.int64))]
    while todo:
        a, b, own, before = todo.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, own, before
            continue
        mid = (a + b) // 2
        first = drawn(own, (mid - a) * slots, [seed, a, b])
        todo += [(mid, b, own - first, before + first), (a, mid, first, before)]


@dataclass
class Mix:
    """``docs``: (id, mark, row, copy, source, size, start, bucket, base, block, ...) with the document's place in its bucket's stream;
    ``slots``: (shard, slot, source, block) of the mixed corpus; ``sources``: (source, source_size, target)."""
    docs: DataFrame
    slots: DataFrame
    sources: DataFrame


SAME = ["mark", "row", "copy"]  # what tells documents apart


def identity(documents: DataFrame, body: str) -> list[Column]:
    """The text's hash and the row's hash; both of them tell different rows apart, NULLs included."""
    hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in documents.schema.fields]
    return [F.xxhash64(F.col(body)).alias("mark"), F.xxhash64(*hashed).alias("row")]


def mix(documents: DataFrame, key: str = "doc_id", body: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1),
        share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> Mix:
    """Plans the mix. ``Mix.slots`` lists every slot of every output shard with the block it takes."""
    spark = documents.sparkSession
    thin = documents.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), n_words(F.col(body)).alias("size"), *identity(documents, body))
    rows = thin.groupBy("id", "source", "size", "mark", "row").agg(F.count(F.lit(1)).alias("n"))
    docs = materialise(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))
    per = docs.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    per = sorted(per, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    due = targets([r["n"] for r in per], weights, share, most)
    known = spark.createDataFrame([(i, r["source"], r["n"], t, max(1, -(-r["docs"] // BUCKET_DOCS)), max(1, min(block, r["n"] // block))) for i, (r, t) in enumerate(zip(per, due))],
                                  "sid int, source string, source_size long, target double, buckets int, block long")
    # Place of each document in its bucket's stream. One row a source, which the driver holds; beyond the bound they meet in a shuffle.
    small = F.broadcast(known) if len(per) <= MAX_BROADCAST_ROWS else known
    placed = docs.join(small, docs["source"].eqNullSafe(known["source"])).select(
        "id", known["source"], "source_size", "target", "sid", "size", "block", *SAME, F.pmod(F.xxhash64(*SAME, F.lit(seed)), F.col("buckets")).cast("int").alias("bucket"))
    order = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("row", "copy"), *SAME)
    placed = placed.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["start"])
    buckets = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"), F.first("block").alias("block")).withColumn("blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialise(buckets.withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("long")))
    total = {r["sid"]: (r["b"], r["w"]) for r in buckets.groupBy("sid").agg(F.sum("blocks").alias("b"), F.sum("words").alias("w")).collect()}
    docs = placed.join(buckets.select("sid", "bucket", "base", "words"), ["sid", "bucket"])

    # A slot gives w / b words on average; no source may pass ``most`` full passes over its blocks.
    blocks = np.array([total.get(i, (0, 0))[0] for i in range(len(per))], dtype=np.int64)
    words = np.array([total.get(i, (0, 0))[1] for i in range(len(per))], dtype=np.float64)
    slots = np.floor(np.array(due) * blocks / np.maximum(words, 1) + 0.5).astype(np.int64)
    slots = np.minimum(slots, np.floor(most * blocks).astype(np.int64))
    groups = -(-int(slots.sum()) // (shard_slots * SHARDS_OF_TASK))

    def spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for g in b.column("id").to_pylist():
                for shard, got, first in shard_counts(slots, shard_slots, seed, g * SHARDS_OF_TASK, (g + 1) * SHARDS_OF_TASK):
                    some = np.flatnonzero(got)
                    at = np.cumsum(got[some]) - got[some]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(some), shard), at, some.astype(np.int32), first[some], got[some], blocks[some])],
                                                     ["shard", "at", "sid", "first", "n", "blocks"])
    runs = spark.range(0, groups, 1, max(1, min(groups, shuffle_parts(spark)))).mapInArrow(spans, "shard long, at long, sid int, first long, n long, blocks long")
    each = runs.select("shard", "sid", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), "at", "first").select(
        "shard", (F.col("at") + F.col("i")).alias("slot"), "sid", "blocks", (F.col("first") + F.col("i")).alias("k"))

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sid, n, k = (b.column(c).to_numpy() for c in ("sid", "blocks", "k"))
            key_ = mix64(sid.astype(np.uint64) * np.uint64(1 << 20) + (k // np.maximum(n, 1)).astype(np.uint64)) ^ np.uint64(seed)
            got = permute(k % np.maximum(n, 1), n, key_) if len(k) else k
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), b.column("sid"), pa.array(got)], ["shard", "slot", "sid", "block"])
    out = each.mapInArrow(draw, "shard long, slot long, sid int, block long")
    return Mix(docs, out, known)


def pieces(m: Mix) -> DataFrame:
    """(mark, row, copy, lo, hi, times): the words lo..hi-1 of a document that lie in one drawn block, and how often the
    mix takes them. A document has a row for each drawn block that it touches."""
    taken = m.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    length = F.col("block")
    own = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)))
    touch = m.docs.filter("size > 0").select("*", own.alias("own")).select(
        *SAME, "sid", (F.col("base") + F.col("own")).alias("block"),
        F.greatest(F.lit(0), F.col("own") * length - F.col("start")).cast("long").alias("lo"),
        F.least(F.col("size"), (F.col("own") + 1) * length - F.col("start")).cast("long").alias("hi"))
    # Drawn slots grow with the corpus, but the planner takes them for the few rows that they are made from.
    return touch.join(taken.hint("merge"), ["sid", "block"])


def words_taken(documents: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(key, size, source, source_size, target, taken) of every document."""
    m = mix(documents, key, **how)
    got = pieces(m).groupBy(*SAME).agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("t"))
    return m.docs.join(got, SAME, "left").select(F.col("id").alias(key), "size", "source", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))


def _cut(body: str, spans: list[tuple[int, int]], size: int) -> str:
    """The words lo..hi-1 of each span, with what stands between them; spans in order, joined where they meet."""
    spans = sorted(spans)
    joined = [list(spans[0])]
    for lo, hi in spans[1:]:
        if lo == joined[-1][1]:
            joined[-1][1] = hi
        else:
            joined.append([lo, hi])
    if joined == [[0, size]]:
        return body
    at = [w.span() for w in _WORD.finditer(body)]
    return "\n".join(body[at[lo][0]:at[hi - 1][1]] for lo, hi in joined)


def mixed_documents(documents: DataFrame, key: str = "doc_id", body: str = "text", **how) -> DataFrame:
    """The mixed corpus as documents: for each pass that takes a part of a document, a row with the columns of
    ``documents`` and the taken words as its text (the whole text where all are taken). ``n_chars``, if present,
    follows the text. Documents of which nothing is taken are left out."""
    names = documents.columns
    m = mix(documents, key, body, **how)
    passes = pieces(m).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("pass"))
    spans = passes.groupBy(*SAME, "pass").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    # Equal rows are one row here, and each of their copies that the mix takes brings its own spans.
    at = names.index(body)
    plain = documents.select(*identity(documents, body), F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("_doc"))
    plain = plain.groupBy("mark", "row").agg(F.first("_doc").alias("_doc"))
    both = plain.join(spans, ["mark", "row"]).select("_doc.*", F.struct(F.col("_spans").alias("spans"), n_words(F.col(f"_doc.c{at}")).alias("size")).alias("_part"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            text = x.column(at).to_pylist()
            new = []
            for t, p in zip(text, x.column(len(names)).to_pylist()):
                new.append(_cut(t, [(s["lo"], s["hi"]) for s in p["spans"]], p["size"]))
            cols = x.columns[:len(names)]
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, x.schema.names[:len(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[:len(names)])
    got = both.mapInArrow(cut, schema).toDF(*names)
    return got.withColumn("n_chars", F.length(body).cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else got


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return words_taken(table(spark, sf_dir, "documents"))
