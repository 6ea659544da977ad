"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as lower-case letters with one break between words. A symbol is a UTF-16 unit of a letter, so that no
letter of any script is folded into another. A model holds, for each order, sorted 64-bit hashes of its n-grams with
discounted probabilities, and sorted hashes of its contexts with the interpolation weights; look-ups are binary
searches. A text goes to the language of the lowest cross-entropy per symbol. A task remembers the looked-up log
probabilities of the n-grams it has met in a table of bounded size, where a newer n-gram takes the place of an older one.

Learning takes at most ``max_docs`` documents of each language, drawn by a hash of the id; prediction reads every
text whole.

Edge cases: NULL, empty and letterless texts are ``und`` with score 0 and count as rejected; rows without a language
teach nothing; nothing to learn from makes every text ``und``; repeated rows give repeated results; ties go to the
smaller language name; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaintide.llm.common import arrow_map, held_out, kept, mix64, table
from plaintide.session import materialise

ORDER = 4
BITS = 16  # a symbol: 0 is a break, all others are UTF-16 units
LEAST_SYMBOLS = 64  # the shortest order spreads its rest over so many symbols at least
NONE = np.uint64((1 << 64) - 1)  # no n-gram: U+FFFF is no letter
_CHUNK = 1 << 18  # symbols judged at once
_TABLE = 1 << 24  # bytes of remembered log probabilities


def letters_of(text: str) -> str:
    return text.lower()


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Symbols with one break before, between and after words; empty if there is no letter."""
    s = np.frombuffer(letters_of(text).encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    letter = is_letter()[s]
    high = np.flatnonzero((s[:-1] & 0xFC00 == 0xD800) & (s[1:] & 0xFC00 == 0xDC00))
    if len(high):  # a letter of two units
        letter[high] = is_letter()[0x10000 + ((s[high].astype(np.int64) & 0x3FF) << 10) + (s[high + 1] & 0x3FF)]
        letter[high + 1] = letter[high]
    s = np.where(letter, s, np.uint16(0))
    keep = letter
    if not keep.any():
        return s[:0]
    keep[1:] |= s[:-1] != 0  # the first break after a letter stays
    s = s[keep]
    s = s if s[0] else s[1:]
    return np.concatenate([[0], s, [0]] if s[-1] else [[0], s]).astype(np.uint16)


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams ending at each symbol but the first; before the text stand breaks."""
    padded = np.concatenate([np.zeros(order - 1, np.uint8), s]).astype(np.uint64)
    out = np.zeros(len(s), dtype=np.uint64)
    for j in range(order):
        out = (out << np.uint64(BITS)) | padded[j:j + len(s)]
    return out[1:]


def _hash(order: int, code: np.ndarray) -> np.ndarray:
    return mix64(code.astype(np.uint64)) ^ np.uint64(order)


@dataclass
class Level:
    """Sorted hashes with a value each; a missing hash has value 0."""
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> "Level":
        o = np.argsort(hashes)
        return cls(hashes[o], values[o].astype(np.float32))

    def get(self, hashes: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), missing)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], missing).astype(np.float64)


@dataclass
class KneserNey:
    """One language. ``grams[n]``: discounted share of an n-gram in its context; ``back[n]``: weight of the
    next shorter order in a context of n - 1 symbols (1 for an unseen one)."""
    grams: list[Level] = field(default_factory=list)
    back: list[Level] = field(default_factory=list)
    symbols: int = 1 << BITS

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray, order: int = ORDER, symbols: int = 1 << BITS) -> "KneserNey":
        """From the counted n-grams of the highest order. A lower order counts the distinct symbols before
        each of its n-grams."""
        model, levels = cls(symbols=symbols), {}
        code, n = codes.astype(np.uint64), counts.astype(np.float64)
        for k in range(order, 0, -1):
            levels[k] = (code, n)
            tail = code & np.uint64((1 << (BITS * (k - 1))) - 1)
            code, n = np.unique(tail, return_counts=True)
            n = n.astype(np.float64)
        for k in range(1, order + 1):
            code, n = levels[k]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, back = np.unique(code >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(back, n)
            kinds = np.bincount(back)
            model.grams.append(Level.of(_hash(k, code), np.maximum(n - d, 0) / total[back]))
            model.back.append(Level.of(_hash(k, ctx), d * kinds / total))
        return model

    def log10(self, codes: np.ndarray) -> np.ndarray:
        order = len(self.grams)
        p = np.full(len(codes), 1.0 / self.symbols)
        for k in range(1, order + 1):
            tail = codes.astype(np.uint64) & np.uint64((1 << (BITS * k)) - 1)
            weight = self.back[k - 1].get(_hash(k, tail >> np.uint64(BITS)), 1.0)
            p = self.grams[k - 1].get(_hash(k, tail), 0.0) + weight * p
        return np.log10(p)


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[KneserNey]
    limits: np.ndarray  # cross-entropy above which a text is rejected, by language


def _entropies(model: LanguageModel, token: str, parts: list[np.ndarray]) -> np.ndarray:
    """(text, language): cross-entropy per symbol, log10, of texts given as n-gram codes (none empty)."""
    n = len(model.languages)
    bits = max(10, (_TABLE // (8 + 4 * n)).bit_length() - 1)
    held, rows = kept(("langid", token), lambda: (np.full(1 << bits, NONE), np.zeros((1 << bits, n), np.float32)))
    slot_of = lambda c: (mix64(c) >> np.uint64(64 - bits)).astype(np.int64)
    codes = np.concatenate(parts)
    size = np.array([len(p) for p in parts])
    slot = slot_of(codes)
    miss = np.flatnonzero(held[slot] != codes)
    new, back = np.unique(codes[miss], return_inverse=True)
    got = np.stack([m.log10(new) for m in model.models], axis=1).astype(np.float32)
    first = np.cumsum(size) - size
    out = np.empty((len(parts), n))
    for k in range(n):
        value = rows[slot, k].astype(np.float64)
        value[miss] = got[back, k]
        out[:, k] = -np.add.reduceat(value, first) / size
    to, at = np.unique(slot_of(new), return_index=True)
    held[to], rows[to] = new[at], got[at]
    return out


def learn(sample: DataFrame, margin: float = 6.0, spare: float = 0.35) -> LanguageModel | None:
    """Fits the models on rows (lang, text). N-grams are counted by Spark; the counted tables, whose
    size the sample bounds, meet on the driver. Rejection is calibrated per language on the sample itself: a text
    is rejected above mean + ``margin`` deviations + ``spare`` of its own language's cross-entropy."""
    rows = sample.select("lang", "text").filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        langs = np.array(b.column("lang").to_pylist())
        text = b.column("text").to_pylist()
        name, code, n = [], [], []
        for lang in np.unique(langs):
            g = [grams(s, ORDER) for i in np.flatnonzero(langs == lang) if len(s := symbols(text[i]))]
            if g:
                c, k = np.unique(np.concatenate(g), return_counts=True)
                name += [str(lang)] * len(c)
                code.append(c.view(np.int64))
                n.append(k.astype(np.int64))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(cat(code)), pa.array(cat(n))], ["lang", "code", "n"])
    counted = arrow_map(rows, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return None
    models = []
    last = counted["code"].to_numpy(np.int64).view(np.uint64) & np.uint64((1 << BITS) - 1)
    kinds = max(LEAST_SYMBOLS, len(np.unique(last)) + 1)  # of all languages, and one for all that was not met
    for lang in languages:
        own = counted[counted["lang"] == lang].sort_values("code")
        models.append(KneserNey.fit(own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(), symbols=kinds))
    model = LanguageModel(list(languages), models, np.full(len(languages), np.inf))
    seen = identify(sample, model, "lang").filter("lang = lang_pred").groupBy("lang").agg(
        F.avg("entropy").alias("m"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("s")).collect()
    for r in seen:
        model.limits[languages.index(r["lang"])] = r["m"] + margin * r["s"] + spare
    return model


MAX_BROADCAST_KEYS = 1_000_000


def learning_sample(docs: DataFrame, admitted: Column, max_docs: int, key: str = "doc_id", body: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text): of the admitted distinct (id, text) of each language the ``max_docs`` with the smallest hashes, or all if there
    are fewer. Repeated rows count once; rows without text or language teach nothing; a NULL id is an id of its own.

    Only ids and hashes are sorted, and of these only the ones below a hash bound from their number, so that a language of any
    size is never sorted whole; while a language has fewer below its bound than it should, the bounds are widened.
    """
    rows = docs.filter(admitted & F.col(lang).isNotNull() & (F.length(body) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(key).alias("k"), F.xxhash64(F.col(body)).alias("t"), F.col(body).alias("text"))
    pool = materialise(rows.groupBy("lang", "k", "t").agg(F.xxhash64("k", "t").alias("h")))
    n = materialise(pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # one row a language
    wider = 1.5
    while True:
        share = F.least(F.lit(1.0), F.lit(wider * max_docs + 50) / F.col("n"))
        below = pool.join(F.broadcast(n), "lang").filter((share >= 1) | (F.col("h") <= F.lit(2.0 ** 63) * (F.lit(2.0) * share - 1)))
        found = below.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        if n.join(found, "lang", "left").filter(F.coalesce("found", F.lit(0)) < F.least("n", F.lit(max_docs))).isEmpty():
            break
        wider *= 4
    order = Window.partitionBy("lang").orderBy("h", "k", "t")
    chosen = materialise(below.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_docs).select("lang", "k", "t"))
    few = chosen.count() <= MAX_BROADCAST_KEYS
    got = rows.join(F.broadcast(chosen) if few else chosen, ["lang", "k", "t"], "left_semi")
    return got.groupBy("lang", "k", "t").agg(F.first("text").alias("text")).select("lang", "text")


def identify(docs: DataFrame, model: LanguageModel | None, *keep: str, body: str = "text") -> DataFrame:
    """(keep..., lang_pred, score, entropy, rejected) of each row. ``score`` is the share of the best language among
    all, from the cross-entropies of the text."""
    wanted = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(body), F.lit("")).alias("_body"))
    token = f"{id(model)}-{np.random.default_rng().integers(1 << 62)}"
    names = np.array(model.languages if model else [], dtype=object)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        text = b.column("_body")
        n = b.num_rows
        pred, score = np.full(n, "und", dtype=object), np.zeros(n)
        entropy, rejected = np.full(n, np.nan), np.ones(n, dtype=bool)
        parts: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            h = _entropies(model, token, parts)
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            weight = np.exp(-np.log(10) * np.minimum(np.array([len(p) for p in parts]), 200)[:, None] * (h - low[:, None]))
            pred[rows] = names[best]
            score[rows] = 1.0 / weight.sum(axis=1)
            entropy[rows] = low
            rejected[rows] = low > model.limits[best]
            parts.clear()
            rows.clear()
        held = 0
        for i in range(n):
            if model is None:
                break
            s = symbols(text[i].as_py())
            if len(s):
                parts.append(grams(s, ORDER))
                rows.append(i)
                held += len(s)
                if held >= _CHUNK:
                    flush()
                    held = 0
        if rows:
            flush()
        out = [pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*b.schema.names[:-1], "lang_pred", "score", "entropy", "rejected"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return arrow_map(wanted, work, (fields + ", " if fields else "") + "lang_pred string, score double, entropy double, rejected boolean")


def op5_language(spark: SparkSession, sf_dir: str, max_docs: int = 1500) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = learn(learning_sample(docs, ~out, max_docs))
    got = identify(docs, model, "doc_id")
    return got.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def known_language(docs: DataFrame, max_docs: int = 1500) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose text the models accept."""
    names = docs.columns
    model = learn(learning_sample(docs, ~held_out("doc_id", 4, 2), max_docs))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index('text')}"
    got = identify(plain, model, *plain.columns, body=body).filter("NOT rejected")
    return got.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
