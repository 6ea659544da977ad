"""Merkle witnesses, tokenizer alignment and exact groups against brute force, on given tables and on tables of all edges."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaintide.llm import alignment, common, merkle, naming
from plaintide.llm.catalog import QUERIES
from tests.llm.helpers import edge_documents


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 11: Merkle witnesses
def merkle_truth(rows, fan=16):
    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(*[value(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    def tree(now):
        paths, own = [[] for _ in now], list(range(len(now)))
        while len(now) > 1:
            for k, o in enumerate(own):
                run = now[o // fan * fan:(o // fan + 1) * fan]
                paths[k].append((o % fan, run[:o % fan] + run[o % fan + 1:]))
            own = [o // fan for o in own]
            now = [sha(*now[i:i + fan]) for i in range(0, len(now), fan)]
        return now[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    below = {s: tree([leaf(r, r["text"]) for r in sources[s]]) for s in order}
    root, above = tree([below[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for r, path in zip(sources[s], below[s][1]):
            shown = r["text"]
            if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0 and shown is not None:
                shown = re.sub("[A-Z]", lambda m: m[0].lower(), shown)
            d = leaf(r, shown)
            for at, others in path + up:
                d = sha(*others[:at], d, *others[at:])
            out.append((r["doc_id"], leaf(r, r["text"]), below[s][0], root, sha(*[x for _, o in path + up for x in o]), d, d == root))
    return out


def digests(m):
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["others"]), "").cast("binary"), 256)
    out = m.select("doc_id", "leaf", "subroot", "root", proof.alias("p"), merkle.fold(F.col("given"), F.col("path")).alias("f"))
    return [tuple(r) for r in out.withColumn("ok", F.col("f") == F.col("root")).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def fifth():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_witnesses(spark, sf, levels):
    docs = given(spark, sf)
    assert ordered(digests(merkle.manifest(docs, tampered=fifth(), levels=levels))) == ordered(merkle_truth(docs.collect()))


def test_witnesses_of_one_large_source_and_many_small(spark):
    rows = spark.range(700).selectExpr("id AS doc_id", "concat('T', id) AS text", "'en' AS lang", "if(id < 400, 'hot', if(id < 410, null, concat('s', id))) AS source", "id AS n_chars")
    got = digests(merkle.manifest(rows, tampered=fifth(), levels=1))
    assert ordered(got) == ordered(merkle_truth(rows.collect()))
    # A tampered text with an upper-case letter no longer verifies, all others do.
    assert all(r[-1] == (zlib.crc32(str(r[0]).encode()) % 5 != 0) for r in got)


def test_witnesses_of_edges(spark):
    docs = edge_documents(spark)
    assert ordered(digests(merkle.manifest(docs, tampered=fifth(), levels=1))) == ordered(merkle_truth(docs.collect()))


def test_one_leaf(spark):
    one = merkle.manifest(edge_documents(spark).limit(1)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def test_streaming_appends_give_each_leaf_its_siblings():
    for n in (1, 2, 3, 4, 9, 10, 27, 40):
        tree, paths = merkle.Appender(3), [[] for _ in range(n)]
        for i in range(n):
            tree.append(sha(str(i)), paths[i])
        levels = merkle.height(n, 99, 3)
        root = tree.finish(levels)
        for i, path in enumerate(paths):
            d = sha(str(i))
            for at, others in path:
                d = sha(others[:64 * at], d, others[64 * at:])
            assert d == root and len(path) == levels


# 12: alignment
def alignment_truth(docs):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, names = alignment.byte_alphabet(), {v: k for k, v in a.get_vocab().items()}

    def spans(ids, of):
        out, p = [], 0
        for i in ids:
            out.append((p, p + len(of(i)), i))
            p = out[-1][1]
        return out

    def bytes_a(i):
        return bytes(alphabet[c] for c in names[i])

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    seen, count = [], Counter()
    for doc, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(map(bytes_a, ids_a)) != want or b"".join(map(bytes_b, ids_b)) != want:
            ids_a, ids_b = [], []
        sa, sb = spans(ids_a, bytes_a), spans(ids_b, bytes_b)
        links = [(x[2], y[2]) for x in sa for y in sb if x[0] < y[1] and y[0] < x[1]] if len(sa) < 300 else swept(sa, sb)
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e, _ in sa} & {e for _, e, _ in sb}):
            left, right = [x for x in sa[i:] if x[1] <= cut], []
            while j < len(sb) and sb[j][1] <= cut:
                right.append(sb[j])
                j += 1
            i += len(left)
            groups.append(",".join(str(x[2]) for x in left) + "|" + ",".join(str(x[2]) for x in right))
        seen.append((doc, len(sa), len(sb), groups, links))
        count.update(set(links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    return [(doc, na, nb, len(g), len(l), sum(count[x] == top[x[0]] for x in l), sum(count[x] for x in l), sha(";".join(g)) if na else "") for doc, na, nb, g, l in seen]


def swept(sa, sb):
    out, j = [], 0
    for lo, hi, i in sa:
        while sb[j][1] <= lo:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < hi:
            out.append((i, sb[k][2]))
            k += 1
    return out


def test_alignment(spark, sf):
    docs = given(spark, sf).filter("length(text) < 20000 OR text IS NULL")
    want = ordered(alignment_truth([(r["doc_id"], r["text"]) for r in docs.collect()]))
    for tokens in (alignment.BLOCK_TOKENS, 2000):
        assert ordered([tuple(r) for r in alignment.link_counts(docs, block_tokens=tokens).collect()]) == want


def test_alignment_of_edges(spark):
    extra = spark.createDataFrame([(90, "▁ under"), (91, "<s> </s> <0x41> <unk>"), (92, "日本語の文章。絵文字😀も"), (93, "  a  b\n\n c \t d"), (94, "\u0085x   y"), (95, "́a ﬁ ½ " * 40)], "doc_id long, text string")
    docs = edge_documents(spark).select("doc_id", "text").unionByName(extra)
    want = ordered(alignment_truth([tuple(r) for r in docs.collect()]))
    assert ordered([tuple(r) for r in alignment.link_counts(docs, block_tokens=100).collect()]) == want
    groups = {r["doc_id"]: r["groups"] for r in alignment.token_groups(docs.filter("doc_id IS NOT NULL")).collect()}
    assert all((sha(groups[r[0]]) if groups[r[0]] else "") == r[-1] for r in want if r[0] is not None)


def test_division_at_shared_cuts():
    rng = np.random.default_rng(5)
    for size, share in ((30, 0.5), (400, 0.9), (400, 0.05), (3000, 0.01)):
        a, b = (np.append(np.flatnonzero(rng.random(size) < share), size) for _ in range(2))
        la, ha, lb, hb = alignment.shared_groups(a, b, *[np.array([x]) for x in (0, len(a), 0, len(b))])
        cuts = np.intersect1d(a, b)
        assert (a[ha - 1] == cuts).all() and (b[hb - 1] == cuts).all() and (la[1:] == ha[:-1]).all() and (lb[1:] == hb[:-1]).all()


# 13: exact groups
def groups_truth(rows):
    best, size = {}, Counter()
    for doc, text in rows:
        t = text or ""
        size[t] += 1
        best[t] = max([x for x in (best.get(t), doc) if x is not None], default=None)
    return [(doc, best[text or ""], size[text or ""], sha(text or "")) for doc, text in rows]


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_exact_groups(spark, size):
    texts = ["ab" * n for n in range(9)] + ["ab" * 4 + "x", "a\x00", "a", "é" * 7, "e" * 14, None] + ["z" * n for n in (6, 7, 8, 13, 14, 15, 28, 29)]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "ab"), (None, "nil"), (None, "nil"), (3, "ab" * 3), (200, "ab"), (200, "ab")]
    got = naming.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=size).collect()
    assert ordered([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]) == ordered(groups_truth(rows))
    # Exactly one row of each group stays, and it has the group's largest id.
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows}) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_shared_tags_are_made_anew(spark, monkeypatch):
    honest = naming._tag
    monkeypatch.setattr(naming, "_tag", lambda block, salt: honest(block, salt) if salt else F.lit(b"same"))
    rows = [(1, "one"), (2, "two"), (3, "one")]
    got = naming.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["keep_id"]) for r in got.collect()) == [(1, 3), (2, 2), (3, 3)]


def test_only_dataframe_functions(spark, sf):
    plan = QUERIES["op13_block_naming"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_look_up_of_frequent_keys(spark):
    left = spark.range(3000).selectExpr("if(id < 2000, -1, id % 100) AS k", "id AS v")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("name", F.col("k") * 10)
    got = common.look_up(left, right, ["k"], "w", 3000)
    assert sorted(got.columns) == ["k", "name", "v"]
    assert got.count() == 3000 and got.filter("name <> k * 10 OR name IS NULL").count() == 0
