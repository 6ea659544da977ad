"""Vectors, pairs, components and label merge against plain-Python brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintide.operators import mining as mn, similarity as sim, taxonomy as tx
from plaintide.plans.fixture import table


def vectors(spark, arr):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(arr)], "id long, vector array<float>")


def brute_components(arr, thr):
    n = len(arr)
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(n):
        for j in range(i + 1, n):
            if float(np.dot(arr[i], arr[j])) >= thr:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def unit(n, d, seed):
    a = np.random.RandomState(seed).randn(n, d).astype("float32")
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def test_embedding_has_unit_length_and_pads_short_text(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "a"), (3, ""), (4, "Hello  WORLD")], "doc_id long, text string")
    e = sim.hashing_embedding(df)
    n = {r["doc_id"]: r["n"] for r in e.groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()}
    assert set(n) == {1, 2, 3, 4} and all(abs(v - 1) < 1e-9 for v in n.values())
    d = {r["doc_id"]: r["vector"] for r in sim.dense_vectors(e).collect()}
    assert len(d[1]) == 256 and d[1] == d[4] and d[1] != d[2]


def test_pairs_and_forest_over_many_blocks(spark):
    arr = unit(300, 6, 3)
    arr[10] = arr[20] = arr[30]
    v = vectors(spark, arr)
    folded = [i for i in range(300) if i not in (20, 30)]
    want = {(i, j) for i in folded for j in folded if i < j and float(np.dot(arr[i], arr[j])) >= 0.8}
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in sim.similar_pairs(v, 0.8, block_rows=40).collect()}
    assert len(want ^ got) <= 1  # a pair at the threshold may fall either way in single precision
    for thr in (0.8, 0.9, 0.97):
        forest = sim.similarity_forest(v, 0.8, block_rows=40)
        comp = {r["id"]: r["component"] for r in sim.connected_components(forest.filter(F.col("sim") >= thr)).collect()}
        brute = brute_components(arr, thr)
        assert [comp.get(i, i) for i in range(300)] == brute
    assert sim.similarity_forest(v, 0.8, block_rows=40).count() < 300


def test_pairs_of_sparse_vectors(spark):
    """Lists of rare cells: few vectors meet, and every pair is found once."""
    rs = np.random.RandomState(2)
    arr = np.zeros((400, 120), dtype="float32")
    for i in range(400):
        arr[i, rs.choice(120, 6, replace=False)] = rs.randn(6)
    arr[50:60, 3] += 2
    arr /= np.linalg.norm(arr, axis=1, keepdims=True)
    arr[5], arr[6] = arr[4] * 0.9, 0
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if round(float(arr[i].astype(float) @ arr[j].astype(float)), 9) >= 0.6}
    got = sim.similar_pairs(vectors(spark, arr), 0.6, block_rows=30).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 10
    listed, _ = sim._lists(sim._points(vectors(spark, arr), "id"), 0.6)
    # Cells that cannot carry a pair are not listed.
    assert listed.selectExpr("sum(size(lists)) AS m").first()["m"] < 0.8 * np.count_nonzero(arr)
    with pytest.raises(ValueError):
        sim.similar_pairs(vectors(spark, arr), 0.0)


def test_dense_vectors_meet_under_one_cell(spark):
    listed, _ = sim._lists(sim._points(vectors(spark, unit(200, 16, 1)), "id"), 0.3)
    assert listed.selectExpr("max(size(lists)) AS m", "count(*) AS n").first().asDict() == {"m": 1, "n": 200}


def test_mostly_filled_vectors_meet_under_one_list(spark):
    """No cell is filled in all vectors, but lists by cell would send each vector many times."""
    arr = unit(300, 40, 5)
    arr[np.random.RandomState(6).rand(300, 40) < 0.25] = 0
    points = sim._points(vectors(spark, arr), "id")
    listed, _ = sim._lists(points, 0.25, 30)
    assert listed.selectExpr("max(size(lists)) AS m", "count(*) AS n").first().asDict() == {"m": 1, "n": 300}
    tiles = sim._tiles(points, 0.25, 30).count()
    assert tiles.agg(F.sum("count")).first()[0] <= 300 * (300 // 30 + 4)


def test_tile_forest_has_the_components_of_its_pairs():
    import pyarrow as pa

    for own in (True, False):
        arr = unit(200, 6, 8)
        first = np.ones(200, bool) if own else np.random.RandomState(9).rand(200) < 0.4
        t = pa.table({"id": np.arange(200), "vector": pa.array(list(arr), pa.list_(pa.float32())), "first": first, "own": np.full(200, own)})
        _, i, j, s = sim._candidates(t, 0.7)
        _, a, b, w = sim._tile_forest(t, 0.7)
        for thr in (0.7, 0.8, 0.95):
            both = []
            for x, y, z in ((i, j, s), (a, b, w)):
                sets = sim._Sets(200)
                for k in np.flatnonzero(z >= thr):
                    sets.join(int(x[k]), int(y[k]))
                both.append([sets.find(k) for k in range(200)])
            assert both[0] == both[1]
        assert len(a) < 200 < len(i)


def test_vectors_are_sent_as_often_at_any_number(spark):
    """Blocks grow with the vectors, so that a vector goes to as many tiles among 4,000 as among 16,000."""
    sent = []
    for n in (sim.BLOCKS * sim.LEAST_ROWS // 2, sim.BLOCKS * sim.LEAST_ROWS * 2):
        listed = sim._tiles(sim._points(vectors(spark, unit(n, 4, 7)), "id"), 0.2).count()
        sent.append(listed.agg(F.sum("count")).first()[0] / n)
    assert sent[1] <= 1.5 * sim.BLOCKS and sent[1] < 3 * sent[0]
    assert sim._block_rows(10 ** 9, 64) * 64 <= sim.BLOCK_CELLS


def test_single_precision_loses_no_pair_at_the_threshold():
    """Pairs whose products differ from the threshold by less than single precision tells apart, short and very long vectors."""
    import pyarrow as pa

    for scale in (1.0, 1e-3, 1e3, 1e18):
        arr = (unit(300, 64, 11) * scale).astype("float32")
        t = pa.table({"id": np.arange(300), "vector": pa.array(list(arr), pa.list_(pa.float32())), "first": np.ones(300, bool), "own": np.ones(300, bool)})
        exact = np.round(arr.astype(float) @ arr.astype(float).T, sim.DIGITS)
        for thr in np.sort(exact[np.triu_indices(300, 1)])[-2000::400].tolist():
            _, i, j, s = sim._candidates(t, thr - 1e-12 * scale * scale)
            want = {(a, b) for a, b in zip(*np.nonzero(exact >= thr - 1e-12 * scale * scale)) if a < b}
            assert set(zip(i.tolist(), j.tolist())) == want


def test_clusters_read_pairs_below_the_start_only_if_none_is_found(spark, monkeypatch):
    floors, forest = [], sim.similarity_forest
    monkeypatch.setattr(sim, "similarity_forest", lambda v, floor, *a, **k: floors.append(floor) or forest(v, floor, *a, **k))
    base = np.eye(16, dtype="float32")
    tight = [base[0] + 0.1 * base[i] for i in range(1, 5)] + [base[6]]
    wide = [0.6 * base[0] + 0.8 * base[i] for i in range(1, 5)] + [base[6]]  # 0.36 apart
    for arr, want, thr in ((tight, [0.55], 0.55), (wide, [0.55, 0.39, 0.25], 0.35)):
        floors.clear()
        rows = sim.similarity_clusters(vectors(spark, arr), max_frac=1.0).collect()
        assert floors == want and {r["id"] for r in rows} == {0, 1, 2, 3} and {r["threshold"] for r in rows} == {thr}


@pytest.mark.parametrize("parts", [1, 7])
def test_spanning_forest_of_any_edges(spark, parts):
    rs = np.random.RandomState(4)
    edges = {(int(min(x)), int(max(x))): round(float(rs.rand()), 2) for x in rs.randint(0, 300, (900, 2)) if x[0] != x[1]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if parts > 1 else "true")
    try:
        e = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, sim double")
        forest = [tuple(r) for r in sim.spanning_forest(e).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sets, weight, size = sim._Sets(300), 0.0, 0
    for (a, b), s in sorted(edges.items(), key=lambda x: -x[1]):
        if sets.join(a, b):
            weight, size = weight + s, size + 1
    assert len(forest) == size and abs(sum(s for *_, s in forest) - weight) < 1e-9
    mine = sim._Sets(300)
    assert all(mine.join(a, b) for a, b, _ in forest)  # no cycle


@pytest.mark.parametrize("parts", [1, 7])
def test_cuts_of_the_merge_tree(spark, parts):
    rs = np.random.RandomState(7)
    edges = [(i, int(rs.randint(0, i)), float(rs.randint(0, 100)) / 100) for i in range(1, 150)]
    e = spark.createDataFrame([(b, a, s) for a, b, s in edges], "a long, b long, sim double")
    grid = [0.25, 0.3, 0.31, 0.5, 0.62, 0.8, 0.95]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if parts > 1 else "true")
    try:
        tree = sim.merge_tree(e, grid)
        cuts, rows = sim.tree_cuts(tree, len(grid), 3), tree.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    below = None
    for k in reversed(range(len(grid))):
        sets = sim._Sets(150)
        for a, b, s in edges:
            if s >= grid[k]:
                sets.join(a, b)
        size = {}
        for x in range(150):
            size.setdefault(sets.find(x), []).append(x)
        big = [len(m) for m in size.values() if len(m) >= 3]
        assert cuts[k] == (len(big), max(big, default=0))
        want = set()
        if below is not None:
            for root, m in size.items():
                children = {below[x] for x in m}
                if len(children) > 1:
                    want |= {(k, c, sum(below[x] == c for x in m), root, len(m)) for c in children}
            assert {tuple(r) for r in rows if r["level"] == k} == want
        below = {x: sets.find(x) for x in range(150)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    e = spark.createDataFrame(chain + star, "a long, b long")
    got = {r["id"]: r["component"] for r in sim.connected_components(e).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(200)} == {1000}


def test_planted_clusters(spark):
    base = np.eye(16, dtype="float32")
    rs = np.random.RandomState(0)
    near = [base[0] + 0.02 * rs.randn(16) for _ in range(6)]
    arr = [x / np.linalg.norm(x) for x in near] + [base[5], base[6], base[7]]
    c = sim.similarity_clusters(vectors(spark, arr))
    rows = c.collect()
    assert {r["id"] for r in rows} == set(range(6)) and rows[0]["reason"] == "ok"
    gold = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(6)], "id long, label string")
    assert mn.cluster_purity(c, gold).first()["purity"] >= 0.8


def test_clusters_of_the_test_vectors_obey_the_threshold(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).filter("id < 200")
    rows = sim.similarity_clusters(e).collect()
    arr = {r["id"]: np.array(r["vector"]) for r in e.collect()}
    ids = sorted(arr)
    comp = {r["id"]: r["cluster"] for r in rows}
    if rows:
        thr = rows[0]["threshold"]
        for i in comp:
            for j in ids:
                if float(arr[i] @ arr[j]) >= thr + 1e-6:
                    assert comp.get(j) == comp[i]


def greedy(freqs, thr):
    items = sorted(freqs.items(), key=lambda x: (-x[1], x[0]))
    used, out = set(), {}
    for lab, _ in items:
        if lab in used:
            continue
        used.add(lab)
        group = [lab]
        for o, _ in items:
            if o not in used and len(set(lab) & set(o)) / len(set(lab) | set(o)) >= thr:
                used.add(o)
                group.append(o)
        out[lab] = (sum(freqs[g] for g in group), sorted(group[1:]))
    return out


def test_label_merge_equals_greedy(spark):
    rnd = random.Random(5)
    freqs = {}
    while len(freqs) < 150:
        freqs["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))] = rnd.randint(1, 40)
    df = spark.createDataFrame([("x", "y", k, v) for k, v in freqs.items()], "l1 string, l2 string, label string, n long")
    for thr in (0.5, 0.75):
        got = {r["canonical"]: (r["count"], sorted(r["synonyms"])) for r in tx.label_cluster_merge(df, thr).collect()}
        assert got == greedy(freqs, thr)


def test_top_rows_equals_plain_rank(spark):
    from plaintide.functions.common import top_rows
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    got = {(r["k"], r["rn"]): r["id"] for r in top_rows(df, ["k"], [F.desc("v"), F.asc("id")], 5, salt_by=["id"]).collect()}
    plain = {(r["k"], r["rn"]): r["id"] for r in top_rows(df, ["k"], [F.desc("v"), F.asc("id")], 5).collect()}
    assert got == plain


def test_long_chain_and_star(spark):
    """Components need no bound on rounds: a chain of 10,000 nodes and a star."""
    chain = spark.range(9_999).selectExpr("id AS a", "id + 1 AS b")
    star = spark.range(1, 3_000).selectExpr("20000L AS a", "20000 + id AS b")
    out = sim.connected_components(chain.union(star)).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in out} == {0: 10_000, 20_000: 3_000}


@pytest.mark.parametrize("dim", [256, 512, 100])
def test_embedding_of_any_size(spark, dim):
    import hashlib
    texts = ["abc abc abd", "", "x", "Déjà Vu 你好吗 你好吗"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in sim.hashing_embedding(df, dim=dim).collect():
        got.setdefault(r["doc_id"], {})[r["dim"]] = r["value"]
    for i, t in enumerate(texts):
        t = "".join(t.lower().split())
        t = (t + "···")[:3] if len(t) < 3 else t
        v = np.zeros(dim)
        for j in range(len(t) - 2):
            h = int(hashlib.md5(t[j:j + 3].encode()).hexdigest(), 16)
            v[h % dim] += 1 if h >> 8 & 1 else -1
        v /= np.linalg.norm(v)
        assert got[i].keys() == set(np.flatnonzero(v).tolist()) and all(abs(got[i][k] - v[k]) < 1e-12 for k in got[i])


def test_embedding_over_pieces_and_repeated_keys(spark, monkeypatch):
    """Texts longer than a piece, rows of one key in two pieces, NULL keys and symbols above 16 bits."""
    import hashlib

    monkeypatch.setattr(sim, "SYMBOLS", 7)
    rows = [(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, "x"), (1, "second row of one"), (None, "no key"), (None, "a\U0001F600b\U0001F600c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for ngram in (1, 3, 5):
        want = {}
        for k, t in rows:
            t = "".join((t or "").lower().split())
            t = (t + "·" * ngram)[:ngram] if len(t) < ngram else t
            for i in range(len(t) - ngram + 1):
                h = int(hashlib.md5(t[i:i + ngram].encode()).hexdigest(), 16)
                v = want.setdefault(k, {})
                v[h % 50] = v.get(h % 50, 0) + (1 if h >> 8 & 1 else -1)
        got = sim.hashing_embedding(df, dim=50, ngram=ngram).collect()
        unit_of = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in want.items()}
        assert {(r["doc_id"], r["dim"]): round(r["value"], 9) for r in got} == {(k, d): round(x / unit_of[k], 9) for k, v in want.items() for d, x in v.items() if x}
        assert len(got) == sum(x != 0 for v in want.values() for x in v.values())


def test_word_pairs_over_slices(spark, monkeypatch):
    """Pairs cross the slices of a text but not texts or groups; a NULL group is one."""
    monkeypatch.setattr(mn, "TOKENS", 3)
    texts = [("x", "alpha beta gamma delta alpha beta epsilon zeta"), ("y", "alpha beta"), (None, "beta alpha 汉字 beta"), ("x", ""), ("x", None), ("x", "beta alpha"), (None, "zeta")]
    want = set()
    for g, t in texts:
        w = (t or "").split()
        want |= {(g, min(a, b), max(a, b)) for i, a in enumerate(w) for b in w[i + 1:i + 4] if a != b}
    got = [tuple(r) for r in mn.cooccur_edges(spark.createDataFrame(texts, "g string, t string"), "g", "t").collect()]
    assert set(got) == want and len(got) == len(want)


def test_no_task_reads_the_texts_of_a_cluster(spark):
    """Quotes are chosen by id: texts are in no exchange but that of the chosen rows, ties of an id included."""
    rows = [(i, "c", "l2", "l3", "低", " " if i < 2 else f"text {i}\nend ") for i in range(50)] + [(3, "c", "l2", "l3", "低", "text 3\nend"), (None, "d", "l2", "", "高", "none")]
    m = spark.createDataFrame(rows, "id long, cluster string, l2 string, l3 string, severity string, original_text string")
    got = {r["cluster"]: r for r in mn.cluster_profile(m).collect()}
    assert got["c"]["quotes"] == ["text 2 end", "text 3 end", "text 3 end"] and got["c"]["count"] == 51
    assert got["d"]["quotes"] == ["none"]
    plan = mn._quotes(m, "cluster", 3, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_keyword_ranks_deal_the_texts_once(spark):
    from plaintide.operators import keywords as kwd

    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (1, "gamma beta"), (None, "delta")], "doc_id long, text string")
    got = kwd.keyword_tf(df, top=2)
    assert sorted(((r["doc_id"] or 0, r["token"], r["n"], r["score"], r["rank"]) for r in got.collect())) == [
        (0, "delta", 1, 1.0, 1), (1, "alpha", 2, 0.4, 1), (1, "beta", 2, 0.4, 2), (2, "beta", 1, 1.0, 1)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1 == got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange")


def test_vectors_are_dealt_once_however_many_blocks(spark):
    """Every two blocks meet without an exchange of vectors; copies, repeated ids, rows without id or vector."""
    arr = unit(300, 6, 13)
    arr[10] = arr[20] = arr[30]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(arr)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, rows[7][1]), (400, None), (None, None)], "id long, vector array<float>").repartition(5)
    folded = sim._folded(df, "id")
    assert folded.count() == 308 and folded.filter("rep IS NULL").count() == 3
    assert {tuple(r) for r in folded.filter("rep <> id").select("id", "rep").collect()} == {(20, 10), (30, 10)}
    points = folded.filter("vector IS NOT NULL").selectExpr("rep AS id", "vector")
    assert points.count() == 298
    met = sim._block_forests(points, 0.7, 20)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    forest = sim.similarity_forest(df, 0.7, block_rows=20)
    for thr in (0.7, 0.85, 0.97):
        comp = {r["id"]: r["component"] for r in sim.connected_components(forest.filter(F.col("sim") >= thr)).collect()}
        assert [comp.get(i, i) for i in range(300)] == brute_components(arr, thr)
    assert sim.similarity_forest(df.filter("id > 1000"), 0.7).count() == 0


def test_counts_of_ngrams_are_dealt_and_not_texts(spark):
    df = spark.range(40).selectExpr("id % 7 AS doc_id", "concat('text number ', id) AS text").repartition(32)
    e = sim.hashing_embedding(df)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [key") == 1 and plan.index("RepartitionByExpression [key") < plan.index("MapInArrow count(")
    one = sim.hashing_embedding(df.coalesce(1))
    sums = lambda x: {tuple(r) for r in x.selectExpr("doc_id", "dim", "round(value, 9)").collect()}
    assert sums(e) == sums(one) and len(sums(e)) == e.count()


def test_cells_become_vectors_in_any_order(spark):
    rs = np.random.RandomState(3)
    cells = [(k, d, float(rs.randn())) for k in range(60) for d in range(40) if rs.rand() < 0.5] + [(1, 100, 1.0), (None, 3, 2.0), (None, 4, None)]
    want = {}
    for k, d, x in cells:
        if d < 40:
            want.setdefault(k, np.zeros(40, "float32"))[d] = x or 0.0
    rs.shuffle(cells)
    df = spark.createDataFrame(cells, "doc_id long, dim int, value double").repartition(6)
    got = {r["doc_id"]: r["vector"] for r in sim.dense_vectors(df, dim=40).collect()}
    assert got.keys() == want.keys() and all(np.array_equal(np.array(got[k], "float32"), want[k]) for k in want)
    for part in (1, 5):
        twice = df.union(df.filter("doc_id = 9")).repartition(part)
        with pytest.raises(Exception, match="twice"):
            sim.dense_vectors(twice, dim=40).collect()
