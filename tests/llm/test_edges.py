"""Every operator and stage over NULLs, empty and long texts, ties, repeated rows, empty tables and clashing names."""
import pytest

import corpus_pipeline
from plaintide.llm import alignment, boosted, langid, merkle, mixing, multiindex, naming, ngram, packing, rulefit, simhash, suffixes, urlrules
from tests.llm.helpers import CLASHING, LABEL, edge_documents, no_documents
from pyspark.sql import functions as F


def labels(spark, rows=((1, 0, 0), (3, 1, 0), (10, 1, 0), (11, None, 1), (None, 1, 0), (3, 1, 0))):
    return spark.createDataFrame(list(rows), LABEL)


OPERATORS = {
    "rules": lambda s, d: rulefit.classify(d, labels(s)).select("doc_id", "held_out", "score", "predicted"),
    "language model": lambda s, d: ngram.score_texts(d),
    "mix": lambda s, d: mixing.words_taken(d),
    "language": lambda s, d: langid.identify(d, langid.learn(langid.learning_sample(d, F.lit(True), 100)), "doc_id"),
    "packing": lambda s, d: packing.pack(d),
    "simhash": lambda s, d: simhash.near_groups(d),
    "suffixes": lambda s, d: suffixes.removal(d),
    "boosted": lambda s, d: boosted.judge(d, labels(s)),
    "witnesses": lambda s, d: merkle.manifest(d, levels=1),
    "alignment": lambda s, d: alignment.link_counts(d, block_tokens=200),
    "naming": lambda s, d: naming.exact_groups(d, block_bytes=16),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("extra", [False, True])
def test_rows_of_edge_documents(spark, name, extra):
    docs = edge_documents(spark, extra)
    out = OPERATORS[name](spark, docs)
    got = sorted([r["doc_id"] for r in out.select("doc_id").collect()], key=lambda x: (x is None, x or 0))
    want = sorted([r["doc_id"] for r in docs.select("doc_id").collect()], key=lambda x: (x is None, x or 0))
    if name == "packing":  # one document has more than one piece
        got = sorted([r["doc_id"] for r in out.filter("start = 0").collect()], key=lambda x: (x is None, x or 0))
    assert got == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, no_documents(spark)).count() == 0


@pytest.mark.parametrize("step,stage", corpus_pipeline.STAGES)
def test_stages_over_edges(spark, step, stage):
    docs = edge_documents(spark, extra=True)
    out = stage(spark, docs, "")
    if step != "packing":
        assert out.columns == docs.columns
        first = out.collect()
        assert all(r[c] == i for r in first for i, c in enumerate(CLASHING))
    assert out.count() > 0
    assert stage(spark, no_documents(spark), "").count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/at all"), (4, "http://Example.ORG/en/1?x"), (5, "http://example.org"), (6, "x://a.b.com/de/" + "y" * 5000),
            (7, "http://evil.com/a.org/fr/"), (4, "http://Example.ORG/en/1?x"), (None, "http://a.org/"), (8, "http://ünï.org/ß#f"), (9, "http://notexample.org/es/"),
            (10, "http://www.cheap-pills.net/x"), (11, "http://com/fr/x"), (12, "http://a.com/fr"), (13, "http://x?y/://z.org/"), (14, "a://b\n.org/\nc")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS id", "'h' AS host", "'v' AS verdict")
    got = urlrules.filter_urls(df)
    assert got.count() == len(rows)
    by = {r["page_id"]: r for r in got.collect()}
    for k, u in rows:
        after = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        i = min([after.find(c) for c in "/?#" if c in after] or [len(after)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in after[:i])
        rest_ = after[i:]
        j = min([rest_.find(c) for c in "?#" if c in rest_] or [len(rest_)])
        path = rest_[:j]
        assert (by[k]["host"], by[k]["path"]) == (host, path)
        fit = [(v, h + p) for v, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[1]), default=(None, None))
        assert by[k]["rule"] == best[1]
        if best[0]:
            assert by[k]["verdict"] == best[0]
    assert by[10]["verdict"] == "block" and by[1]["verdict"] == "allow"
    assert urlrules.filter_urls(df.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(1, 9)] + [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, None, 2.0]), (23, [nan, 1.0, 1.0]), (24, [inf, 0.0, 1.0]),
            (25, [1.0]), (100, [1.0, 1.0, 0.0]), (101, [1.0, 1.0, 0.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "5 AS id", "'c' AS cell")
    got = multiindex.nearest(df, F.col("id") == 100).orderBy("rank").collect()
    # Equal distances go to the smaller id; fewer candidates than ten are all returned.
    assert [r["vec_id"] for r in got] == [1, 101, 2, 3, 4, 5, 6, 7, 8]
    assert [r["score"] for r in got] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert multiindex.nearest(df.limit(0), F.col("id") == 100).count() == 0


def test_repeated_query_ids(spark):
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(1, 31)] + [(100, [1.0, 1.0, 0.0])] * 3 + [(100, [30.0, 1.0, 0.0])] + [(2, [2.0, 1.0, 0.0])] * 12
    got = multiindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 100).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r["query_vec"], []).append((r["rank"], r["vec_id"], r["score"]))
    # One list for each vector of the id, with ten different neighbours.
    assert sorted(lists.values()) == [[(i + 1, i + 1, float(i)) for i in range(10)], [(i + 1, 30 - i, float(i)) for i in range(10)]]
