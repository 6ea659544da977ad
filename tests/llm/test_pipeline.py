"""The pipeline's stages one after the other against brute force."""
import corpus_pipeline
from plaintide.llm import langid, mixing, simhash
from tests.llm.helpers import DOC, words
from tests.llm.test_operators import components, fingerprint, removal_truth

import numpy as np


def test_stages_in_order(spark, sf, tmp):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(f"{tmp}/{i}")
        tables.append(spark.read.parquet(f"{tmp}/{i}"))
    rows = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:5])

    accepted = {r["doc_id"] for r in rows[1]}
    for r in rows[0]:  # what goes has no letters or was rejected; plain texts of a known language stay
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["doc_id"] not in accepted
    assert len(accepted) > 0.97 * len(rows[0])

    ids = np.array(sorted(accepted))
    text = {r["doc_id"]: r["text"] for r in rows[1]}
    label = components(np.array([fingerprint(text[k]) for k in ids], dtype=np.uint64), ids)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(set(label.tolist()))

    truth = removal_truth({r["doc_id"]: r["text"] for r in rows[2]})
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    for r in rows[3]:
        lost = len(before[r["doc_id"]].encode()) - len(r["text"].encode())
        assert truth[r["doc_id"]][1] <= lost <= truth[r["doc_id"]][1] + 8 * truth[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    assert len(rows[3]) == len(rows[2])

    taken = {r["doc_id"]: r["taken"] for r in mixing.words_taken(tables[3]).collect()}
    out: dict = {}
    for r in rows[4]:
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + len(words(r["text"]))
    # A cut can join the halves of a split word, so that counts are those of the stage's own input.
    assert out == {k: n for k, n in taken.items() if n}

    assert sum(1 for r in rows[5] if r["start"] == 0) == len(rows[4])
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == len(rows[5])
    assert langid.ORDER == 4


def test_one_document_of_each_group_under_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(8)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 60)) for _ in range(12)]
    rows = [(7, text[i], "en", "s", i) for i in range(6)]  # one id on six different texts
    rows += [(7, text[0], "en", "s", 0)] * 3 + [(3, text[1], "en", "s", 1)]  # equal rows; a copy with a smaller id
    rows += [(None, text[i], "de", None, i) for i in (6, 6, 6, 7, 2)]  # no id: three equal rows, one alone, a copy of a row with an id
    rows += [(9, text[8], "en", "a", 8), (9, text[8], "en", "b", 8), (None, None, None, None, None), (None, "", "fr", "s", 0)]
    got = [tuple(r) for r in simhash.one_per_group(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted((r[1] or "") for r in got) == sorted([""] + text[:9])
    by = {r[1] or "": r for r in got}
    assert [by[text[i]][0] for i in range(9)] == [7, 3, 7, 7, 7, 7, None, None, 9] and all(r in rows for r in got)
