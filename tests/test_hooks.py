"""The predict and embed hooks."""
import os

from pyspark.sql import functions as F

from plaintide.operators import hooks, similarity as sim


def test_batches_are_bounded_and_models_load_once_a_task(spark, tmp):
    rows = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(200)] + [(900, None)], "id long, t string").repartition(3)
    log = os.path.join(tmp, "loads")
    os.makedirs(log)

    def load():
        import uuid
        open(os.path.join(log, uuid.uuid4().hex), "w").close()

        def model(texts):
            assert len(texts) <= 7 and (len(texts) == 1 or sum(map(len, texts)) <= 100) and None not in texts
            return [f"{len(t)}" for t in texts]
        return model
    got = {r["id"]: (r["prediction"], r["prediction_error"]) for r in hooks.apply_model(rows, load, "t", most=7, most_chars=100).collect()}
    assert got == {i: (str(i % 40), None) for i in range(200)} | {900: (None, None)}
    assert len(os.listdir(log)) <= 3


def test_a_bad_text_costs_its_own_answer_only(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError("no " + str(len(texts)))
            return [t.upper() for t in texts if t != "short"]  # an answer too few
        return model
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "short"), (4, "d")], "id long, t string").coalesce(1)
    got = {r["id"]: (r["p"], r["p_error"]) for r in hooks.apply_model(rows, load, "t", "p").collect()}
    assert got[1] == ("A", None) and got[4] == ("D", None) and got[2] == (None, "RuntimeError: no 1") and got[3] == (None, "ValueError: 0 answers for 1 texts")


def test_default_vectors_equal_the_table_form(spark):
    df = spark.createDataFrame([(1, "abc abc abd"), (2, ""), (3, "x"), (4, "Déjà Vu 你好吗 你好吗"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in hooks.embed(df, body="text").collect()}
    want = {r["doc_id"]: r["vector"] for r in sim.dense_vectors(sim.hashing_embedding(df)).collect()}
    assert all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], want[k])) and got.keys() == want.keys()
    assert hooks.embed(df.limit(0), body="text").count() == 0


def test_keyword_model():
    model = hooks.keyword_model({"weights": [("a", 2, ("x", "Y")), ("b", 3, ("z",)), ("c", 4, ("x",))]})()
    assert model(["", "xy", "z Z", "xyz", "q"]) == ["", "a", "b", "a", ""]


def test_answers_leave_in_small_batches(spark):
    """Answers of one of Spark's batches come in several and stay with their rows."""
    assert hooks.ROWS < 1200
    df = spark.range(1200).coalesce(1).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE 't' || id END AS original_text")
    got = hooks.apply_model(df, lambda: lambda texts: [t.upper() for t in texts]).collect()
    assert [(r["id"], r["prediction"]) for r in got] == [(i, None if i % 5 == 0 else f"T{i}") for i in range(1200)]
