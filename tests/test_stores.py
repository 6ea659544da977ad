"""Readers, writers and keyed stores: round trips."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from plaintide.operators import insight
from plaintide.plans.fixture import opinion
from plaintide.sources import feed as fd, stores


def write(path, body):
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    return path


def test_csv_feed(spark, tmp):
    p = write(os.path.join(tmp, "feed.csv"), "﻿舆情编号,舆情中文,渠道,车架号,二级标签,三级标签\n1,a\n2,b,web,LJU1,L2,L3\n ,x,app,,,\n2,c,web,,L2,\n")
    raw = fd.scan_csv(spark, p)
    rows = fd.dedupe_last(fd.shape_feed(raw)).orderBy("opinion_id").collect()
    assert [(r["opinion_id"], r["original_text"], r["model_keyword"]) for r in rows] == [("1", "a", ""), ("2", "c", "L2")]
    assert fd.blank_ids(fd.shape_feed(raw)).first()[0] == 1


def test_csv_quotes_and_missing_id(spark, tmp):
    p = write(os.path.join(tmp, "q.csv"), '舆情编号,舆情中文\n7,"line1\nline2, ""q"""\n')
    assert fd.shape_feed(fd.scan_csv(spark, p, multi_line=True)).first()["original_text"] == 'line1\nline2, "q"'
    with pytest.raises(ValueError):
        fd.scan_csv(spark, write(os.path.join(tmp, "x.csv"), "a,b\n1,2\n"))


def test_csv_feed_of_several_files(spark, tmp):
    """The newest file's line wins whatever its name or size; a file with another header is refused."""
    d = os.path.join(tmp, "feed")
    os.makedirs(d)
    late = write(os.path.join(d, "a.csv"), "舆情编号,舆情中文\n1,late\n")
    early = write(os.path.join(d, "b.csv"), "舆情编号,舆情中文\n" + "".join(f"{i},early\n" for i in range(1, 400)))
    os.utime(early, (1_700_000_000, 1_700_000_000))
    os.utime(late, (1_700_000_100, 1_700_000_100))
    rows = {r["opinion_id"]: r["original_text"] for r in fd.dedupe_last(fd.shape_feed(fd.scan_csv(spark, d))).collect()}
    assert len(rows) == 399 and rows["1"] == "late" and rows["2"] == "early"
    write(os.path.join(d, "c.csv"), "舆情中文,舆情编号\nx,9\n")
    with pytest.raises(Exception, match="(?i)header"):
        fd.scan_csv(spark, d).collect()


def test_upsert_keeps_reviews_and_updates_every_row_of_an_id(spark):
    t = spark.createDataFrame([(1, "A", "old", 1), (2, "A", "old", 0), (3, "B", "old", 1)], "id long, opinion_id string, source string, review_status int")
    f = spark.createDataFrame([("A", "new"), ("C", "new")], "opinion_id string, source string")
    got = {(r["opinion_id"], r["id"]): (r["source"], r["review_status"], r["merge_action"]) for r in fd.upsert(t, f).collect()}
    assert got == {("A", 1): ("new", 1, "update"), ("A", 2): ("new", 0, "update"), ("B", 3): ("old", 1, "keep"), ("C", None): ("new", 0, "insert")}


def test_yearly_archive_of_one_batch_keeps_the_year(spark, sf, tmp):
    o = opinion(spark, sf)
    path = os.path.join(tmp, "archive")
    stores.write_yearly_archive(o, path)
    n = spark.read.parquet(path).count()
    stores.write_yearly_archive(o, path, batch="20240201_1_1")
    assert spark.read.parquet(path).count() == n > 0
    assert [os.path.basename(p) for p in glob.glob(path + "/年度=*")] == ["年度=2024"]


def test_monthly_archive_round_trip(spark, sf, tmp):
    o = opinion(spark, sf).select("create_time", "original_text", "opinion_id", F.col("id").alias("_line"))
    m = stores.monthly_archive_merge(o.limit(0), o)
    path = os.path.join(tmp, "m")
    stores.write_monthly_archive(m, path)
    again = stores.monthly_archive_merge(spark.read.parquet(path).drop("year", "month").select(*o.columns), o)
    assert again.count() == m.count() == spark.read.parquet(path).count()


def test_json_logs(spark, sf, tmp):
    o = opinion(spark, sf)
    lib = o.limit(0).select(F.col("opinion_id").alias("舆情编号"))
    rows = stores.audit_rows(o.filter("review_status = 1"), lib, "r", "confirm", "t")
    path = os.path.join(tmp, "audit")
    stores.append_audit_log(rows, path)
    stores.append_audit_log(rows, path)
    assert spark.read.json(path).count() == 2 * rows.count()
    m = spark.createDataFrame([(f"2024-01-{i:02d}", i) for i in range(1, 11)], "timestamp string, n int")
    stores.append_route_metrics(m, os.path.join(tmp, "metrics"))
    tail = stores.route_metrics_tail(spark.read.json(os.path.join(tmp, "metrics")), 3).collect()
    assert [r["n"] for r in tail] == [10, 9, 8]


def test_vector_store_reads_by_model_and_id(spark):
    a = spark.createDataFrame([("1", "m1", [1.0], "a"), ("2", "m1", [2.0], "a")], "opinion_id string, model string, vector array<double>, updated_at string")
    b = spark.createDataFrame([("2", "m2", [3.0], "b")], a.schema)
    s = stores.upsert_vectors(a, b)
    assert {(r["opinion_id"], r["model"]) for r in s.collect()} == {("1", "m1"), ("2", "m2")}
    ids = spark.createDataFrame([("2",)], "opinion_id string")
    assert stores.read_vectors(s, "m2", ids).count() == 1 and stores.read_vectors(s, "m1", ids).count() == 0


def test_weekly_reports_keep_twelve(spark, tmp):
    r = spark.createDataFrame([(f"2024/W{i:02d}!", f'{{"total": {i}, "summary": "s"}}', i) for i in range(1, 20)], "week string, body string, saved_at int")
    got = stores.list_weekly_reports(r).collect()
    assert len(got) == 12 and got[0]["week"] == "2024W19" and got[0]["total"] == "19"
    stores.write_weekly_reports(r, os.path.join(tmp, "w"))
    assert spark.read.json(os.path.join(tmp, "w")).count() == 12


def test_training_rows_are_json(spark, sf, tmp):
    import json
    t = stores.training_rows(opinion(spark, sf))
    stores.write_training_rows(t, os.path.join(tmp, "t"))
    rows = spark.read.json(os.path.join(tmp, "t")).collect()
    assert rows and all(set(json.loads(r["completion"])) == {"l1", "l2"} for r in rows)
