"""Streams driven to the end over files in three drops; each equals its batch twin."""
import datetime as dt
import os
import time

from pyspark.sql import functions as F

from plaintide.operators import report
from plaintide.sources import feed as fd
from plaintide.streaming import jobs


def drops(df, tmp, n=3, by="id"):
    """Files whose modification order is the drop order."""
    src = os.path.join(tmp, "src")
    for i in range(n):
        df.filter(F.pmod(F.col(by), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(src)
    return src


def drop(df, src):
    """One more file; file times have a resolution of one second, and the source reads by time."""
    time.sleep(1.1)
    df.coalesce(1).write.mode("append").parquet(src)


def stream(spark, src, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def run(writer):
    q = writer.start()
    q.awaitTermination()


def memory(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_ingest_upsert(spark, tmp):
    lines = spark.range(30).select("id", (F.col("id") % 12).cast("string").alias("opinion_id"), F.concat(F.lit("v"), "id").alias("source"))
    src = os.path.join(tmp, "src")
    for i in range(3):
        drop(lines.filter(f"id between {i * 10} and {i * 10 + 9}"), src)
    target, cp = os.path.join(tmp, "t"), os.path.join(tmp, "cp")
    for _ in range(2):  # the second run finds nothing new
        run(jobs.stream_ingest_upsert(stream(spark, src, lines.schema), target, cp))
    got = {r["opinion_id"]: r["source"] for r in jobs.current_table(spark, target).collect()}
    want = {r["opinion_id"]: r["source"] for r in fd.dedupe_last(lines.withColumn("_line", F.col("id"))).collect()}
    assert got == want
    base = spark.createDataFrame([("0", "old", 1), ("99", "old", 1)], "opinion_id string, source string, review_status int")
    m = {r["opinion_id"]: (r["source"], r["review_status"]) for r in jobs.current_table(spark, target, base).collect()}
    assert m["0"] == (want["0"], 1) and m["99"] == ("old", 1) and m["5"][1] == 0


def test_classify(spark, sf, tmp):
    from plaintide.operators.match import batch_classify
    from plaintide.packs import prose
    from plaintide.plans.fixture import opinion
    from plaintide.plans.labelling import clusters, taxonomy, whitelist
    o = opinion(spark, sf).select("id", "opinion_id", "original_text", "review_status")
    fn = lambda d: batch_classify(d, prose.PACK, taxonomy(spark), clusters(spark), whitelist(spark), insight_rules=prose.INSIGHT).select("id", "v3_l1", "v3_l2", "v3_match_type")
    src = drops(o, tmp)
    run(jobs.stream_classify(stream(spark, src, o.schema), fn, os.path.join(tmp, "t"), os.path.join(tmp, "cp")))
    got = {tuple(r) for r in spark.read.parquet(os.path.join(tmp, "t")).select("id", "v3_l1", "v3_l2", "v3_match_type").collect()}
    assert got == {tuple(r) for r in fn(o).collect()}


def test_pending_reflow_releases_once(spark, tmp):
    cols = "id long, opinion_id string, upload_batch string, review_status int, review_l1 string, reflow_synced int, batch_size long"
    one = [(1, "a", "B", 1, "x", 0, 2), (2, "n", "", 1, "x", 0, 0), (3, "s", "C", 1, "x", 1, 1)]
    two = [(4, "b", "B", 0, "", 0, 2)]
    three = [(5, "b", "B", 1, "x", 0, 2), (6, "a", "B", 1, "x", 0, 2)]
    src = os.path.join(tmp, "src")
    for part in (one, two, three):
        drop(spark.createDataFrame(part, cols), src)
    target, cp = os.path.join(tmp, "t"), os.path.join(tmp, "cp")
    for _ in range(2):  # the second run finds nothing new and releases nothing again
        run(jobs.stream_pending_reflow(stream(spark, src, spark.createDataFrame([], cols).schema), target, cp))
    got = sorted((r["upload_batch"], r["opinion_id"], r["batch"]) for r in spark.read.parquet(target + "/released").collect())
    assert got == [("", "n", 0), ("B", "a", 2), ("B", "b", 2)]
    # A late row of a batch that was full before goes alone; the batch's earlier rows are not read out again.
    drop(spark.createDataFrame([(7, "c", "B", 1, "x", 0, 2), (8, "n", "", 1, "x", 0, 0)], cols), src)
    run(jobs.stream_pending_reflow(stream(spark, src, spark.createDataFrame([], cols).schema), target, cp))
    more = sorted((r["upload_batch"], r["opinion_id"], r["batch"]) for r in spark.read.parquet(target + "/released").collect())
    assert more == sorted(got + [("B", "c", 3)])


def replay(cp):
    """Takes back the commit of the last micro-batch, as if the driver had been lost before it."""
    commits = os.path.join(cp, "commits")
    last = str(max(int(f) for f in os.listdir(commits) if f.isdigit()))
    for f in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))


def test_pending_reflow_of_many_batches_with_replays(spark, tmp):
    cols = "id long, opinion_id string, upload_batch string, review_status int, review_l1 string, reflow_synced int, batch_size long"
    size = {"hot": 300, "b/1 ü": 20, "c": 5, "open": 11}
    rows = [(i, f"{b}-{i}", b, 1, "x" if i % 7 else "", int(i % 5 == 0), n) for b, n in size.items() for i in range(n - (b == "open"))]
    rows += [(r[0], r[1], r[2], 1, "x", 0, r[6]) for r in rows if r[0] % 6 == 0]  # reviewed again, now due
    rows += [(i, f"free{i % 4}", None, 1, "x", 0, None) for i in range(9)]
    df = spark.createDataFrame(rows, cols)
    src = os.path.join(tmp, "src")
    for i in range(4):
        drop(df.filter(F.pmod(F.xxhash64("opinion_id", "review_l1"), F.lit(4)) == i), src)
    target, cp = os.path.join(tmp, "t"), os.path.join(tmp, "cp")
    for _ in range(2):
        run(jobs.stream_pending_reflow(stream(spark, src, df.schema), target, cp, buckets=8))
        replay(cp)
    run(jobs.stream_pending_reflow(stream(spark, src, df.schema), target, cp, buckets=8))
    got = [(r["upload_batch"], r["opinion_id"]) for r in spark.read.parquet(target + "/released").collect()]
    want = {(r["upload_batch"], r["opinion_id"]) for r in jobs.releasable(jobs.reviewed_rows(df)).collect()}
    assert sorted(got) == sorted(want) and {b for b, _ in want} == {"", "hot", "b/1 ü", "c"}


def test_daily_counts_drop_late_rows(spark, tmp):
    day = lambda d: dt.datetime(2024, 1, d, 10)
    src = os.path.join(tmp, "src")
    for part in ([(day(1), "x"), (day(1), "x"), (day(2), "y")], [(day(10), "x")], [(day(11), "x")], [(day(1), "x"), (day(20), "x")]):
        drop(spark.createDataFrame(part, "ts timestamp, l2 string"), src)
    s = stream(spark, src, spark.createDataFrame([], "ts timestamp, l2 string").schema)
    got = {(str(r["day"]), r["l2"]): r["n"] for r in memory(spark, jobs.stream_daily_counts(s), "daily").collect()}
    assert got[("2024-01-01", "x")] == 2 and got[("2024-01-02", "y")] == 1 and got[("2024-01-10", "x")] == 1


def test_spikes(spark, tmp):
    base = dt.datetime(1970, 1, 1) + dt.timedelta(days=7 * 2800)
    counts = [2, 2, 2, 2, 8, 1]
    rows = [(base + dt.timedelta(days=7 * w, hours=i), "x") for w, n in enumerate(counts) for i in range(n)] + [(base + dt.timedelta(days=7 * 9), "z")]
    df = spark.createDataFrame(rows, "ts timestamp, l2 string")
    src = os.path.join(tmp, "src")
    df.orderBy("ts").coalesce(1).write.parquet(src)
    target = os.path.join(tmp, "t")
    run(jobs.stream_l2_spike(stream(spark, src, df.schema), target, os.path.join(tmp, "cp")))
    got = spark.read.parquet(target + "/spikes").collect()
    assert [(r["l2"], r["current"], r["avg"], r["pct_change"]) for r in got] == [("x", 8, 2.0, 300.0)]


def test_spikes_over_many_drops_equal_the_batch_form(spark, tmp):
    base = dt.datetime(1970, 1, 1) + dt.timedelta(days=7 * 2800)
    count = lambda k, w: (w * (k + 3) * 7 + k) % 9 + (6 if (w + k) % 6 == 0 else 0)
    rows = [(base + dt.timedelta(days=7 * w, minutes=i), f"k{k}" if k else None) for w in range(14) for k in range(4) if (w + k) % 5 for i in range(count(k, w))]
    df = spark.createDataFrame(rows + [(base + dt.timedelta(days=7 * 30), "end")], "ts timestamp, l2 string")
    src = os.path.join(tmp, "src")
    for lo, hi in ((0, 3), (3, 4), (4, 9), (9, 40)):
        drop(df.filter((F.col("ts") >= base + dt.timedelta(days=7 * lo)) & (F.col("ts") < base + dt.timedelta(days=7 * hi))), src)
    target, cp = os.path.join(tmp, "t"), os.path.join(tmp, "cp")
    run(jobs.stream_l2_spike(stream(spark, src, df.schema), target, cp))
    replay(cp)
    run(jobs.stream_l2_spike(stream(spark, src, df.schema), target, cp))
    got = sorted(tuple(r) for r in spark.read.parquet(target + "/spikes").drop("batch").fillna("-", ["l2"]).collect())
    want = sorted(tuple(r) for r in jobs.spikes(jobs.window_counts(df, 7).filter("l2 IS NULL OR l2 <> 'end'"), 7).select(
        "start", "l2", "current", "avg", "pct_change").fillna("-", ["l2"]).collect())
    assert got == want and len(want) > 5


def test_dedupe(spark, tmp):
    rows = [(1, "same text", dt.datetime(2024, 1, 1)), (2, "same  text", dt.datetime(2024, 1, 2)), (3, "other", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id long, original_text string, ts timestamp")
    src = drops(df, tmp)
    out = memory(spark, jobs.stream_dedupe(stream(spark, src, df.schema)), "dedup")
    assert out.select("fingerprint").distinct().count() == out.count() == 2


def test_repeat_contact(spark, tmp):
    d = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([(1, "V1", d(0)), (2, "V1", d(5)), (3, "V2", d(1)), (4, "", d(1)), (5, "V3", d(0)), (6, "V3", d(50)), (7, "Z", d(200))], "id long, vin string, ts timestamp")
    src = os.path.join(tmp, "src")
    df.coalesce(1).write.parquet(src)
    got = memory(spark, jobs.stream_repeat_contact(stream(spark, src, df.schema)), "repeat").collect()
    assert [(r["entity"], r["contacts"]) for r in got] == [("V1", 2)]
