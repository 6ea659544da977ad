"""Batch twins of the streams: the same operators over the whole table, where a watermark drops nothing."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.functions.dates import event_time
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion
from plaintide.plans.registry import query
from plaintide.streaming import jobs

ROWS = f"ev AS (SELECT *, {q.EVENT_TS} AS ts, v3_l2 AS k FROM opinion)"
WEEK = 7 * 86_400


def rows(spark, d):
    return opinion(spark, d).withColumns({"ts": event_time(), "l2": F.col("v3_l2")})


@query("stream_daily_counts", f"WITH {ROWS} SELECT CAST(ts AS DATE) AS day, k AS l2, count(*) AS n FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return jobs.stream_daily_counts(rows(spark, d))


@query("stream_l2_spike", f"""
WITH {ROWS}, c AS (SELECT CAST(floor(epoch(ts) / {WEEK}) AS BIGINT) AS w, k AS l2, count(*) AS n FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT a.w, a.l2, a.n AS current, sum(coalesce(b.n, 0)) / 4.0 AS avg FROM c a LEFT JOIN c b ON b.l2 = a.l2 AND b.w BETWEEN a.w - 4 AND a.w - 1 GROUP BY 1, 2, 3)
SELECT CAST(to_timestamp(w * {WEEK}) AS TIMESTAMP) AS start, l2, current::BIGINT AS current, avg::DOUBLE AS avg, round((current - avg) / greatest(avg, 1.0) * 100, 1)::DOUBLE AS pct_change
FROM p WHERE current >= 2 AND avg > 0 AND current >= avg * 1.2""")
def _(spark, d):
    closed = jobs.window_counts(rows(spark, d).filter("ts IS NOT NULL"), 7)
    return jobs.spikes(closed, 7, min_count=2, factor=1.2)


@query("stream_repeat_contact", f"""
WITH {ROWS}, a AS (SELECT vin AS entity, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY vin ORDER BY ts, id) + INTERVAL 20 DAY THEN 0 ELSE 1 END AS fresh, id FROM ev WHERE ts IS NOT NULL AND {q.s('vin')} <> ''),
 b AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT entity, count(*) AS contacts, min(ts) AS first, max(ts) AS last FROM b GROUP BY entity, s HAVING count(*) >= 2""")
def _(spark, d):
    return jobs.stream_repeat_contact(rows(spark, d).filter("ts IS NOT NULL"), gap="20 days")


@query("stream_pending_reflow", f"""
WITH r AS (SELECT concat({q.s('upload_batch')}, '-', CAST(id % 400 AS VARCHAR)) AS ub, {q.s('opinion_id')} AS oid, review_status, {q.s('review_l1')} <> '' AND coalesce(reflow_synced, 0) < 1 AS due FROM opinion),
 z AS (SELECT ub, count(DISTINCT oid) AS size, count(DISTINCT oid) FILTER (WHERE review_status = 1) AS n FROM r GROUP BY 1)
SELECT DISTINCT r.ub AS upload_batch, oid AS opinion_id FROM r JOIN z ON z.ub = r.ub WHERE r.review_status = 1 AND due AND (r.ub = '' OR n >= size)""")
def _(spark, d):
    o = opinion(spark, d).withColumn("upload_batch", F.concat("upload_batch", F.lit("-"), F.pmod("id", F.lit(400)).cast("string")))
    sizes = o.groupBy("upload_batch").agg(F.count_distinct("opinion_id").alias("batch_size"))
    return jobs.releasable(jobs.reviewed_rows(o.join(sizes, "upload_batch")))
