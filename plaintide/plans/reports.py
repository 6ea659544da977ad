"""Dashboards, monthly reports and period statistics as queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plaintide.functions import labels
from plaintide.functions.dates import event_time
from plaintide.operators import keywords as kwd, report
from plaintide.plans import duck as q
from plaintide.plans.desk import BATCHED, READY_SQL, batched, with_score
from plaintide.plans.fixture import AS_OF, AS_OF_SQL, opinion, table
from plaintide.plans.registry import query
from plaintide.plans.scalars import legacy_sql, stats_day_sql, tokens_sql

BOTH = f"(review_status = 1 AND {q.s('review_l1')} <> '' AND {q.s('v3_l1')} <> '')"
RAWEQ = f"{q.s('review_l1')} = {q.s('v3_l1')}"


@query("kpi_snapshot", f"""
WITH a AS (SELECT count(*) AS total, count(*) FILTER (WHERE review_status = 1) AS reviewed, count(*) FILTER (WHERE coalesce(review_status,0) <> 1) AS pending,
  count(*) FILTER (WHERE regexp_matches(create_time, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(substr(create_time,1,10) AS DATE) >= {AS_OF_SQL} - 7) AS new_7d,
  count(*) FILTER (WHERE {BOTH} AND {RAWEQ}) AS l1_correct, count(*) FILTER (WHERE {BOTH}) AS l1_total FROM opinion)
SELECT *, round(l1_correct / greatest(l1_total, 1) * 100, 2) AS l1_accuracy FROM a""")
def _(spark, d):
    return report.kpi_snapshot(opinion(spark, d), AS_OF)


@query("l2_anomalies", f"""
WITH r AS (SELECT *, {q.s('review_l2')} AS l2, date_diff('day', {q.ISO_DAY}, {AS_OF_SQL}) AS age FROM opinion WHERE review_status = 1 AND {q.s('review_l2')} <> ''),
 p AS (SELECT *, age // 10 AS period FROM r WHERE age >= 0 AND age // 10 BETWEEN 0 AND 4),
 c AS (SELECT l2, count(*) FILTER (WHERE period = 0) AS current, count(*) FILTER (WHERE period > 0) / 4.0::DOUBLE AS avg FROM p GROUP BY l2),
 h AS (SELECT *, round((current - avg) / greatest(avg, 1.0) * 100, 1) AS pct_change FROM c WHERE current >= 1 AND avg > 0 AND current >= avg * 0.2
       ORDER BY pct_change DESC, current DESC, l2 LIMIT 5),
 raw AS (SELECT l2, coalesce(nullif({q.js('v3_label_meta', 'l3_phrases')}, ''), {q.js('v3_label_meta', 'l3')}, '') AS x FROM p WHERE period = 0),
 ph AS (SELECT l2, unnest(list_slice(list_filter(list_transform(string_split(x, ','), lambda v: trim(v)), lambda v: length(v) BETWEEN 2 AND 18), 1, 8)) AS phrase FROM raw),
 pc AS (SELECT l2, phrase, count(*) AS n FROM ph GROUP BY l2, phrase),
 pr AS (SELECT *, row_number() OVER (PARTITION BY l2 ORDER BY n DESC, phrase) AS rn FROM pc),
 best AS (SELECT l2, string_agg(phrase || ':' || n, '|' ORDER BY rn) AS phrases FROM pr WHERE rn <= 3 GROUP BY l2)
SELECT h.l2, current, round(avg, 1) AS avg_4p, pct_change, coalesce(phrases, '') AS phrases FROM h LEFT JOIN best ON h.l2 = best.l2""")
def _(spark, d):
    # The fixture has no burst, so the thresholds are lowered until rows remain.
    return report.l2_anomalies(opinion(spark, d), AS_OF, days=10, min_count=1, factor=0.2)


@query("daily_accuracy_trend", f"""
WITH s AS (SELECT unnest(generate_series({AS_OF_SQL} - 29, {AS_OF_SQL}, INTERVAL 1 DAY))::DATE AS day),
 r AS (SELECT {q.ISO_DAY} AS day, count(*) AS n, count(*) FILTER (WHERE {RAWEQ}) AS ok FROM opinion WHERE {BOTH} GROUP BY 1)
SELECT strftime(s.day, '%Y-%m-%d') AS full_date, strftime(s.day, '%m-%d') AS date, round(coalesce(ok,0) / greatest(coalesce(n,0),1) * 100, 2) AS accuracy,
  coalesce(n,0) AS reviewed_count FROM s LEFT JOIN r ON s.day = r.day""")
def _(spark, d):
    return report.daily_accuracy_trend(opinion(spark, d), AS_OF, 30)


@query("issue_status_by_l2", f"""
SELECT review_l2 AS l2, count(*) AS total, count(*) FILTER (WHERE coalesce(reflow_synced,0) >= 1) AS resolved,
  count(*) FILTER (WHERE review_status = 1 AND coalesce(reflow_synced,0) < 1) AS in_progress, count(*) FILTER (WHERE coalesce(review_status,0) <> 1) AS pending
FROM opinion WHERE {q.s('review_l2')} <> '' GROUP BY 1 ORDER BY total DESC, l2 LIMIT 20""")
def _(spark, d):
    return report.issue_status_by_l2(opinion(spark, d))


JUDGED = f"""jd AS (SELECT *, {q.canon_b('review_l1')} AS h1, CASE WHEN {q.canon_b('review_l1')} = '非问题' THEN '' ELSE {q.s('review_l2')} END AS h2,
  {q.canon_b(q.ACC_L1)} AS m1, CASE WHEN {q.canon_b(q.ACC_L1)} = '非问题' THEN '' ELSE {q.ACC_L2} END AS m2 FROM opinion)"""
L2OK = "(h1 IN ('产品质量类','服务类','体验需求类') AND m1 = h1 AND h2 <> '' AND m2 <> '')"


@query("classification_accuracy", f"""
WITH {JUDGED}, a AS (SELECT count(*) FILTER (WHERE m1 <> '') AS l1_total, count(*) FILTER (WHERE m1 <> '' AND m1 = h1) AS l1_correct,
  count(*) FILTER (WHERE {L2OK}) AS l2_total, count(*) FILTER (WHERE {L2OK} AND h2 = m2) AS l2_correct FROM jd WHERE review_status = 1 AND h1 <> '')
SELECT *, {q.pct('l1_correct', 'l1_total')} AS l1_accuracy, {q.pct('l2_correct', 'l2_total')} AS l2_accuracy FROM a""")
def _(spark, d):
    return report.classification_accuracy(opinion(spark, d))


@query("dashboard_stats", f"""
WITH {JUDGED},
 f AS (SELECT coalesce(nullif(h1,''), m1) AS l1, coalesce(nullif(h2,''), m2) AS l2, {stats_day_sql('create_time', 'reviewed_at', 'created_at')} AS day, *,
    coalesce(v3_confidence, try_cast({q.js('v3_label_meta', 'confidence')} AS DOUBLE)) AS conf FROM jd
    WHERE replace(replace({q.s('create_time')}, '/', '-'), '.', '-') >= '2022-06-30'),
 s AS (SELECT strftime(unnest(generate_series({AS_OF_SQL} - 29, {AS_OF_SQL}, INTERVAL 1 DAY)), '%Y-%m-%d') AS item)
SELECT 'total' AS metric, 'total' AS item, count(*) AS value FROM f UNION ALL
SELECT 'total', 'reviewed_count', count(*) FROM f WHERE review_status = 1 UNION ALL
SELECT 'total', 'archived_count', count(*) FROM f WHERE reflow_synced >= 2 UNION ALL
SELECT 'total', 'pending_review', count(*) FROM f WHERE review_status = 2 OR (review_status <> 1 AND conf < 0.52) UNION ALL
SELECT 'total', 'l1_eval_count', count(*) FROM f WHERE review_status = 1 AND h1 <> '' AND m1 <> '' UNION ALL
SELECT 'total', 'l2_eval_count', count(*) FROM f WHERE review_status = 1 AND {L2OK} UNION ALL
SELECT 'total', 'l1_correct', count(*) FROM f WHERE review_status = 1 AND h1 <> '' AND m1 <> '' AND h1 = m1 UNION ALL
SELECT 'total', 'l2_correct', count(*) FROM f WHERE review_status = 1 AND {L2OK} AND h2 = m2 UNION ALL
SELECT 'total', 'new_7d', count(*) FROM f WHERE day BETWEEN '2024-06-24' AND '2024-06-30' UNION ALL
SELECT 'l1_pie', l1, count(*) FROM f WHERE l1 <> '' GROUP BY l1 UNION ALL
SELECT * FROM (SELECT 'l2_top5', l2, count(*) AS c FROM f WHERE l2 <> '' GROUP BY l2 ORDER BY c DESC, l2 LIMIT 5) UNION ALL
SELECT 'trend_30d', s.item, (SELECT count(*) FROM f WHERE f.day = s.item) FROM s""")
def _(spark, d):
    return report.dashboard_stats(with_score(opinion(spark, d)), AS_OF)


@query("class_share", f"""
WITH r AS (SELECT {legacy_sql('review_l1')} AS c FROM opinion WHERE review_status = 1)
SELECT c AS class_name, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM r), 2) AS percentage FROM r
WHERE c IN ('质量问题','营销服务','体验需求','咨询','非问题') GROUP BY c""")
def _(spark, d):
    return report.class_share(opinion(spark, d), labels.legacy_class("review_l1"))


@query("yearly_summary", """
SELECT substr(create_time,1,4) AS year, substr(create_time,1,7) AS year_month, review_status, '未填写' AS review_note, count(*) AS count, max(create_time) AS latest_time
FROM opinion WHERE review_status = 1 AND substr(create_time,1,4) = '2024' GROUP BY 1,2,3,4""")
def _(spark, d):
    return report.yearly_summary(opinion(spark, d), "2024")


@query("upload_batches", f"""
SELECT upload_batch, count(*) AS count, max(id) AS sort_max_id FROM {BATCHED} WHERE trim(upload_batch) <> '' GROUP BY 1""")
def _(spark, d):
    return report.upload_batches(batched(opinion(spark, d)))


WIN = ("2024-01-15", "2024-07-10")
LW = f"""lw AS (SELECT *, {q.MONTH} AS month_key, {q.REP_L1} AS l1, {q.REP_L2} AS l2 FROM opinion WHERE {q.DAY} BETWEEN '{WIN[0]}' AND '{WIN[1]}')"""
SPINE = "sp AS (SELECT strftime(unnest(generate_series(DATE '2024-01-01', DATE '2024-07-01', INTERVAL 1 MONTH)), '%Y-%m') AS month_key)"


@query("monthly_overview", f"""
WITH {LW}, {SPINE} SELECT sp.month_key, count(*) FILTER (WHERE l1 = '产品质量类') AS product, count(*) FILTER (WHERE l1 = '服务类') AS service
FROM sp LEFT JOIN lw ON sp.month_key = lw.month_key GROUP BY 1""")
def _(spark, d):
    return report.monthly_overview(opinion(spark, d), *WIN)


@query("report_cube", f"""
WITH {LW}
SELECT 'month_l1' AS level, month_key, l1, NULL AS l2, count(*) AS n FROM lw WHERE l1 <> '' GROUP BY month_key, l1 UNION ALL
SELECT 'month_l1_l2', month_key, l1, l2, count(*) FROM lw WHERE l1 <> '' AND l2 <> '' GROUP BY month_key, l1, l2 UNION ALL
SELECT 'l1_l2', NULL, l1, l2, count(*) FROM lw WHERE l1 <> '' AND l2 <> '' GROUP BY l1, l2 UNION ALL
SELECT 'month_l2', month_key, NULL, l2, count(*) FROM lw WHERE l2 <> '' GROUP BY month_key, l2 UNION ALL
SELECT 'l2', NULL, NULL, l2, count(*) FROM lw WHERE l2 <> '' GROUP BY l2""")
def _(spark, d):
    return report.report_cube(opinion(spark, d), *WIN)


@query("nth_subtag_trend", f"""
WITH {LW}, {SPINE}, tot AS (SELECT l1, l2, count(*) AS c FROM lw WHERE l1 IN ('产品质量类','服务类') AND l2 <> '' GROUP BY 1,2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY c DESC, l2) AS rn FROM tot),
 tag AS (SELECT l1, max_by(l2, rn) AS l2_tag FROM rk WHERE rn IN (1, 2) GROUP BY l1),
 ax AS (SELECT month_key, x.l1, coalesce(l2_tag, '(无二级)') AS l2_tag FROM sp CROSS JOIN (VALUES ('产品质量类'),('服务类')) x(l1) LEFT JOIN tag ON tag.l1 = x.l1)
SELECT ax.l1, ax.l2_tag, ax.month_key, count(lw.id) AS n FROM ax LEFT JOIN lw ON lw.l1 = ax.l1 AND lw.l2 = ax.l2_tag AND lw.month_key = ax.month_key GROUP BY 1,2,3""")
def _(spark, d):
    return report.nth_subtag_trend(opinion(spark, d), *WIN, k=2)


@query("top_subtag_monthly", f"""
WITH {LW}, {SPINE}, tot AS (SELECT l2, count(*) AS total FROM lw WHERE l2 <> '' GROUP BY 1 ORDER BY total DESC, l2 LIMIT 3)
SELECT tot.l2, total, sp.month_key, count(lw.id) AS n FROM tot CROSS JOIN sp LEFT JOIN lw ON lw.l2 = tot.l2 AND lw.month_key = sp.month_key GROUP BY 1,2,3""")
def _(spark, d):
    return report.top_subtag_monthly(opinion(spark, d), *WIN, top=3)


@query("single_issue_trend", f"""
WITH {LW}, {SPINE}, m AS (SELECT * FROM lw WHERE l1 = '服务类' AND contains(lower(concat_ws(' ', original_text, review_l3, model_keyword)), 'tion'))
SELECT sp.month_key, count(m.id) AS n FROM sp LEFT JOIN m ON m.month_key = sp.month_key GROUP BY 1""")
def _(spark, d):
    return report.single_issue_trend(opinion(spark, d), *WIN, l1="销售服务", keyword="TION")


SUM_L1 = q.s("coalesce(nullif(review_l1,''), model_class)")
SUM_L2 = q.kw1("coalesce(nullif(review_l2,''), model_keyword)")
CUR = f"cur AS (SELECT *, {SUM_L1} AS l1, {SUM_L2} AS l2 FROM opinion WHERE {q.DAY} BETWEEN '2024-05-01' AND '2024-06-30')"
PREV = f"prv AS (SELECT *, {SUM_L1} AS l1, {SUM_L2} AS l2 FROM opinion WHERE {q.DAY} BETWEEN '2024-03-01' AND '2024-04-30')"


def periods(spark, d):
    from plaintide.operators.filters import report_window
    o = opinion(spark, d)
    return report_window(o, "2024-05-01", "2024-06-30"), report_window(o, "2024-03-01", "2024-04-30")


@query("volume_stats", f"""
WITH {CUR}, {PREV}, t AS (SELECT (SELECT count(*) FROM cur) AS a, (SELECT count(*) FROM prv) AS b)
SELECT 'total' AS metric, 'total' AS item, a AS count, CASE WHEN b > 0 THEN round((a - b) / b * 100, 1) ELSE 0.0 END AS share FROM t UNION ALL
SELECT 'by_l1', l1, count(*), round(count(*) / (SELECT a FROM t) * 100, 1) FROM cur WHERE l1 <> '' GROUP BY l1 UNION ALL
SELECT * FROM (SELECT 'top_l2', l2, count(*) AS c, round(count(*) / (SELECT a FROM t) * 100, 1) FROM cur WHERE l2 <> '' GROUP BY l2 ORDER BY c DESC, l2 LIMIT 10)""")
def _(spark, d):
    return report.volume_stats(*periods(spark, d))


@query("l1_trends", f"""
WITH {CUR}, {PREV}, a AS (SELECT l1, count(*) AS c FROM cur WHERE l1 <> '' AND l1 <> '咨询' GROUP BY 1), b AS (SELECT l1, count(*) AS c FROM prv WHERE l1 <> '' AND l1 <> '质量问题' GROUP BY 1),
 j AS (SELECT coalesce(a.l1, b.l1) AS l1, coalesce(a.c, 0) AS cur, coalesce(b.c, 0) AS prev FROM a FULL JOIN b ON a.l1 = b.l1),
 k AS (SELECT *, CASE WHEN prev > 0 THEN round((cur - prev) / prev * 100, 1) WHEN cur > 0 THEN 100.0 ELSE 0.0 END AS change_pct FROM j)
SELECT *, CASE WHEN change_pct > 5 THEN 'up' WHEN change_pct < -5 THEN 'down' ELSE 'flat' END AS direction FROM k""")
def _(spark, d):
    cur, prev = periods(spark, d)
    return report.l1_trends(cur.filter(report.summary_l1() != "咨询"), prev.filter(report.summary_l1() != "质量问题"))


@query("representative_quotes", f"""
WITH {CUR}, tot AS (SELECT l2, count(*) AS count FROM cur WHERE l2 <> '' GROUP BY 1 ORDER BY count DESC, l2 LIMIT 3),
 c AS (SELECT id, cur.l2, tot.count, l1, source, {q.s('original_text')} AS t FROM cur JOIN tot ON cur.l2 = tot.l2),
 g AS (SELECT *, regexp_replace(regexp_replace(t, '1[3-9]\\d{{9}}', '138****0000', 'g'), '(?i)[A-HJ-NPR-Z0-9]{{17}}', 'VIN****', 'g') AS quote FROM c WHERE length(t) BETWEEN 20 AND 250),
 s AS (SELECT *, (CASE WHEN contains(quote,'the') THEN 2 ELSE 0 END) + (CASE WHEN contains(quote,'eau') THEN 2 ELSE 0 END) + least(length(quote) / 50, 3.0) AS score FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY l2 ORDER BY score DESC, length(t), id) AS rn FROM s)
SELECT l2 AS issue, count, substr(quote, 1, 200) AS quote, l1, source FROM r WHERE rn = 1""")
def _(spark, d):
    return report.representative_quotes(periods(spark, d)[0], signals=("the", "eau"))


@query("batch_status", f"""
SELECT upload_batch, count(*) AS batch_total, count(*) FILTER (WHERE review_status = 1) AS confirmed, count(*) FILTER (WHERE {BOTH}) AS acc_total,
  count(*) FILTER (WHERE {BOTH} AND {RAWEQ}) AS acc_correct, count(*) - count(*) FILTER (WHERE review_status = 1) AS unconfirmed,
  count(*) = count(*) FILTER (WHERE review_status = 1) AS is_complete,
  round(count(*) FILTER (WHERE {BOTH} AND {RAWEQ}) / greatest(count(*) FILTER (WHERE {BOTH}), 1) * 100, 2) AS accuracy_l1_pct
FROM {BATCHED} WHERE trim(upload_batch) <> '' GROUP BY 1""")
def _(spark, d):
    return report.batch_status(batched(opinion(spark, d)))


@query("batch_readiness", f"WITH {READY_SQL} SELECT upload_batch, state, count(*) AS n FROM st GROUP BY 1, 2")
def _(spark, d):
    return report.batch_readiness(opinion(spark, d))


@query("reflow_health", """
WITH a AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE review_status = 1) AS reviewed, count(*) FILTER (WHERE reflow_synced = 0 AND review_status = 1) AS not_reflowed,
  count(*) FILTER (WHERE reflow_synced = 1) AS reflowed, count(*) FILTER (WHERE reflow_synced = 2) AS archived, count(*) FILTER (WHERE reflow_synced = -1) AS failed,
  count(*) FILTER (WHERE reflow_synced = 0 AND review_status = 1 AND trim(coalesce(reviewed_at,'')) <> '' AND reviewed_at < '2024-06-29 00:00:00') AS stale FROM opinion)
SELECT *, concat_ws(',', CASE WHEN failed > 0 THEN 'failed' END, CASE WHEN stale > 0 THEN 'stale' END, 'queue') AS issues FROM a""")
def _(spark, d):
    return report.reflow_health(opinion(spark, d), dt.datetime(2024, 6, 30), queue=60)


@query("daily_threshold_alerts", f"""
SELECT model_class AS label, count(*) AS n FROM opinion WHERE CAST({q.EVENT_TS} AS DATE) = DATE '2024-03-15' GROUP BY 1 HAVING count(*) >= 2 AND model_class <> ''""")
def _(spark, d):
    return report.daily_threshold_alerts(opinion(spark, d), "model_class", event_time().cast("date"), dt.date(2024, 3, 15), 2)


@query("archive_statistics", f"""
WITH b AS (SELECT review_status, v3_confidence AS confidence, model_class, {legacy_sql('review_l1')} AS manual_class, {legacy_sql('v3_l1')} AS final_class FROM opinion WHERE id % 3 <> 0
  UNION ALL SELECT review_status, v3_confidence, model_class, NULL, {legacy_sql('v3_l1')} FROM opinion WHERE id % 3 = 0),
 a AS (SELECT count(*) AS total, count(*) FILTER (WHERE review_status = 1) AS reviewed, count(*) FILTER (WHERE coalesce(review_status,0) <> 1) AS pending,
  count(*) FILTER (WHERE confidence < 0.52) AS low_confidence,
  count(*) FILTER (WHERE CASE WHEN coalesce(manual_class,'') <> '' THEN model_class = manual_class ELSE coalesce(final_class,'') <> '' AND model_class = final_class END) AS correct FROM b)
SELECT *, round(correct / greatest(total, 1) * 100, 2) AS accuracy FROM a""")
def _(spark, d):
    o = opinion(spark, d).select("id", "review_status", F.col("v3_confidence").alias("confidence"), "model_class",
                                 labels.legacy_class("review_l1").alias("manual_class"), labels.legacy_class("v3_l1").alias("final_class"))
    return report.archive_statistics(o.filter(F.col("id") % 3 != 0), o.filter(F.col("id") % 3 == 0).drop("manual_class"))


@query("time_class_counts", f"""
WITH t AS (SELECT strftime(CAST({q.EVENT_TS} AS DATE), '%G-W%V') AS bucket, v3_l1 AS label FROM opinion)
SELECT bucket, label, count(*) AS n FROM t WHERE bucket IS NOT NULL AND label <> '' GROUP BY 1, 2""")
def _(spark, d):
    return report.time_class_counts(opinion(spark, d), "v3_l1", event_time().cast("date"), "week")


@query("keyword_stats", f"""
WITH k AS (SELECT DISTINCT lang AS label, unnest({tokens_sql('text')}) AS w FROM documents)
SELECT label, count(*) AS words FROM k GROUP BY 1 UNION ALL SELECT '*', count(*) FROM k""", needs_opinion=False)
def _(spark, d):
    from plaintide.functions.text import keyword_tokens
    k = table(spark, d, "documents").select(F.col("lang").alias("label"), F.explode(keyword_tokens("text")).alias("w")).distinct()
    return kwd.keyword_stats(k)
