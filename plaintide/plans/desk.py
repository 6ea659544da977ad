"""Review-desk filters, windows and decisions as queries."""
from __future__ import annotations


from pyspark.sql import functions as F

from plaintide.functions import labels
from plaintide.functions.dates import event_time, previous_window
from plaintide.operators import filters, review
from plaintide.plans import duck as q
from plaintide.plans.fixture import AS_OF, opinion
from plaintide.plans.registry import query
from plaintide.plans.scalars import tokens_sql

# Batches renamed so that some are fully reviewed and some rows have none.
BATCHED = """(SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN '' WHEN review_status = 1 THEN concat('R', cast(id % 4 AS string)) ELSE upload_batch END AS upload_batch)
  FROM opinion)"""


def batched(o):
    return o.withColumn("upload_batch", F.when(F.col("id") % 10 == 0, "").when(
        F.col("review_status") == 1, F.concat(F.lit("R"), (F.col("id") % 4).cast("string"))).otherwise(F.col("upload_batch")))


def with_score(o):
    return o.withColumn("match_score", F.lit(None).cast("double"))


@query("review_list", f"""
WITH m AS (SELECT * FROM opinion WHERE (original_text ILIKE '%THE%' OR source ILIKE '%the%' OR model_keyword ILIKE '%the%' OR opinion_id ILIKE '%the%')
  AND review_status = 1 AND {q.DAY.replace("create_time, ", "create_time, ")} >= '' AND replace(replace({q.s('create_time')},'/','-'),'.','-') >= '2024-02-01'
  AND {q.s('create_time')} <> '' AND substr(replace(replace({q.s('create_time')},'/','-'),'.','-'),1,10) <= '2024-06-15'
  AND (coalesce(review_l1,'') IN ('产品质量类','质量问题','产品质量','质量类','产品问题') OR coalesce(v3_l1,'') IN ('产品质量类','质量问题','产品质量','质量类','产品问题'))
  AND v3_l3 ILIKE '%l3%' AND v3_confidence >= 0.2 AND v3_confidence <= 0.95)
SELECT opinion_id, source, create_time, upload_batch, review_status, review_l1, review_l2, v3_l1, v3_l2, substr(original_text,1,420) AS original_text,
  length(original_text) > 420 AS original_text_truncated, {q.canon(q.ff('review_l1', 'v3_l1', q.js('v3_label_meta', 'l1'), 'model_class'))} AS canonical_l1,
  (SELECT count(*) FROM m) AS total
FROM m ORDER BY create_time DESC, opinion_id DESC LIMIT 20 OFFSET 20""")
def _(spark, d):
    return filters.review_list(with_score(opinion(spark, d)), page=2, size=20, search="THE", status=1,
                               day_from="2024-02-01", day_to="2024-06-15", l1="质量问题", l3="l3", conf_min=0.2, conf_max=0.95)


@query("pending_queue", """
SELECT opinion_id, review_status, v3_confidence FROM opinion WHERE review_status = 2 OR (review_status <> 1 AND coalesce(v3_confidence, 0) < 0.52)""")
def _(spark, d):
    return filters.review_rows(with_score(opinion(spark, d)), pending_only=True).select("opinion_id", "review_status", "v3_confidence")


def _mismatch(kind, cond):
    @query(kind, f"SELECT opinion_id, review_l1, review_l2, v3_l1, v3_l2, model_class FROM opinion WHERE {cond}")
    def _(spark, d):
        return filters.review_rows(with_score(opinion(spark, d)), mismatch=kind).select(
            "opinion_id", "review_l1", "review_l2", "v3_l1", "v3_l2", "model_class")


_mismatch("l1_disagree", "review_status IN (0,2) AND coalesce(model_class,'') <> '' AND coalesce(v3_l1,'') <> '' AND v3_l1 <> model_class")
_mismatch("l2_disagree", f"review_status IN (0,2) AND coalesce(v3_l1,'') <> '' AND coalesce(model_keyword,'') <> '' AND v3_l2 <> {q.kw1()}")
_mismatch("human_fixed_l1", "review_status = 1 AND coalesce(review_l1,'') <> '' AND coalesce(v3_l1,'') <> '' AND v3_l1 <> review_l1")
_mismatch("human_fixed_l2", "review_status = 1 AND coalesce(review_l2,'') <> '' AND coalesce(v3_l2,'') <> '' AND v3_l2 <> review_l2")


@query("report_window_rows", f"""
SELECT opinion_id, {q.DAY} AS day, {q.MONTH} AS month_key, country FROM opinion
WHERE {q.DAY} BETWEEN '2024-02-10' AND '2024-05-20' AND NOT {q.CN}""")
def _(spark, d):
    return filters.report_window(opinion(spark, d), "2024-02-10", "2024-05-20", "rest").select("opinion_id", "day", "month_key", "country")


@query("since_days", f"""
SELECT opinion_id, strftime({q.EVENT_TS}, '%Y-%m-%d %H:%M:%S') AS t FROM opinion WHERE {q.EVENT_TS} >= TIMESTAMP '2024-05-31 00:00:00'""")
def _(spark, d):
    return filters.since_days(opinion(spark, d), 30, AS_OF).select("opinion_id", F.date_format(event_time(), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("since_days_counts", f"""
SELECT count(*) FILTER (WHERE {q.EVENT_TS} >= TIMESTAMP '2024-05-31 00:00:00') AS kept,
 count(*) FILTER (WHERE {q.EVENT_TS} < TIMESTAMP '2024-05-31 00:00:00') AS too_old,
 count(*) FILTER (WHERE {q.EVENT_TS} IS NULL) AS skipped_no_time FROM opinion""")
def _(spark, d):
    return filters.since_days_counts(opinion(spark, d), 30, AS_OF)


@query("split_windows", f"""
WITH t AS (SELECT opinion_id, {q.EVENT_TS} AS ts FROM opinion), m AS (SELECT max(ts) - INTERVAL 29 DAY AS cut FROM t)
SELECT opinion_id, CASE WHEN ts IS NULL OR ts >= (SELECT cut FROM m) THEN 'current' WHEN ts >= (SELECT cut FROM m) - INTERVAL 30 DAY THEN 'previous' END AS part FROM t""")
def _(spark, d):
    o = opinion(spark, d).select("opinion_id", event_time().alias("event_ts"))
    return filters.split_windows(o, 30).select("opinion_id", F.col("window").alias("part"))


@query("prev_window", f"""
WITH t AS (SELECT opinion_id, try_cast({q.DAY} AS DATE) AS a, try_cast({q.DAY} AS DATE) + CAST(id % 40 AS INT) AS b FROM opinion WHERE {q.DAY} <> '')
SELECT opinion_id, CAST(a - 1 - CAST((b - a) AS INT) AS VARCHAR) AS prev_from, CAST(a - 1 AS VARCHAR) AS prev_to FROM t""")
def _(spark, d):
    from plaintide.functions.dates import report_event_day
    o = opinion(spark, d).select("opinion_id", "id", report_event_day().alias("day")).filter(F.col("day") != "")
    a = F.try_to_date("day", "yyyy-MM-dd")
    p, e = previous_window(a, F.date_add(a, (F.col("id") % 40).cast("int")))
    return o.select("opinion_id", p.cast("string").alias("prev_from"), e.cast("string").alias("prev_to"))


@query("sample_priority_rows", f"""
SELECT opinion_id, CASE WHEN {q.s('v3_l3')} <> '' OR {q.s('review_l3')} <> '' THEN 0
  WHEN contains(v3_label_meta, '"l3":') AND NOT contains(v3_label_meta, '"l3": ""') AND NOT contains(v3_label_meta, '"l3":""') THEN 1 ELSE 2 END AS sample_rank
FROM opinion WHERE {q.s('original_text')} <> '' ORDER BY sample_rank, id DESC LIMIT 700""")
def _(spark, d):
    return filters.sample_priority_rows(opinion(spark, d), 700).select("opinion_id", "sample_rank")


_DUPS = """(SELECT id, CASE WHEN id % 5 = 1 THEN concat('D', cast(id // 20 AS string)) ELSE opinion_id END AS opinion_id, upload_batch, review_status FROM {0})"""


@query("drop_batch_duplicates", f"""
WITH t AS {_DUPS.format(BATCHED)}
SELECT id, opinion_id, upload_batch FROM t WHERE upload_batch <> 'R1' OR (SELECT count(*) FROM t WHERE upload_batch = 'R1' AND review_status <> 1) > 0
  OR id IN (SELECT min(id) FROM t WHERE upload_batch = 'R1' GROUP BY opinion_id)""")
def _(spark, d):
    o = batched(opinion(spark, d)).withColumn("opinion_id", F.when(
        F.col("id") % 5 == 1, F.concat(F.lit("D"), F.floor(F.col("id") / 20).cast("string"))).otherwise(F.col("opinion_id")))
    return filters.drop_batch_duplicates(o.select("id", "opinion_id", "upload_batch", "review_status"), "R1").select("id", "opinion_id", "upload_batch")


# Decisions for every fourth row; one in three names no class, one in five a fresh L2.
DEC_SQL = """dec AS (SELECT opinion_id, CASE WHEN id % 3 = 0 THEN NULL ELSE model_class END AS r1,
   CASE WHEN id % 5 = 0 THEN 'L2-X' END AS r2, CASE WHEN id % 8 = 0 THEN 'note' END AS note FROM opinion WHERE id % 4 = 0)"""


def decisions(o):
    return o.filter(F.col("id") % 4 == 0).select(
        "opinion_id", F.when(F.col("id") % 3 != 0, F.col("model_class")).alias("review_l1"),
        F.when(F.col("id") % 5 == 0, "L2-X").alias("review_l2"), F.when(F.col("id") % 8 == 0, "note").alias("review_note"))


def top_words_sql(src: str, where: str = "true") -> str:
    return f"""kw0 AS (SELECT id, unnest({tokens_sql('original_text')}) AS tok FROM {src} WHERE {where}),
 kw1 AS (SELECT id, tok, count(*) AS c FROM kw0 GROUP BY id, tok),
 kw2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, tok) AS rn FROM kw1),
 kw AS (SELECT id, string_agg(tok, ',' ORDER BY rn) AS words FROM kw2 WHERE rn <= 20 GROUP BY id)"""


def _apply_sql(m1: str, m2: str, extra: str = "true") -> str:
    return f"""
WITH {DEC_SQL}, {top_words_sql('opinion')},
 j AS (SELECT o.*, dec.opinion_id IS NOT NULL AS hit0, note, {q.ff('r1', 'o.review_l1', m1)} AS raw1, {q.ff('r2', 'o.review_l2', m2)} AS raw2
   FROM opinion o LEFT JOIN dec ON o.opinion_id = dec.opinion_id),
 n AS (SELECT *, hit0 AND raw1 <> '' AND {extra} AS applied, {q.canon_b('raw1')} AS n1,
   CASE WHEN {q.canon_b('raw1')} = '非问题' THEN '' ELSE raw2 END AS n2 FROM j),
 c AS (SELECT *, applied AND (n1 <> {q.s('review_l1')} OR n2 <> {q.s('review_l2')}) AS to_reflow FROM n)
SELECT c.opinion_id, applied, to_reflow, CASE WHEN applied THEN 1 ELSE review_status END AS review_status,
  CASE WHEN applied THEN n1 ELSE review_l1 END AS review_l1, CASE WHEN applied THEN n2 ELSE review_l2 END AS review_l2,
  CASE WHEN applied THEN '' ELSE review_l3 END AS review_l3, CASE WHEN applied THEN note END AS review_note,
  CASE WHEN applied THEN md5(coalesce(words, '')) END AS kw, CASE WHEN to_reflow THEN 0 ELSE reflow_synced END AS reflow_synced
FROM c LEFT JOIN kw ON c.id = kw.id"""


def _applied(df):
    return df.select("opinion_id", "applied", "to_reflow", "review_status", "review_l1", "review_l2", "review_l3",
                     "review_note", F.md5("extracted_keywords").alias("kw"), "reflow_synced")


@query("apply_reviews", _apply_sql(q.js("v3_label_meta", "l1"), q.js("v3_label_meta", "l2")))
def _(spark, d):
    o = opinion(spark, d)
    return _applied(review.apply_reviews(o, decisions(o), "r1", "2024-06-30T00:00:00"))


@query("apply_reviews_draft", _apply_sql(
    f"coalesce({q.n('v3_l1')}, {q.js('v3_label_meta', 'l1')})", f"coalesce({q.n('v3_l2')}, {q.js('v3_label_meta', 'l2')})",
    "review_status <> 1"))
def _(spark, d):
    o = opinion(spark, d)
    return _applied(review.apply_reviews(o, decisions(o), "r1", "2024-06-30T00:00:00", draft=True))


@query("batch_save_reviews", f"""
WITH dec AS (SELECT opinion_id, CASE WHEN id % 12 = 0 THEN NULL ELSE 1 END AS st, CASE WHEN id % 3 = 0 THEN '' ELSE model_class END AS r1, 'L2-Y' AS r2, 'r9' AS rv
   FROM opinion WHERE id % 4 = 0)
SELECT o.opinion_id, CASE WHEN st IS NOT NULL THEN st ELSE review_status END AS review_status,
  CASE WHEN st IS NULL THEN review_l1 WHEN {q.s('r1')} <> '' THEN {q.canon('r1')} ELSE r1 END AS review_l1,
  CASE WHEN st IS NULL THEN review_l2 WHEN {q.s('r1')} <> '' AND {q.canon('r1')} = '非问题' THEN '' ELSE r2 END AS review_l2,
  CASE WHEN st IS NULL THEN review_l3 END AS review_l3, CASE WHEN st IS NOT NULL THEN rv END AS reviewer,
  CASE WHEN st IS NULL THEN reviewed_at END AS reviewed_at
FROM opinion o LEFT JOIN dec ON o.opinion_id = dec.opinion_id""")
def _(spark, d):
    o = opinion(spark, d)
    r = o.filter(F.col("id") % 4 == 0).select(
        "opinion_id", F.when(F.col("id") % 12 != 0, 1).alias("review_status"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.col("model_class")).alias("review_l1"),
        F.lit("L2-Y").alias("review_l2"), F.lit("r9").alias("reviewer"))
    return review.batch_save_reviews(o, r).select("opinion_id", "review_status", "review_l1", "review_l2", "review_l3", "reviewer", "reviewed_at")


READY_SQL = f"""rdy AS (SELECT *, {q.REV_L1} AS e1, {q.REV_L2} AS e2 FROM opinion),
 st AS (SELECT *, CASE WHEN review_status = 1 THEN 'confirmed' WHEN e1 = '' THEN 'no_l1'
   WHEN {q.canon('e1')} <> '非问题' AND e2 = '' THEN 'missing_l2' ELSE 'confirmable' END AS state FROM rdy)"""


@query("confirm_batch", f"""
WITH {READY_SQL},
 a AS (SELECT *, upload_batch = '20240301_1_2' AND state = 'confirmable' AND (SELECT count(*) FROM st WHERE upload_batch = '20240301_1_2' AND state IN ('no_l1','missing_l2')) = 0 AS applied FROM st)
SELECT opinion_id, applied, CASE WHEN applied THEN 1 ELSE review_status END AS review_status,
  CASE WHEN applied THEN {q.canon('e1')} ELSE review_l1 END AS review_l1,
  CASE WHEN applied THEN (CASE WHEN {q.canon('e1')} = '非问题' THEN {q.ff('review_l2', q.js('v3_label_meta', 'l2'))} ELSE e2 END) ELSE review_l2 END AS raw_l2
FROM a""".replace("""CASE WHEN applied THEN (CASE WHEN""", "CASE WHEN applied THEN (CASE WHEN").replace(
    f"(CASE WHEN {q.canon('e1')} = '非问题' THEN {q.ff('review_l2', q.js('v3_label_meta', 'l2'))} ELSE e2 END)",
    f"(CASE WHEN {q.canon('e1')} = '非问题' THEN '' ELSE e2 END)").replace("AS raw_l2", "AS review_l2"))
def _(spark, d):
    out = review.confirm_batch(opinion(spark, d), "20240301_1_2", "r1", "2024-06-30T00:00:00")
    return out.select("opinion_id", "applied", "review_status", "review_l1", "review_l2")


@query("reflow_candidates", f"""
WITH t AS {BATCHED}, open AS (SELECT DISTINCT upload_batch FROM t WHERE upload_batch <> '' AND review_status <> 1)
SELECT opinion_id, upload_batch FROM t WHERE review_status = 1 AND coalesce(reflow_synced,0) < 1 AND coalesce(review_l1,'') <> ''
  AND upload_batch NOT IN (SELECT upload_batch FROM open)""")
def _(spark, d):
    return review.reflow_candidates(batched(opinion(spark, d))).select("opinion_id", "upload_batch")


@query("archive_batch", f"""
WITH t AS {BATCHED}, h AS (SELECT *, upload_batch = 'R2' AND review_status = 1 AND (SELECT count(*) FROM t WHERE upload_batch='R2' AND review_status <> 1) = 0 AS hit FROM t)
SELECT opinion_id, hit AND reflow_synced < 1 AS feedback, CASE WHEN hit AND reflow_synced = 2 THEN 'already' WHEN hit THEN 'new' END AS archive_action,
  CASE WHEN hit THEN 2 ELSE reflow_synced END AS reflow_synced FROM h""")
def _(spark, d):
    return review.archive_batch(batched(opinion(spark, d)), "R2").select("opinion_id", "feedback", "archive_action", "reflow_synced")


@query("mark_reflow_failures", """
SELECT opinion_id, CASE WHEN id % 7 = 0 THEN -1 ELSE reflow_synced END AS reflow_synced,
  CASE WHEN id % 7 = 0 THEN concat('timeout ', original_text) END AS reflow_sync_reason FROM opinion""")
def _(spark, d):
    o = opinion(spark, d)
    fail = o.filter(F.col("id") % 7 == 0).select("opinion_id", F.concat(F.lit("timeout "), "original_text").alias("reason"))
    return review.mark_reflow_failures(o, fail).select("opinion_id", "reflow_synced", "reflow_sync_reason")


@query("correction_log", """
WITH r AS (SELECT opinion_id, CASE WHEN id % 3 = 0 THEN '非问题' ELSE model_class END AS c, review_status AS st, reviewed_at AS timestamp, model_class FROM opinion WHERE review_status = 1)
SELECT opinion_id, c AS corrected_class, timestamp, model_class AS original_class, model_class <> c AND st = 1 AS is_corrected
FROM r""")
def _(spark, d):
    o = opinion(spark, d)
    r = o.filter(labels.is_reviewed()).withColumn("review_note", F.when(F.col("id") % 3 == 0, "非问题").otherwise(F.col("model_class")))
    return review.correction_log(o, r)


@query("confirm_as_correct", f"""
WITH t AS (SELECT *, {q.ff('review_l1', 'v3_l1')} AS n1 FROM opinion), u AS (SELECT *, CASE WHEN n1 = '非问题' THEN '' ELSE {q.ff('review_l2', 'v3_l2')} END AS n2 FROM t),
 e AS (SELECT *, CASE WHEN n1 = '' THEN 'no_l1' WHEN n1 <> '非问题' AND n2 = '' THEN 'missing_l2' ELSE '' END AS error FROM u)
SELECT opinion_id, n1 AS new_l1, n2 AS new_l2, error, CASE WHEN error = '' THEN 1 ELSE review_status END AS new_status FROM e""")
def _(spark, d):
    return review.confirm_as_correct(opinion(spark, d), F.col("v3_l1"), F.col("v3_l2")).select(
        "opinion_id", "new_l1", "new_l2", "error", "new_status")
