"""Sources, stores and merges as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.functions import labels
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion, table
from plaintide.plans.registry import query
from plaintide.sources import feed as fd, stores

# A feed derived from the table: every third opinion is sent again with new text, one in five of
# these twice, one in fifty with a blank id, and some ids are new.
FEED_SQL = f"""feed AS (
 SELECT CASE WHEN id % 50 = 6 THEN ' ' WHEN id % 4 = 3 THEN concat('NEW', opinion_id) ELSE opinion_id END AS opinion_id,
        id * 2 AS line, concat('v1 ', source) AS source, concat('again ', original_text) AS original_text, create_time, alias AS model_class, vin, phone
 FROM (SELECT *, model_class AS alias FROM opinion) WHERE id % 3 = 0
 UNION ALL
 SELECT CASE WHEN id % 4 = 3 THEN concat('NEW', opinion_id) ELSE opinion_id END, id * 2 + 1, concat('v2 ', source), original_text, create_time, model_class, vin, phone
 FROM opinion WHERE id % 15 = 0)"""


def feed(o):
    new_id = F.when(F.col("id") % 4 == 3, F.concat(F.lit("NEW"), "opinion_id")).otherwise(F.col("opinion_id"))
    a = o.filter(F.col("id") % 3 == 0).select(
        F.when(F.col("id") % 50 == 6, " ").otherwise(new_id).alias("opinion_id"), (F.col("id") * 2).alias("_line"),
        F.concat(F.lit("v1 "), "source").alias("source"), F.concat(F.lit("again "), "original_text").alias("original_text"),
        "create_time", "model_class", "vin", "phone")
    b = o.filter(F.col("id") % 15 == 0).select(
        new_id.alias("opinion_id"), (F.col("id") * 2 + 1).alias("_line"), F.concat(F.lit("v2 "), "source").alias("source"),
        "original_text", "create_time", "model_class", "vin", "phone")
    return a.unionByName(b)


@query("header_alias_resolve", f"""
WITH t AS (SELECT opinion_id, CASE WHEN id % 3 = 0 THEN vin ELSE ' ' END AS a, CASE WHEN id % 3 <> 0 THEN vin END AS b,
   phone, CASE WHEN id % 2 = 0 THEN '' ELSE car_model END AS m1, car_model AS m2, country, original_text FROM opinion)
SELECT opinion_id, {q.ff('a', 'b')} AS vin, {q.ff('m1', 'm2', "substr(trim(regexp_extract(original_text, '(?i)(?:车型|车辆型号|购车车型|车系|Model|型号)\\s*[:：]?\\s*([^，,。；;\\n\\r]+)', 1)), 1, 80)")} AS car_model,
   {q.s('phone')} AS phone, {q.s('country')} AS country FROM t""")
def _(spark, d):
    o = opinion(spark, d)
    raw = o.select("opinion_id", "original_text", F.when(F.col("id") % 3 == 0, F.col("vin")).otherwise(" ").alias("车架号"),
                   F.when(F.col("id") % 3 != 0, F.col("vin")).alias("底盘号"), F.col("phone").alias("联系电话"),
                   F.when(F.col("id") % 2 == 0, "").otherwise(F.col("car_model")).alias("车型"),
                   F.col("car_model").alias("车辆车型"), F.col("country").alias("市场"))
    return fd.resolve_headers(raw).select("opinion_id", "vin", "car_model", "phone", "country")


@query("dedupe_last_by_id", f"""
WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY line DESC) AS rn FROM feed WHERE trim(opinion_id) <> '')
SELECT opinion_id, line, source, md5(original_text) AS body FROM r WHERE rn = 1""")
def _(spark, d):
    f = fd.dedupe_last(feed(opinion(spark, d)))
    return f.select("opinion_id", F.col("_line").alias("line"), "source", F.md5("original_text").alias("body"))


@query("upsert_by_id", f"""
WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY line DESC) AS rn FROM feed WHERE trim(opinion_id) <> ''),
 f AS (SELECT * FROM r WHERE rn = 1)
SELECT coalesce(o.opinion_id, f.opinion_id) AS opinion_id, coalesce(f.source, o.source) AS source,
  md5(coalesce(f.original_text, o.original_text)) AS body, o.review_l1, coalesce(o.review_status, 0) AS review_status,
  CASE WHEN f.opinion_id IS NULL THEN 'keep' WHEN o.opinion_id IS NULL THEN 'insert' ELSE 'update' END AS merge_action
FROM opinion o FULL JOIN f ON o.opinion_id = f.opinion_id""")
def _(spark, d):
    o = opinion(spark, d)
    m = fd.upsert(o, fd.dedupe_last(feed(o)).drop("_line"))
    return m.select("opinion_id", "source", F.md5("original_text").alias("body"), "review_l1", "review_status", "merge_action")


@query("upsert_counts", f"""
WITH {FEED_SQL}, f AS (SELECT DISTINCT opinion_id FROM feed WHERE trim(opinion_id) <> '')
SELECT count(*) FILTER (WHERE opinion_id NOT IN (SELECT opinion_id FROM opinion)) AS inserted,
       count(*) FILTER (WHERE opinion_id IN (SELECT opinion_id FROM opinion)) AS updated FROM f""")
def _(spark, d):
    o = opinion(spark, d)
    return fd.upsert_counts(fd.upsert(o, fd.dedupe_last(feed(o)).drop("_line")))


@query("assign_batch_id", f"""
WITH {FEED_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY line DESC) AS rn FROM feed WHERE trim(opinion_id) <> ''),
 s AS (SELECT coalesce(max(try_cast(split_part(upload_batch, '_', 2) AS INT)), 0) + 1 AS seq FROM opinion WHERE starts_with(upload_batch, '20240301_'))
SELECT opinion_id, concat('20240301_', (SELECT seq FROM s), '_', (SELECT count(*) FROM f WHERE rn = 1)) AS upload_batch FROM f WHERE rn = 1""")
def _(spark, d):
    o = opinion(spark, d)
    return fd.assign_batch(fd.dedupe_last(feed(o)), o, "20240301").select("opinion_id", "upload_batch")


@query("existing_ids", """
WITH t AS (SELECT DISTINCT concat('OP', lpad(cast(item_id * 37 AS string), 8, '0')) AS opinion_id FROM benchmark)
SELECT opinion_id FROM t WHERE opinion_id IN (SELECT opinion_id FROM opinion)""")
def _(spark, d):
    ids = table(spark, d, "benchmark").select(
        F.concat(F.lit("OP"), F.lpad((F.col("item_id") * 37).cast("string"), 8, "0")).alias("opinion_id"))
    return fd.existing_ids(opinion(spark, d), ids)


@query("yearly_archive", f"""
SELECT opinion_id AS "舆情编号", md5(original_text) AS "舆情中文", source AS "渠道", create_time AS "舆情时间",
  coalesce(nullif(review_l1,''), model_class) AS "一级标签", coalesce(nullif(review_l2,''), {q.kw1()}) AS "二级标签",
  CASE WHEN contains(model_keyword, ',') THEN trim(substr(model_keyword, strpos(model_keyword, ',') + 1)) ELSE '' END AS "关键词",
  coalesce(country,'') AS "国家", coalesce(phone,'') AS "手机号", coalesce(vin,'') AS "VIN", coalesce(car_model,'') AS "车型",
  v3_confidence AS "置信度", '已复核' AS "复核状态", '未填写' AS "复核备注", substr(create_time,1,4) AS "年度", substr(create_time,1,7) AS "年月",
  '' AS "复核人", coalesce(reviewed_at,'') AS "复核时间"
FROM opinion WHERE review_status = 1""")
def _(spark, d):
    return stores.yearly_archive(opinion(spark, d)).withColumn("舆情中文", F.md5("舆情中文"))


@query("filtered_export", """
SELECT opinion_id, source, md5(original_text) AS original_text, create_time, model_class, model_keyword, NULL::DOUBLE AS match_score,
 upload_batch, review_status, NULL AS review_note, v3_label_meta, review_l1, review_l2, review_l3, NULL AS extracted_keywords,
 NULL AS reviewer, reviewed_at, reflow_synced FROM opinion WHERE review_status = 1 AND upload_batch = '20240201_1_1'""")
def _(spark, d):
    return stores.filtered_export(opinion(spark, d), "20240201_1_1", 1).withColumn("original_text", F.md5("original_text"))


_CLEAN = f"""fresh AS (SELECT {q.s('opinion_id')} AS k, {q.s(q.js('v3_label_meta', 'l1'))} AS m1, {q.s(q.js('v3_label_meta', 'l2'))} AS m2,
   coalesce({q.js('v3_label_meta', 'confidence')}, '0') AS conf, model_class, {q.s('review_l1')} AS h1, {q.s('review_l2')} AS h2, original_text, create_time
   FROM opinion WHERE review_status = 1 AND {q.s('review_l1')} <> ''),
 lib AS (SELECT opinion_id AS k, original_text, create_time, v3_l1, model_class FROM opinion WHERE id % 4 = 0)"""


@query("clean_library_upsert", f"""
WITH {_CLEAN}
SELECT k AS "舆情编号", md5({q.s('original_text')}) AS "原文", create_time AS "日期", m1 AS "模型分类结果", conf AS "置信度", model_class AS "人工分类",
  'VOC复核' AS "筛选原因", h1 AS "人工复核结果",
  concat('VOC回流|L1:', m1, '→', h1, ';L2:', m2, '→', h2, ';三级关键词:|复核人:r1|2024-06-30T00:00:00') AS "修正原因",
  CASE WHEN k IN (SELECT k FROM lib) THEN 'overwrite' ELSE 'insert' END AS action FROM fresh
UNION ALL SELECT k, md5(original_text), create_time, v3_l1, '0', model_class, 'VOC工作台', '', '', 'keep' FROM lib WHERE k NOT IN (SELECT k FROM fresh)""")
def _(spark, d):
    o = opinion(spark, d)
    lib = o.filter(F.col("id") % 4 == 0).select(
        F.col("opinion_id").alias("舆情编号"), F.col("original_text").alias("原文"), F.col("create_time").alias("日期"),
        F.col("v3_l1").alias("模型分类结果"), F.lit("0").alias("置信度"), F.col("model_class").alias("人工分类"),
        F.lit("VOC工作台").alias("筛选原因"), F.lit("").alias("人工复核结果"), F.lit("").alias("修正原因"))
    out = stores.clean_library_upsert(lib, o.filter(labels.is_reviewed()), "r1", "2024-06-30T00:00:00")
    return out.withColumn("原文", F.md5("原文"))


@query("clean_library_rejects", """
SELECT opinion_id, '缺少人工一级' AS error FROM opinion WHERE coalesce(review_l1, '') = ''""")
def _(spark, d):
    return stores.clean_library_rejects(opinion(spark, d))


@query("monthly_archive_merge", f"""
WITH b AS (SELECT opinion_id, create_time, original_text, 0 AS gen, id AS line, 'old' AS src FROM opinion WHERE id % 2 = 0
  UNION ALL SELECT opinion_id, create_time, original_text, 1, id, 'new' FROM opinion WHERE id % 3 = 0
  UNION ALL SELECT opinion_id, '2024-01-05', 'same body', 1, id, 'new' FROM opinion WHERE id % 3 = 1),
 t AS (SELECT *, {q.time_of('create_time')} AS ts FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY ts, md5(original_text) ORDER BY gen DESC, line DESC) AS rn FROM t WHERE ts IS NOT NULL)
SELECT opinion_id, src, year(ts)::INT AS year, month(ts)::INT AS month FROM r WHERE rn = 1""")
def _(spark, d):
    o = opinion(spark, d).select("id", "opinion_id", "create_time", "original_text", F.col("id").alias("_line"))
    old = o.filter(F.col("id") % 2 == 0).withColumn("src", F.lit("old"))
    new = o.filter(F.col("id") % 3 == 0).withColumn("src", F.lit("new"))
    same = o.filter(F.col("id") % 3 == 1).withColumns(
        {"create_time": F.lit("2024-01-05"), "original_text": F.lit("same body"), "src": F.lit("new")})
    return stores.monthly_archive_merge(old, new.unionByName(same)).select("opinion_id", "src", "year", "month")


@query("training_jsonl", f"""
SELECT opinion_id, md5(concat('分类：', {q.s('original_text')})) AS prompt,
  concat('{{"l1": "', {q.s('review_l1')}, '", "l2": "', {q.s('review_l2')}, '"}}') AS completion
FROM opinion WHERE review_status = 1 AND coalesce(review_l1,'') <> '' AND {q.s('original_text')} <> ''""")
def _(spark, d):
    return stores.training_rows(opinion(spark, d), "分类：").withColumn("prompt", F.md5("prompt"))


@query("vector_store_upsert", """
WITH b AS (SELECT vec_id, embedding, 'm1' AS model, 0 AS gen, label AS updated_at FROM embeddings
  UNION ALL SELECT vec_id, list_transform(embedding, lambda x: -x), 'm2', 1, label FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id + 1000000, embedding, 'm2', 1, label FROM embeddings WHERE vec_id % 5 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gen DESC, updated_at DESC) AS rn FROM b)
SELECT vec_id, model, round(embedding[1]::DOUBLE, 6) AS first_dim, len(embedding)::BIGINT AS dim FROM r WHERE rn = 1 AND model = 'm2'""",
       needs_opinion=False)
def _(spark, d):
    e = table(spark, d, "embeddings")
    shape = lambda x, v, m: x.select(F.col("vec_id"), v.alias("vector"), F.lit(m).alias("model"), F.col("label").alias("updated_at"))
    old = shape(e, F.col("embedding"), "m1")
    new = shape(e.filter(F.col("vec_id") % 2 == 0), F.transform("embedding", lambda x: -x), "m2").unionByName(
        shape(e.filter(F.col("vec_id") % 5 == 0).withColumn("vec_id", F.col("vec_id") + 1000000), F.col("embedding"), "m2"))
    s = stores.read_vectors(stores.upsert_vectors(old, new, "vec_id"), "m2")
    return s.select("vec_id", "model", F.round(F.col("vector")[0].cast("double"), 6).alias("first_dim"),
                    F.size("vector").cast("bigint").alias("dim"))


@query("weekly_report_store", f"""
WITH t AS (SELECT strftime(CAST({q.EVENT_TS} AS DATE), '%G/W%V') AS wk, id FROM opinion),
 w AS (SELECT replace(wk, '/', '') AS week, count(*) AS total, max(id) AS saved_at FROM t WHERE wk IS NOT NULL GROUP BY wk)
SELECT week, cast(total AS VARCHAR) AS total, concat('n=', total) AS summary, saved_at FROM w ORDER BY saved_at DESC, week DESC LIMIT 12""")
def _(spark, d):
    from plaintide.functions.dates import event_time
    o = opinion(spark, d).select("id", event_time().cast("date").alias("day")).filter(F.col("day").isNotNull())
    wk = F.concat(F.extract(F.lit("YEAROFWEEK"), "day").cast("string"), F.lit("/W"), F.lpad(F.weekofyear("day").cast("string"), 2, "0"))
    rep = o.groupBy(wk.alias("week")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("saved_at"))
    body = F.to_json(F.struct(F.col("n").alias("total"), F.concat(F.lit("n="), "n").alias("summary")))
    return stores.list_weekly_reports(rep.select("week", body.alias("body"), "saved_at"))


@query("reflow_audit_log", f"""
SELECT opinion_id, {q.s(q.js('v3_label_meta', 'l1'))} AS before_l1, review_l1 AS after_l1,
   CASE WHEN id % 4 = 0 THEN 'overwrite' ELSE 'insert' END AS action FROM opinion WHERE review_status = 1 AND coalesce(review_l1,'') <> ''""")
def _(spark, d):
    o = opinion(spark, d)
    lib = o.filter(F.col("id") % 4 == 0).select(F.col("opinion_id").alias("舆情编号"))
    a = stores.audit_rows(o.filter(labels.is_reviewed()), lib, "r1", "confirm", "2024-06-30")
    return a.select("opinion_id", F.col("before.l1").alias("before_l1"), F.col("after.l1").alias("after_l1"), "action")


@query("route_metrics_tail", """
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS timestamp, count(*) AS n FROM events GROUP BY user_id
ORDER BY max(ts) DESC LIMIT 20""", needs_opinion=False)
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("timestamp"), F.count(F.lit(1)).alias("n"))
    return stores.route_metrics_tail(e, 20).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
