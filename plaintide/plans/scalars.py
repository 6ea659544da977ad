"""Projection and scalar queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.functions import dates, insight, labels, meta, text as tx
from plaintide.functions.common import WS, blank
from plaintide.packs import prose, words as wp
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion, table
from plaintide.plans.registry import query


def lit_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query("canonicalize_l1", f"""
SELECT opinion_id, {q.canon('model_class')} AS feed_l1, {q.canon_b('v3_l1')} AS model_l1,
       {q.canon("concat(' ', source, ' ')")} AS default_l1, {q.try_canon('source')} AS try_l1,
       {q.try_canon("concat('产品　质量', ' 类')")} AS spaced_l1, {q.canon("concat(model_class, ' 咨询')")} AS suffix_l1
FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select(
        "opinion_id", labels.canonicalize_l1("model_class").alias("feed_l1"),
        labels.canonical_or_blank("v3_l1").alias("model_l1"),
        labels.canonicalize_l1(F.concat(F.lit(" "), "source", F.lit(" "))).alias("default_l1"),
        labels.try_canonicalize_l1("source").alias("try_l1"),
        labels.try_canonicalize_l1(F.lit("产品　质量 类")).alias("spaced_l1"),
        labels.canonicalize_l1(F.concat("model_class", F.lit(" 咨询"))).alias("suffix_l1"))


@query("l1_filter_variants", """
SELECT opinion_id, review_l1, v3_l1 FROM opinion
WHERE coalesce(review_l1, '') IN ('产品质量类','质量问题','产品质量','质量类','产品问题')
   OR coalesce(v3_l1, '') IN ('产品质量类','质量问题','产品质量','质量类','产品问题')""")
def _(spark, d):
    names = labels.l1_filter_variants("质量问题")
    return opinion(spark, d).filter(F.col("review_l1").isin(names) | F.col("v3_l1").isin(names)).select(
        "opinion_id", "review_l1", "v3_l1")


@query("strip_non_issue_l2", f"""
SELECT opinion_id, {q.canon_b('review_l1')} AS l1,
  CASE WHEN {q.canon_b('review_l1')} = '非问题' THEN '' ELSE {q.s('v3_l2')} END AS l2,
  {q.canon_b('model_class')} AS feed_l1,
  CASE WHEN {q.canon_b('model_class')} = '非问题' THEN '' ELSE {q.s(q.kw1())} END AS feed_l2
FROM opinion""")
def _(spark, d):
    a1, a2 = labels.strip_non_issue("review_l1", "v3_l2")
    b1, b2 = labels.strip_non_issue("model_class", labels.first_keyword("model_keyword"))
    return opinion(spark, d).select("opinion_id", a1.alias("l1"), a2.alias("l2"),
                                    b1.alias("feed_l1"), b2.alias("feed_l2"))


@query("meta_json_get", f"""
SELECT 'o' || id AS row_id, {q.js('v3_label_meta', 'l1')} AS a, {q.js('v3_label_meta', 'confidence')} AS b,
       {q.js('v3_label_meta', 'none')} AS c FROM opinion
UNION ALL SELECT 'e' || event_id, {q.js('props', 'k')}, {q.js("concat(props, ' ')", 'k')}, {q.js("concat('[', props, ']')", 'k')}
FROM events""")
def _(spark, d):
    o = opinion(spark, d).select(
        F.concat(F.lit("o"), "id").alias("row_id"), meta.json_get("v3_label_meta", "l1").alias("a"),
        meta.json_get("v3_label_meta", "confidence").alias("b"), meta.json_get("v3_label_meta", "none").alias("c"))
    e = spark.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.lit("e"), "event_id").alias("row_id"), meta.json_get("props", "k").alias("a"),
        meta.json_get(F.concat("props", F.lit(" ")), "k").alias("b"),
        meta.json_get(F.concat(F.lit("["), "props", F.lit("]")), "k").alias("c"))
    return o.unionByName(e)


@query("materialize_meta", f"""
SELECT opinion_id, v3_l1 = '' AS backfilled,
  CASE WHEN v3_l1 <> '' THEN v3_l1 ELSE {q.canon_b(q.js('v3_label_meta', 'l1'))} END AS v3_l1,
  CASE WHEN v3_l1 <> '' THEN v3_l2 ELSE {q.s(q.js('v3_label_meta', 'l2'))} END AS v3_l2,
  CASE WHEN v3_l1 <> '' THEN v3_l3 ELSE {q.s(q.js('v3_label_meta', 'l3'))} END AS v3_l3,
  CASE WHEN v3_l1 <> '' THEN v3_confidence
       ELSE coalesce(try_cast({q.js('v3_label_meta', 'confidence')} AS DOUBLE), 0.0) END AS v3_confidence,
  CASE WHEN v3_l1 <> '' THEN v3_match_type ELSE {q.s(q.js('v3_label_meta', 'match_type'))} END AS v3_match_type
FROM opinion""")
def _(spark, d):
    m = meta.materialized("v3_label_meta")
    need = blank("v3_l1")
    return opinion(spark, d).select("opinion_id", need.alias("backfilled"), *[
        F.when(need, c).otherwise(F.col(k)).alias(k) for k, c in m.items()])


@query("first_keyword_segment", f"SELECT opinion_id, {q.kw1()} AS seg, {q.kw1('car_model')} AS car_seg FROM opinion")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", labels.first_keyword("model_keyword").alias("seg"),
                                    labels.first_keyword("car_model").alias("car_seg"))


@query("effective_labels_report", f"SELECT opinion_id, {q.REP_L1} AS l1, {q.REP_L2} AS l2 FROM opinion")
def _(spark, d):
    l1, l2 = labels.report_labels()
    return opinion(spark, d).select("opinion_id", l1.alias("l1"), l2.alias("l2"))


@query("effective_labels_insight",
       f"SELECT opinion_id, {q.INS_L1} AS l1, {q.INS_L2} AS l2, {q.INS_L3} AS l3 FROM opinion")
def _(spark, d):
    l1, l2, l3 = labels.insight_labels()
    return opinion(spark, d).select("opinion_id", l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))


@query("effective_labels_review", f"SELECT opinion_id, {q.REV_L1} AS l1, {q.REV_L2} AS l2 FROM opinion")
def _(spark, d):
    l1, l2 = labels.review_labels()
    return opinion(spark, d).select("opinion_id", l1.alias("l1"), l2.alias("l2"))


@query("model_labels", f"SELECT opinion_id, {q.MOD_L1} AS l1, {q.MOD_L2} AS l2 FROM opinion")
def _(spark, d):
    l1, l2 = labels.model_labels()
    return opinion(spark, d).select("opinion_id", l1.alias("l1"), l2.alias("l2"))


@query("report_event_day", f"SELECT opinion_id, {q.DAY} AS day, {q.MONTH} AS month_key FROM opinion")
def _(spark, d):
    day = dates.report_event_day()
    return opinion(spark, d).select("opinion_id", day.alias("day"), F.substring(day, 1, 7).alias("month_key"))


_SD = "replace(replace({x}, '/', '-'), '.', '-')"


def stats_day_sql(*cols: str) -> str:
    def one(x):
        t = _SD.format(x=q.s(x))
        rx = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
        y, m, dd = (f"regexp_extract(substr({t},1,19), '{rx}', {i})" for i in (1, 2, 3))
        g = f"substr(regexp_replace({t}, '\\D', '', 'g'), 1, 8)"
        return (f"CASE WHEN {y} <> '' AND try_cast({m} AS INT) BETWEEN 1 AND 12 AND try_cast({dd} AS INT) BETWEEN 1 AND 31 "
                f"THEN {y} || '-' || lpad({m},2,'0') || '-' || lpad({dd},2,'0') "
                f"WHEN length({g}) = 8 AND try_cast(substr({g},5,2) AS INT) BETWEEN 1 AND 12 "
                f"AND try_cast(substr({g},7,2) AS INT) BETWEEN 1 AND 31 "
                f"THEN substr({g},1,4) || '-' || substr({g},5,2) || '-' || substr({g},7,2) END")
    return "coalesce(" + ", ".join(one(c) for c in cols) + ", '')"


@query("stats_day_key", f"""
SELECT opinion_id, {stats_day_sql('create_time', 'reviewed_at', 'created_at')} AS day,
       {stats_day_sql("replace(create_time, '-', '')", 'created_at')} AS digits_day,
       {stats_day_sql("concat(substr(created_at, 1, 4), '/3/', cast(1 + id % 40 AS string))")} AS short_day
FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select(
        "opinion_id", dates.stats_day("create_time", "reviewed_at", "created_at").alias("day"),
        dates.stats_day(F.replace("create_time", F.lit("-"), F.lit("")), "created_at").alias("digits_day"),
        dates.stats_day(F.concat(F.substring("created_at", 1, 4), F.lit("/3/"),
                                 (1 + F.col("id") % 40).cast("string"))).alias("short_day"))


@query("parse_event_time", f"""
SELECT opinion_id, strftime({q.EVENT_TS}, '%Y-%m-%d %H:%M:%S') AS event_time,
  strftime({q.time_of("concat('2026/1/', cast(1 + id % 40 AS string), ' 8:', cast(10 + id % 60 AS string))")}, '%Y-%m-%d %H:%M:%S') AS short_time
FROM opinion""")
def _(spark, d):
    fmt = "yyyy-MM-dd HH:mm:ss"
    short = F.concat(F.lit("2026/1/"), (1 + F.col("id") % 40).cast("string"), F.lit(" 8:"),
                     (10 + F.col("id") % 60).cast("string"))
    return opinion(spark, d).select(
        "opinion_id", F.date_format(dates.event_time(), fmt).alias("event_time"),
        F.date_format(dates.parse_time(short), fmt).alias("short_time"))


@query("region_bucket", f"SELECT opinion_id, CASE WHEN {q.CN} THEN 'cn' ELSE 'rest' END AS region FROM opinion")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", dates.region_bucket().alias("region"))


@query("effective_confidence", """
SELECT opinion_id, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE v3_confidence END,
                            CASE WHEN id % 6 = 0 THEN 0.25 END, 0.0)::DOUBLE AS confidence FROM opinion""")
def _(spark, d):
    o = opinion(spark, d).select(
        "opinion_id", F.when(F.col("id") % 3 != 0, F.col("v3_confidence")).alias("v3_confidence"),
        F.when(F.col("id") % 6 == 0, F.lit(0.25)).alias("match_score"))
    return o.select("opinion_id", labels.effective_confidence().alias("confidence"))


@query("match_family", """
SELECT opinion_id, CASE WHEN v3_match_type = 'clean_l1' THEN 'clean'
  WHEN v3_match_type ILIKE 'llm%' OR v3_match_type ILIKE 'qwen%' THEN 'llm'
  WHEN coalesce(v3_match_type, '') <> '' THEN 'rule' ELSE '' END AS family FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", labels.match_family().alias("family"))


@query("text_preview", """
SELECT opinion_id, substr(original_text, 1, 420) AS preview, length(original_text) > 420 AS truncated FROM opinion""")
def _(spark, d):
    p, t = tx.preview("original_text", 420)
    return opinion(spark, d).select("opinion_id", p.alias("preview"), t.alias("truncated"))


@query("mask_identifiers", f"""
SELECT opinion_id, CASE WHEN {q.s('vin')} = '' THEN '' WHEN length({q.s('vin')}) <= 6 THEN '***' ELSE substr({q.s('vin')},1,6) || '***' END AS vin,
  CASE WHEN {q.s('phone')} = '' THEN '' WHEN length({q.s('phone')}) < 7 THEN '****'
       ELSE substr({q.s('phone')},1,3) || '****' || right({q.s('phone')},2) END AS phone,
  CASE WHEN length(source) < 7 THEN '****' ELSE substr(source,1,3) || '****' || right(source,2) END AS short_phone
FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", tx.mask_vin("vin").alias("vin"), tx.mask_phone("phone").alias("phone"),
                                    tx.mask_phone("source").alias("short_phone"))


@query("scrub_quote", r"""
WITH t AS (SELECT opinion_id, concat(vin, ' / ', phone, ' / ', original_text) AS body FROM opinion)
SELECT opinion_id, md5(regexp_replace(regexp_replace(body, '1[3-9]\d{9}', '138****0000', 'g'),
       '(?i)[A-HJ-NPR-Z0-9]{17}', 'VIN****', 'g')) AS scrubbed FROM t""")
def _(spark, d):
    body = F.concat("vin", F.lit(" / "), "phone", F.lit(" / "), "original_text")
    return opinion(spark, d).select("opinion_id", F.md5(tx.scrub(body)).alias("scrubbed"))


_CAR_PARTS = (r"list_filter(list_transform(regexp_split_to_array(coalesce(car_model,''), '[,，/;|]+'), "
              f"lambda p: {q.s('p')}), lambda p: p <> '')")
_CAR_KEY = ("CASE lower(" + q.sq("p") + ") WHEN 'eletre' THEN 'Eletre' WHEN 'emeya' THEN 'EMEYA' WHEN 'emira' THEN 'Emira' "
            "WHEN 'evora' THEN 'EVORA' WHEN 'exige' THEN 'EXIGE' WHEN 'elise' THEN 'Elise' END")


def car_sql() -> str:
    return (f"coalesce(list_filter(list_transform({_CAR_PARTS}, lambda p: {_CAR_KEY}), lambda x: x IS NOT NULL)[1], "
            f"substr(regexp_replace({_CAR_PARTS}[1], '{WS}+', ' ', 'g'), 1, 40), '')")


@query("normalize_car_model", f"""
WITH m AS (SELECT opinion_id, {car_sql()} AS model,
  list_transform({_CAR_PARTS}, lambda p: coalesce({_CAR_KEY}, substr(regexp_replace(p, '{WS}+', ' ', 'g'), 1, 40))) AS xs FROM opinion)
SELECT opinion_id, model, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), '|') AS models FROM m""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", tx.model_name("car_model").alias("model"),
                                    F.concat_ws("|", tx.model_names("car_model")).alias("models"))


@query("vehicle_family", """
SELECT opinion_id, CASE WHEN starts_with(upper(trim(vin)), 'LJU') THEN 'electric' WHEN starts_with(upper(trim(vin)), 'SCC') THEN 'emira' ELSE '' END AS family,
  CASE WHEN starts_with(upper(source), 'SCC') THEN 'emira' ELSE '' END AS other FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", tx.vehicle_family("vin").alias("family"),
                                    tx.vehicle_family("source").alias("other"))


@query("extract_vehicle_ids", r"""
WITH t AS (SELECT opinion_id, CASE WHEN id % 2 = 0 THEN concat(original_text, ' VIN：', vin, ' end') ELSE concat(original_text, ' ', vin, ' end') END AS body,
                  concat(original_text, ' 车型: ', car_model, '。x') AS body2 FROM opinion)
SELECT opinion_id, upper(coalesce(nullif(regexp_extract(body, '(?i)(?:VIN|车架号|车辆识别码|车辆识别号|底盘号)\s*[:：]?\s*([A-HJ-NPR-Z0-9]{17})', 1), ''),
   regexp_extract(body, '(?i)\b([A-HJ-NPR-Z0-9]{17})\b', 1))) AS vin,
   substr(trim(regexp_extract(body2, '(?i)(?:车型|车辆型号|购车车型|车系|Model|型号)\s*[:：]?\s*([^，,。；;\n\r]+)', 1)), 1, 80) AS model
FROM t""")
def _(spark, d):
    o = opinion(spark, d)
    body = F.when(F.col("id") % 2 == 0, F.concat("original_text", F.lit(" VIN："), "vin", F.lit(" end"))).otherwise(
        F.concat("original_text", F.lit(" "), "vin", F.lit(" end")))
    body2 = F.concat("original_text", F.lit(" 车型: "), "car_model", F.lit("。x"))
    return o.select("opinion_id", tx.extract_vin(body).alias("vin"), tx.extract_model(body2).alias("model"))


@query("email_headers", r"""
WITH t AS (SELECT opinion_id, source, concat('标题：old', chr(10), '主题: RE: ', source, '  Case ', vin, chr(10), 'From: ', phone, ' <x@y>', chr(10),
    CASE WHEN id % 3 = 0 THEN concat('发件人: FW: ', car_model, ' z', chr(10)) ELSE '' END, original_text) AS body, original_text FROM opinion),
 h AS (SELECT *, list_transform(regexp_split_to_array(body, '\r\n|\n|\r'), lambda x: trim(x)) AS ls FROM t),
 f AS (SELECT opinion_id, source, original_text,
   regexp_extract(list_filter(ls, lambda x: regexp_matches(x, '(?i)^(?:主题|标题)\s*[：:]\s*(.+)$'))[-1], '(?i)^(?:主题|标题)\s*[：:]\s*(.+)$', 1) AS sj,
   coalesce(nullif(regexp_extract(list_filter(ls, lambda x: regexp_matches(x, '(?i)^发件人\s*[：:]\s*(.+)$'))[-1], '(?i)^发件人\s*[：:]\s*(.+)$', 1), ''),
     regexp_extract(list_filter(ls, lambda x: regexp_matches(x, '(?i)^from\s*[：:]\s*(.+)$'))[1], '(?i)^from\s*[：:]\s*(.+)$', 1)) AS sd FROM h)
SELECT opinion_id, substr(regexp_replace(regexp_replace(lower(trim(sj)), '\s+', ' ', 'g'), '^(re|fw|fwd|wg|aw|回复|转发)\s*[:,：\[\s-]+', ''), 1, 800) AS subject,
  substr(regexp_replace(regexp_replace(lower(trim(sd)), '\s+', ' ', 'g'), '^(re|fw|fwd|wg|aw|回复|转发)\s*[:,：\[\s-]+', ''), 1, 800) AS sender,
  true AS is_mail,
  regexp_matches(lower(source), '邮件|email|e-mail|outlook|exchange|smtp|邮箱') AS raw_is_mail
FROM f""")
def _(spark, d):
    nl = F.lit("\n")
    o = opinion(spark, d).withColumn("body", F.concat(
        F.lit("标题：old\n主题: RE: "), "source", F.lit("  Case "), "vin", nl, F.lit("From: "), "phone", F.lit(" <x@y>\n"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("发件人: FW: "), "car_model", F.lit(" z\n"))).otherwise(""),
        "original_text"))
    subject, sender = tx.email_headers("body")
    return o.select("opinion_id", subject.alias("subject"), sender.alias("sender"),
                    tx.is_email_like("body", "source").alias("is_mail"),
                    tx.is_email_like("original_text", "source").alias("raw_is_mail"))


@query("text_fingerprint", f"""
SELECT doc_id, md5({q.sq('text')}) AS dedupe_key, md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS gold_key
FROM documents""", needs_opinion=False)
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.dedupe_key("text").alias("dedupe_key"), tx.gold_key("text").alias("gold_key"))


def tokens_sql(x: str) -> str:
    drop = lit_list(wp.STOP_WORDS + wp.GENERAL_WORDS)
    return (f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^一-龥a-z0-9]+', ' ', 'g')), ' '), "
            f"lambda w: length(w) >= 2 AND w NOT IN ({drop}) AND NOT regexp_full_match(w, '[0-9]+'))")


@query("keyword_tokens", f"""
SELECT doc_id, len({tokens_sql('text')}) AS n, md5(array_to_string({tokens_sql('text')}, ' ')) AS tokens FROM documents""",
       needs_opinion=False)
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.keyword_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.concat_ws(" ", "t")).alias("tokens"))


@query("compact_text", f"""
SELECT conv_id, turn, CASE WHEN length({q.s('text')}) <= 200 THEN {q.s('text')} ELSE substr({q.s('text')}, 1, 140) || chr(10) || '……（中间超长内容已省略）……' || chr(10) || right({q.s('text')}, 60) END AS short_text
FROM conversations""", needs_opinion=False)
def _(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(
        "conv_id", "turn", tx.compact("text", 200).alias("short_text"))


@query("split_phrases", f"""
WITH t AS (SELECT opinion_id, coalesce(nullif({q.js('v3_label_meta', 'l3_phrases')}, ''), {q.js('v3_label_meta', 'l3')}, '') AS raw, model_keyword FROM opinion),
 a AS (SELECT opinion_id, string_split(replace(CASE WHEN raw <> '' THEN raw ELSE model_keyword END, '，', ','), ',') AS arr FROM t)
SELECT opinion_id, array_to_string(list_slice(list_filter(list_transform(arr, lambda p: trim(p)), lambda p: length(p) BETWEEN 2 AND 18), 1, 8), '|') AS phrases FROM a""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", F.concat_ws("|", tx.phrases("v3_label_meta", "model_keyword")).alias("phrases"))


def insight_ctes(src: str = "opinion", pack: dict = prose.INSIGHT) -> str:
    """CTEs ``lab`` (labels) and ``ins`` (labels plus the six insight fields)."""
    hits = ", ".join(f"regexp_matches(coalesce(original_text,''), '(?i){v}') AS h_{k}" for k, v in pack.items())
    return f"""lab AS (SELECT *, {q.INS_L1} AS l1, {q.INS_L2} AS l2, {q.INS_L3} AS l3, {hits} FROM {src}),
 ins1 AS (SELECT *, CASE WHEN h_praise AND NOT h_fault AND NOT h_escalate THEN '表扬' WHEN h_escalate THEN '投诉升级'
   WHEN h_help THEN '求助' WHEN h_suggest AND NOT h_fault THEN '建议' WHEN h_fault THEN '报障' WHEN h_consult THEN '咨询'
   WHEN l1 = '非问题' THEN (CASE WHEN h_inform THEN '告知' ELSE '咨询' END) WHEN h_inform THEN '告知'
   WHEN l1 = '产品质量类' THEN '报障' ELSE '告知' END AS intent FROM lab),
 ins2 AS (SELECT *, CASE WHEN h_refund THEN '退款赔偿' WHEN h_visit THEN '上门' WHEN h_repair THEN '维修'
   WHEN h_feature OR intent = '建议' THEN '功能实现' WHEN h_explain OR intent IN ('咨询','告知') THEN '解释说明'
   WHEN intent = '表扬' THEN '无需动作' ELSE '维修' END AS expected_action,
   CASE WHEN h_severe OR intent = '投诉升级' THEN '高' WHEN h_moderate OR intent IN ('报障','求助') THEN '中' ELSE '低' END AS severity FROM ins1),
 ins AS (SELECT *, CASE WHEN h_urgent OR severity = '高' THEN '紧急' ELSE '一般' END AS urgency, h_repeat AS repeat_signal,
   substr(CASE WHEN l3 <> '' AND l3 NOT IN ('通用','其他-待归类') THEN l3 WHEN l2 <> '' THEN l2
     ELSE trim(regexp_replace(original_text, '{WS}+', ' ', 'g')) END, 1, 40) AS root_cause_hint FROM ins2)"""


def with_labels(o):
    l1, l2, l3 = labels.insight_labels()
    return o.withColumns({"l1": l1, "l2": l2, "l3": l3})


@query("insight_fields", f"""
WITH {insight_ctes()}
SELECT opinion_id, intent, expected_action, severity, urgency, repeat_signal, root_cause_hint FROM ins""")
def _(spark, d):
    o = insight.with_insight_fields(with_labels(opinion(spark, d)), rules=prose.INSIGHT)
    return o.select("opinion_id", "intent", "expected_action", "severity", "urgency", "repeat_signal", "root_cause_hint")


@query("attach_insight_fields", f"""
WITH {insight_ctes()}
SELECT opinion_id, intent, root_cause_hint, {q.js('v3_label_meta', 'l1')} AS l1, {q.js('v3_label_meta', 'l2')} AS l2,
       {q.js('v3_label_meta', 'confidence')} AS confidence, true AS core_unchanged FROM ins""")
def _(spark, d):
    o = insight.with_insight_fields(with_labels(opinion(spark, d)), rules=prose.INSIGHT)
    keys = ("intent", "expected_action", "severity", "urgency", "repeat_signal", "root_cause_hint")
    m = o.withColumn("m2", insight.attach_insight("v3_label_meta", {k: F.col(k) for k in keys}))
    core = ("l1", "l2", "l3", "confidence", "match_type")
    same = F.lit(True)
    for k in core:
        same = same & meta.json_get("m2", k).eqNullSafe(meta.json_get("v3_label_meta", k))
    return m.select("opinion_id", meta.json_get("m2", "intent").alias("intent"),
                    meta.json_get("m2", "root_cause_hint").alias("root_cause_hint"),
                    *[meta.json_get("m2", k).alias(k) for k in ("l1", "l2", "confidence")],
                    same.alias("core_unchanged"))


@query("time_bucket", f"""
WITH t AS (SELECT opinion_id, CAST({q.EVENT_TS} AS DATE) AS day FROM opinion)
SELECT opinion_id, strftime(day, '%Y-%m-%d') AS d, strftime(day, '%G-W%V') AS w, strftime(day, '%Y-%m') AS m FROM t""")
def _(spark, d):
    o = opinion(spark, d).select("opinion_id", dates.event_time().cast("date").alias("day"))
    return o.select("opinion_id", *[dates.time_bucket(F.col("day"), g).alias(g[0]) for g in ("day", "week", "month")])


@query("iso_event_day", f"SELECT opinion_id, CAST({q.ISO_DAY} AS VARCHAR) AS day FROM opinion")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", dates.iso_event_day().cast("string").alias("day"))


@query("list_canonical_l1", f"""
SELECT opinion_id, {q.canon(q.ff('review_l1', 'v3_l1', q.js('v3_label_meta', 'l1'), 'model_class'))} AS canonical_l1 FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", labels.list_canonical_l1().alias("canonical_l1"))


def legacy_sql(x: str) -> str:
    out = (f"(CASE WHEN coalesce({x},'') = '' THEN NULL WHEN {x} = '产品质量类' THEN '质量问题' WHEN {x} = '服务类' THEN '营销服务' "
           f"WHEN {x} = '体验需求类' THEN '体验需求' WHEN {x} = '非问题' THEN '非问题'")
    for n in ("质量问题", "营销服务", "体验需求", "咨询", "非问题"):
        out += f" WHEN contains({x}, '{n}') OR contains('{n}', {x}) THEN '{n}'"
    return out + " END)"


@query("legacy_class_map", f"""
SELECT opinion_id, {legacy_sql('review_l1')} AS human, {legacy_sql('model_class')} AS feed, {legacy_sql("concat('x', model_class)")} AS holds
FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select(
        "opinion_id", labels.legacy_class("review_l1").alias("human"), labels.legacy_class("model_class").alias("feed"),
        labels.legacy_class(F.concat(F.lit("x"), "model_class")).alias("holds"))
