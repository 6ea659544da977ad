"""Accuracy, replay, comparison and training-set queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plaintide.functions import labels
from plaintide.functions.dates import event_time
from plaintide.operators import evaluate as ev, hooks, trainset as ts
from plaintide.packs import labels as lp, prose
from plaintide.plans import duck as q
from plaintide.plans.fixture import AS_OF, opinion, table
from plaintide.plans.registry import query

# Canonical labels of both sides over reviewed rows.
PAIR = f"""pr AS (SELECT *, {q.canon_b('review_l1')} AS human_l1, {q.s('review_l2')} AS human_l2, {q.canon_b(q.MOD_L1)} AS model_l1, {q.MOD_L2} AS model_l2,
  {q.EVENT_TS} AS ets FROM opinion WHERE review_status = 1)"""
JDG = "(human_l1 <> '' AND model_l1 <> '')"
BIZ = "human_l1 IN ('产品质量类','服务类','体验需求类')"
OPEN = f"({JDG} AND {BIZ} AND human_l1 = model_l1)"
L2 = f"({OPEN} AND human_l2 <> '')"
ACC = f"""count(*) AS total_reviewed, count(*) FILTER (WHERE {JDG}) AS l1_denominator, count(*) FILTER (WHERE {JDG} AND human_l1 = model_l1) AS l1_correct,
  count(*) FILTER (WHERE {L2}) AS l2_denominator, count(*) FILTER (WHERE {L2} AND human_l2 = model_l2) AS l2_correct,
  count(*) FILTER (WHERE human_l1 = '') AS skipped_no_human_l1, count(*) FILTER (WHERE human_l1 <> '' AND model_l1 = '') AS skipped_no_model_l1,
  count(*) FILTER (WHERE {JDG} AND NOT {OPEN}) AS skipped_l2_nonissue_or_mismatch, count(*) FILTER (WHERE {OPEN} AND human_l2 = '') AS skipped_l2_no_human_l2"""
RATES = f"{q.share('l1_correct', 'l1_denominator')} AS l1_accuracy, {q.share('l2_correct', 'l2_denominator')} AS l2_accuracy"


@query("accuracy_report", f"WITH {PAIR}, a AS (SELECT {ACC} FROM pr) SELECT *, {RATES} FROM a")
def _(spark, d):
    return ev.accuracy_report(opinion(spark, d))


@query("accuracy_by_batch", f"WITH {PAIR}, a AS (SELECT upload_batch, {ACC} FROM pr GROUP BY 1) SELECT *, {RATES} FROM a")
def _(spark, d):
    return ev.accuracy_by_batch(opinion(spark, d))


@query("confusion_pairs", f"""
WITH {PAIR} SELECT * FROM (SELECT 'l1' AS level, concat(model_l1, ' → ', human_l1) AS pair, count(*) AS n FROM pr WHERE {JDG} AND human_l1 <> model_l1 GROUP BY 2 ORDER BY n DESC, pair LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'l2', concat(coalesce(nullif(model_l2,''), '（模型空缺）'), ' → ', human_l2) AS pair, count(*) AS n FROM pr WHERE {L2} AND human_l2 <> model_l2 GROUP BY 2 ORDER BY n DESC, pair LIMIT 10)""")
def _(spark, d):
    o = opinion(spark, d)
    return ev.confusion_pairs(o, "l1").select(F.lit("l1").alias("level"), "pair", "n").unionByName(
        ev.confusion_pairs(o, "l2").select(F.lit("l2").alias("level"), "pair", "n"))


@query("l1_error_rows", f"""
WITH {PAIR} SELECT opinion_id, concat(model_l1, '→', human_l1) AS pair, human_l1, human_l2, model_l1, model_l2 FROM pr
WHERE {JDG} AND human_l1 <> model_l1 AND ets >= TIMESTAMP '2024-03-01 00:00:00'""")
def _(spark, d):
    return ev.l1_error_rows(opinion(spark, d), dt.datetime(2024, 3, 1))


@query("match_type_mix", f"""
WITH {PAIR} SELECT coalesce({q.n('v3_match_type')}, '（空）') AS match_type, count(*) AS n FROM pr WHERE {JDG} GROUP BY 1""")
def _(spark, d):
    return ev.match_type_mix(opinion(spark, d))


POOL = f"""CASE WHEN human_l1 = '非问题' AND model_l1 IN ('产品质量类','服务类','体验需求类') THEN 'primary' WHEN {BIZ} AND model_l1 = '非问题' THEN 'regression'
  WHEN human_l1 <> model_l1 THEN 'other' ELSE 'correct' END"""


@query("error_pools", f"WITH {PAIR} SELECT {POOL} AS pool, count(*) AS n FROM pr WHERE {JDG} GROUP BY 1")
def _(spark, d):
    return ev.error_pools(opinion(spark, d))


# A replay that repairs some labels and breaks others.
REPLAY = f"""rp AS (SELECT *, CASE WHEN id % 3 = 0 THEN human_l1 WHEN id % 17 = 0 THEN '非问题' ELSE model_l1 END AS replay_l1,
  CASE WHEN id % 4 = 0 THEN human_l2 ELSE model_l2 END AS replay_l2 FROM pr WHERE {JDG})"""


def replayed(spark, d):
    p = ev.paired(opinion(spark, d)).filter((F.col("human_l1") != "") & (F.col("model_l1") != ""))
    return p.withColumns({
        "replay_l1": F.when(F.col("id") % 3 == 0, F.col("human_l1")).when(F.col("id") % 17 == 0, lp.NON_ISSUE).otherwise(F.col("model_l1")),
        "replay_l2": F.when(F.col("id") % 4 == 0, F.col("human_l2")).otherwise(F.col("model_l2"))})


def _cmp(lv: str, where: str) -> str:
    b, a = f"model_{lv} = human_{lv}", f"replay_{lv} = human_{lv}"
    f = lambda c: f"count(*) FILTER (WHERE {where} AND {c})"
    return (f"count(*) FILTER (WHERE {where}) AS {lv}_total, {f(b)} AS {lv}_before_correct, {f(a)} AS {lv}_after_correct, "
            f"{f(f'NOT {b} AND {a}')} AS {lv}_fixed, {f(f'{b} AND NOT {a}')} AS {lv}_broken, "
            f"{f(f'NOT {b} AND {a}')} - {f(f'{b} AND NOT {a}')} AS {lv}_net, "
            f"coalesce({q.pct(f(b), f'count(*) FILTER (WHERE {where})')}, 0) AS {lv}_before_pct, coalesce({q.pct(f(a), f'count(*) FILTER (WHERE {where})')}, 0) AS {lv}_after_pct")


@query("replay_compare", f"WITH {PAIR}, {REPLAY} SELECT {_cmp('l1', 'true')}, {_cmp('l2', f'({BIZ} AND model_l1 = human_l1 AND human_l2 <> {chr(39)*2})')} FROM rp")
def _(spark, d):
    return ev.replay_compare(replayed(spark, d))


@query("replay_gate", f"""
WITH {PAIR}, {REPLAY}, g AS (SELECT {POOL} AS pool, count(*) AS pool_size, count(*) FILTER (WHERE model_l1 <> human_l1 AND replay_l1 = human_l1) AS fixable,
  count(*) FILTER (WHERE model_l1 = human_l1 AND replay_l1 <> human_l1) AS broken FROM rp GROUP BY 1)
SELECT *, {q.pct('fixable', '(SELECT count(*) FROM rp)')} AS gain_pp, CASE pool WHEN 'primary' THEN broken <= 2 WHEN 'regression' THEN broken <= 8 ELSE true END AS gate_ok FROM g""")
def _(spark, d):
    return ev.replay_gate(replayed(spark, d))


@query("label_patch_rows", f"""
WITH {PAIR}, {REPLAY}, k AS (SELECT *, CASE WHEN model_l1 <> human_l1 AND replay_l1 = human_l1 THEN 'l1'
   WHEN {BIZ} AND model_l1 = human_l1 AND replay_l1 = human_l1 AND human_l2 <> '' AND model_l2 <> human_l2 AND replay_l2 = human_l2 THEN 'l2' END AS kind FROM rp)
SELECT opinion_id, kind, replay_l1 AS v3_l1, replay_l2 AS v3_l2, {q.s(q.js('v3_label_meta', 'l3'))} AS v3_l3, {q.s(q.js('v3_label_meta', 'l3_phrases'))} AS kept FROM k WHERE kind IS NOT NULL""")
def _(spark, d):
    from plaintide.functions.meta import json_text
    p = ev.label_patch_rows(replayed(spark, d), "2024-06-30")
    return p.select("opinion_id", "kind", "v3_l1", "v3_l2", "v3_l3", json_text("v3_label_meta", "l3_phrases").alias("kept"))


@query("weekly_period_stats", f"""
WITH {PAIR}, j AS (SELECT *, coalesce(ets >= TIMESTAMP '2024-04-01 00:00:00', false) AS inp FROM pr WHERE {JDG}),
 t AS (SELECT concat(model_l1, ' → ', human_l1) AS pair, count(*) AS n FROM j WHERE inp AND human_l1 <> model_l1 GROUP BY 1 ORDER BY n DESC, pair LIMIT 5),
 a AS (SELECT count(*) FILTER (WHERE inp) AS new_reviewed, count(*) FILTER (WHERE inp AND human_l1 <> model_l1) AS new_l1_wrong,
  greatest(count(*) - 100, 0) AS delta_reviewed, greatest(count(*) FILTER (WHERE human_l1 <> model_l1) - 10, 0) AS delta_mismatch FROM j)
SELECT *, (SELECT string_agg(concat(pair, ':', n), '|' ORDER BY n DESC, pair) FROM t) AS top_pairs,
  concat_ws(',', CASE WHEN delta_reviewed >= 50 THEN 'reviewed' END, CASE WHEN delta_mismatch >= 800 THEN 'mismatch' END, 'quiet') AS ready_reasons, true AS ready FROM a""")
def _(spark, d):
    return ev.weekly_period_stats(opinion(spark, d), dt.datetime(2024, 4, 1), 100, 10, quiet_weeks=3, fixable=1, need_reviewed=50)


# Evaluation points: one per user and day of the event log.
POINTS = """pts AS (SELECT event_id AS seq, date_trunc('hour', ts) AS eval_time, CASE WHEN event_id % 3 = 0 THEN concat('report:', event_type) ELSE event_type END AS source,
   CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE round(value, 2) END AS l1_accuracy_pct, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE round(value - 1, 2) END AS l2_accuracy_pct, user_id AS cumulative_reviewed FROM events)"""


def points(spark, d):
    e = table(spark, d, "events")
    zero = F.col("event_id") % 11 == 0
    return e.select(F.col("event_id").alias("seq"), F.date_trunc("hour", "ts").alias("eval_time"),
                    F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("report:"), "event_type")).otherwise(F.col("event_type")).alias("source"),
                    F.when(zero, 0.0).otherwise(F.round("value", 2)).alias("l1_accuracy_pct"),
                    F.when(zero, 0.0).otherwise(F.round(F.col("value") - 1, 2)).alias("l2_accuracy_pct"), F.col("user_id").alias("cumulative_reviewed"))


@query("accuracy_timeline", f"""
WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY eval_time ORDER BY CASE WHEN starts_with(source, 'report:') THEN 2 ELSE 1 END DESC, seq DESC) AS rn FROM pts),
 k AS (SELECT * FROM r WHERE rn = 1 AND NOT (l1_accuracy_pct = 0 AND l2_accuracy_pct = 0))
SELECT strftime(eval_time, '%Y-%m-%d %H:%M:%S') AS eval_time, source, l1_accuracy_pct, round(l1_accuracy_pct - lag(l1_accuracy_pct) OVER (ORDER BY k.eval_time), 2) AS delta_l1_pp,
  round(l2_accuracy_pct - lag(l2_accuracy_pct) OVER (ORDER BY k.eval_time), 2) AS delta_l2_pp, cumulative_reviewed - lag(cumulative_reviewed) OVER (ORDER BY k.eval_time) AS delta_reviewed FROM k""",
       needs_opinion=False)
def _(spark, d):
    t = ev.accuracy_timeline(points(spark, d))
    return t.select(F.date_format("eval_time", "yyyy-MM-dd HH:mm:ss").alias("eval_time"), "source", "l1_accuracy_pct", "delta_l1_pp", "delta_l2_pp", "delta_reviewed")


@query("accuracy_history", f"""
WITH {POINTS}, h AS (SELECT eval_time, max(l1_accuracy_pct) AS accuracy FROM pts GROUP BY 1)
SELECT strftime(eval_time, '%Y-%m-%d %H:%M:%S') AS timestamp, accuracy, accuracy >= 98 AS auto_mode FROM h ORDER BY eval_time DESC LIMIT 30""", needs_opinion=False)
def _(spark, d):
    h = points(spark, d).groupBy(F.col("eval_time").alias("timestamp")).agg(F.max("l1_accuracy_pct").alias("accuracy"))
    cut = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    out = ev.accuracy_history(h.filter(F.col("timestamp") < cut), h.filter(F.col("timestamp") >= cut))
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("ab_compare", f"""
WITH h AS (SELECT {q.canon_b('review_l1')} AS h, {q.canon_b('v3_l1')} AS b, {q.canon_b('model_class')} AS k FROM opinion WHERE review_status = 1 AND id % 10 = 3 OR review_status = 1 AND id % 10 = 7),
 a AS (SELECT count(*) FILTER (WHERE b <> '') AS baseline_total, count(*) FILTER (WHERE b = h) AS baseline_correct, count(*) FILTER (WHERE k <> '') AS candidate_total, count(*) FILTER (WHERE k = h) AS candidate_correct FROM h WHERE h <> ''),
 p AS (SELECT *, {q.pct('baseline_correct', 'baseline_total')} AS baseline_pct, {q.pct('candidate_correct', 'candidate_total')} AS candidate_pct FROM a)
SELECT *, round(candidate_pct - baseline_pct, 2) AS delta_pp, round(candidate_pct - baseline_pct, 2) >= 2.0 AS candidate_beats FROM p""")
def _(spark, d):
    hold = opinion(spark, d).filter(labels.is_reviewed() & (F.col("id") % 10).isin(3, 7))
    return ev.ab_compare(hold, F.col("v3_l1"), F.col("model_class"))


KEYED = "CASE WHEN mx = 0 THEN '' " + " ".join(f"WHEN s{i} = mx THEN '{c}'" for i, (c, _, _) in enumerate(prose.PACK["weights"])) + " END"
WEIGHED = ", ".join(f"{w} * ({' + '.join(f'contains(lower(original_text), {chr(39)}{x.lower()}{chr(39)})::INT' for x in ws)}) AS s{i}" for i, (_, w, ws) in enumerate(prose.PACK["weights"]))


@query("ab_compare_model", f"""
WITH s AS (SELECT *, {WEIGHED} FROM opinion WHERE review_status = 1 AND id % 10 IN (3, 7)), m AS (SELECT *, greatest({', '.join(f's{i}' for i in range(len(prose.PACK['weights'])))}) AS mx FROM s),
 h AS (SELECT {q.canon_b('review_l1')} AS h, {q.canon_b('v3_l1')} AS b, {q.canon_b('guess')} AS k FROM (SELECT *, {KEYED} AS guess FROM m)),
 a AS (SELECT count(*) FILTER (WHERE b <> '') AS baseline_total, count(*) FILTER (WHERE b = h) AS baseline_correct, count(*) FILTER (WHERE k <> '') AS candidate_total, count(*) FILTER (WHERE k = h) AS candidate_correct FROM h WHERE h <> ''),
 p AS (SELECT *, {q.pct('baseline_correct', 'baseline_total')} AS baseline_pct, {q.pct('candidate_correct', 'candidate_total')} AS candidate_pct FROM a)
SELECT *, round(candidate_pct - baseline_pct, 2) AS delta_pp, round(candidate_pct - baseline_pct, 2) >= 2.0 AS candidate_beats FROM p""")
def _(spark, d):
    hold = opinion(spark, d).filter(labels.is_reviewed() & (F.col("id") % 10).isin(3, 7)).select("original_text", "review_l1", "v3_l1")
    asked = hooks.apply_model(hold, hooks.keyword_model(prose.PACK))
    return ev.ab_compare(asked, F.col("v3_l1"), F.col("prediction"))


def _chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ''))"


def jac_sql(a: str, b: str) -> str:
    x, y = _chars(a), _chars(b)
    return (f"(CASE WHEN len({x}) >= 2 AND len({y}) >= 2 THEN len(list_intersect({x}, {y}))::DOUBLE / "
            f"len(list_distinct(list_concat({x}, {y}))) ELSE 0 END)")


TAX = f"""tx AS (SELECT opinion_id, coalesce(review_l1,'') AS human_l1, coalesce(review_l2,'') AS human_l2, coalesce(review_l3,'') AS human_l3, v3_l1 AS auto_l1,
   concat(v3_l2, CASE WHEN id % 5 = 0 THEN '问题' ELSE '' END) AS auto_l2, concat(v3_l3, CASE WHEN id % 3 = 0 THEN '其他描述' ELSE '' END) AS auto_l3 FROM opinion WHERE review_status = 1),
 ok AS (SELECT *, human_l1 <> '' AND auto_l1 = human_l1 AS l1_ok, human_l2 <> '' AND auto_l2 = human_l2 AS l2_ok, human_l3 <> '' AND auto_l3 = human_l3 AS l3_ok FROM tx),
 cp AS (SELECT *, l1_ok AND (l2_ok OR {jac_sql('auto_l2', 'human_l2')} >= 0.28) AS l2_compat, l1_ok AND (l3_ok OR {jac_sql('auto_l3', 'human_l3')} >= 0.22) AS l3_compat FROM ok)"""


def taxed(spark, d):
    o = opinion(spark, d).filter(labels.is_reviewed())
    e = lambda c: F.coalesce(c, F.lit(""))
    return o.select("opinion_id", *[e(f"review_{k}").alias(f"human_{k}") for k in ("l1", "l2", "l3")], F.col("v3_l1").alias("auto_l1"),
                    F.concat("v3_l2", F.when(F.col("id") % 5 == 0, "问题").otherwise("")).alias("auto_l2"),
                    F.concat("v3_l3", F.when(F.col("id") % 3 == 0, "其他描述").otherwise("")).alias("auto_l3"))


@query("taxonomy_match_report", f"""
WITH {TAX}, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE l1_ok) AS l1_match, count(*) FILTER (WHERE l2_ok) AS l2_match, count(*) FILTER (WHERE l3_ok) AS l3_match,
  count(*) FILTER (WHERE l2_compat) AS l2_compat, count(*) FILTER (WHERE l3_compat) AS l3_compat FROM cp)
SELECT *, {q.pct('l1_match', 'total')} AS l1_rate, {q.pct('l2_match', 'total')} AS l2_rate, {q.pct('l3_match', 'total')} AS l3_rate,
  {q.pct('l2_compat', 'l1_match')} AS l2_compat_rate, {q.pct('l3_compat', 'l1_match')} AS l3_compat_rate FROM a""")
def _(spark, d):
    return ev.taxonomy_match_report(taxed(spark, d))


@query("taxonomy_match_rows", f"""
WITH {TAX} SELECT opinion_id, l2_compat, l3_compat, concat_ws('/', CASE WHEN NOT l1_ok THEN '一级' END, CASE WHEN NOT l2_ok THEN '二级' END, CASE WHEN NOT l3_ok THEN '三级' END) AS reason FROM cp
WHERE NOT (l1_ok AND l2_ok AND l3_ok)""")
def _(spark, d):
    return ev.taxonomy_match_rows(taxed(spark, d)).filter(F.col("reason") != "").select("opinion_id", "l2_compat", "l3_compat", "reason")


@query("route_metrics", """
WITH m AS (SELECT id % 29 = 0 AS emp, CASE WHEN id % 19 = 0 THEN 'classify_error' WHEN id % 23 = 0 THEN 'qwen_parse_failed' ELSE v3_match_type END AS mt, id % 6 = 0 AS um, id % 12 = 0 AS ch,
   id % 7 = 0 AS wc, CASE WHEN id % 14 = 0 THEN 'pq' ELSE '' END AS ck, id % 5 = 0 AS gd, id % 31 = 0 AS nr, v3_confidence AS cf FROM opinion),
 r AS (SELECT *, CASE WHEN emp THEN 'skipped_empty' WHEN mt = 'gold_review' THEN 'gold_hit' WHEN um AND mt IN ('qwen_row_failed','classify_error') THEN 'llm_failed' WHEN um AND ch THEN 'llm_cache_hit'
   WHEN um THEN 'llm_arbitrated' WHEN wc THEN 'conflict' WHEN mt IN ('classify_error','none') THEN 'failed'
   WHEN nr OR mt = 'qwen_parse_failed' OR cf < 0.52 THEN 'rule_low_conf' ELSE 'rule_ok' END AS route FROM m)
SELECT route, CASE WHEN route = 'conflict' THEN ck ELSE '' END AS kind, count(*) AS n, count(*) FILTER (WHERE gd AND route IN ('rule_ok','rule_low_conf')) AS guard_triggered FROM r GROUP BY 1, 2""")
def _(spark, d):
    i = F.col("id")
    m = opinion(spark, d).select(
        (i % 29 == 0).alias("empty_text"), F.when(i % 19 == 0, "classify_error").when(i % 23 == 0, "qwen_parse_failed").otherwise(F.col("v3_match_type")).alias("match_type"),
        (i % 6 == 0).alias("use_model"), (i % 12 == 0).alias("cache_hit"), (i % 7 == 0).alias("was_conflict"), F.when(i % 14 == 0, "pq").otherwise("").alias("conflict_kind"),
        (i % 5 == 0).alias("guard"), (i % 31 == 0).alias("needs_review"), F.col("v3_confidence").alias("confidence"))
    return ev.route_metrics(m, F.col("use_model"))


PACK = {"domain": "tion", "praise": "eau", "consult": "nt", "issue": "the"}
_H = {k: f"regexp_matches(original_text, '(?i){v}')" for k, v in PACK.items()}
AMB = f"""{PAIR}, dm AS (SELECT *, human_l1 = '非问题' AND model_l1 = '产品质量类' AS flip, {_H['consult']} AND NOT {_H['issue']} AS asks, {_H['issue']} AS iss, {_H['praise']} AS prs, {_H['domain']} AS dom FROM pr WHERE {JDG}),
 c AS (SELECT *, list_filter([CASE WHEN dom THEN (CASE WHEN human_l2 = 'L2-0' AND model_l2 IN ('L2-1','L2-2') THEN 'lfc_consult_vs_lfc' WHEN human_l2 IN ('L2-1','L2-2') AND model_l2 = 'L2-0' THEN 'lfc_lfc_vs_consult'
     WHEN flip THEN (CASE WHEN asks THEN 'lfc_pure_consult' WHEN iss THEN 'lfc_issue_signal' END) WHEN human_l1 <> model_l1 AND asks THEN 'lfc_pure_consult' END) END,
   CASE WHEN flip AND prs THEN 'praise_vs_product' END, CASE WHEN human_l1 = '非问题' AND model_l1 = '服务类' AND prs THEN 'sales_praise_boundary' END,
   CASE WHEN flip THEN 'top_l1_product_nonissue' WHEN model_l1 = '服务类' AND human_l1 = '非问题' THEN 'top_l1_service_nonissue' WHEN model_l1 = '非问题' AND human_l1 = '产品质量类' THEN 'top_l1_nonissue_product'
     WHEN model_l1 = '非问题' AND human_l1 = '服务类' THEN 'top_l1_nonissue_service' END], lambda x: x IS NOT NULL) AS rs FROM dm)"""
SCORE = """(list_max(list_transform(rs, lambda r: CASE r WHEN 'lfc_consult_vs_lfc' THEN 100 WHEN 'lfc_lfc_vs_consult' THEN 98 WHEN 'lfc_pure_consult' THEN 95 WHEN 'lfc_issue_signal' THEN 92
  WHEN 'top_l1_nonissue_product' THEN 88 WHEN 'praise_vs_product' THEN 85 WHEN 'sales_praise_boundary' THEN 82 WHEN 'top_l1_product_nonissue' THEN 75 WHEN 'top_l1_service_nonissue' THEN 65 WHEN 'top_l1_nonissue_service' THEN 60 ELSE 10 END))
  + least(5, len(rs) - 1))::INT"""
AMB_KW = dict(rules=PACK, domain_l2=("L2-1", "L2-2"), consult_l2="L2-0")


@query("ambiguity_queue", f"""
WITH {AMB} SELECT opinion_id, human_l1, human_l2, model_l1, model_l2, array_to_string(rs, '|') AS reasons, {SCORE} AS score FROM c WHERE len(rs) > 0 ORDER BY score DESC, opinion_id LIMIT 30""")
def _(spark, d):
    return ev.ambiguity_queue(opinion(spark, d), 30, **AMB_KW)


@query("ambiguity_reason_counts", f"WITH {AMB}, u AS (SELECT unnest(rs) AS reason FROM c) SELECT reason, count(*) AS n FROM u GROUP BY 1")
def _(spark, d):
    return ev.ambiguity_reason_counts(opinion(spark, d), **AMB_KW)


@query("action_hints", f"""
WITH {PAIR}, {REPLAY}, f AS (SELECT count(*) FILTER (WHERE {JDG}) AS t, count(*) FILTER (WHERE {JDG} AND human_l1 = model_l1) AS k FROM pr),
 w AS (SELECT count(*) FILTER (WHERE {JDG}) AS t, count(*) FILTER (WHERE {JDG} AND human_l1 = model_l1) AS k FROM pr WHERE ets >= TIMESTAMP '2024-06-01 00:00:00'),
 r AS (SELECT count(*) FILTER (WHERE model_l1 = human_l1 AND replay_l1 <> human_l1) AS b, count(*) FILTER (WHERE model_l1 <> human_l1 AND replay_l1 = human_l1) AS fx FROM rp),
 v AS (SELECT f.k * 100.0::DOUBLE / f.t AS fp, w.t, w.k * 100.0::DOUBLE / w.t AS wp, b, fx FROM f, w, r)
SELECT 'few_rows' AS hint FROM v WHERE t < 80 UNION ALL SELECT CASE WHEN wp >= 84 THEN 'stable' WHEN wp >= 80 THEN 'watch_top_errors' ELSE 'iterate_rules' END FROM v
UNION ALL SELECT 'report_both_windows' FROM v WHERE fp - wp > 2
UNION ALL SELECT h FROM (SELECT CASE WHEN b > 8 THEN 'narrow_rules' WHEN b = 0 AND fx >= 20 THEN 'rules_healthy' WHEN b <= 3 THEN 'rules_acceptable' END AS h FROM v) WHERE h IS NOT NULL""")
def _(spark, d):
    o = opinion(spark, d)
    win = o.filter(event_time() >= F.lit(dt.datetime(2024, 6, 1)))
    return ev.action_hints(ev.accuracy_report(o), ev.accuracy_report(win), ev.replay_compare(replayed(spark, d)))


@query("audit_sample", f"""
SELECT opinion_id, md5(concat(opinion_id, '|42')) AS sample_key FROM opinion WHERE {q.EVENT_TS} >= TIMESTAMP '2024-05-31 00:00:00' AND {q.EVENT_TS} < TIMESTAMP '2024-07-01 00:00:00'
ORDER BY 2, 1 LIMIT 50""")
def _(spark, d):
    return ev.audit_sample(opinion(spark, d), AS_OF, 30).select("opinion_id", "sample_key")


COL = f"""tc AS (SELECT id, opinion_id, {q.s('original_text')} AS original_text, {q.s('review_l1')} AS review_l1, {q.s('review_l2')} AS review_l2, {q.canon('review_l1')} AS human_l1,
   {q.canon_b(q.MOD_L1)} AS model_l1, {q.MOD_L2} AS model_l2 FROM opinion WHERE review_status = 1 AND {q.s('review_l1')} <> '' AND {q.s('original_text')} <> '')"""
HARD = "(human_l1 <> '' AND model_l1 <> '' AND human_l1 <> model_l1)"
SPLIT = f"""sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat(opinion_id, '|42')), opinion_id) <= greatest(1, round_even((SELECT count(*) FROM tc) * 0.1::DOUBLE, 0)) THEN 'holdout' ELSE 'train' END AS split FROM tc)"""


@query("training_collect", f"WITH {COL} SELECT * EXCLUDE (original_text), md5(original_text) AS body FROM tc")
def _(spark, d):
    return ts.training_collect(opinion(spark, d)).withColumn("body", F.md5("original_text")).drop("original_text")


@query("holdout_split", f"WITH {COL}, {SPLIT} SELECT opinion_id, split FROM sp")
def _(spark, d):
    return ts.holdout_split(ts.training_collect(opinion(spark, d)).drop("original_text")).select("opinion_id", "split")


@query("holdout_reuse", f"WITH {COL} SELECT opinion_id, CASE WHEN id % 9 = 0 THEN 'holdout' ELSE 'train' END AS split FROM tc")
def _(spark, d):
    o = opinion(spark, d)
    stored = o.filter(F.col("id") % 9 == 0).select("opinion_id")
    return ts.holdout_split(ts.training_collect(o), stored=stored).select("opinion_id", "split")


@query("hard_negative_order", f"WITH {COL} SELECT opinion_id, {HARD} AS hard, row_number() OVER (ORDER BY {HARD} DESC, id) AS position FROM tc")
def _(spark, d):
    return ts.hard_negative_order(ts.training_collect(opinion(spark, d)).drop("original_text")).select("opinion_id", "hard", "position")


@query("stratified_first", f"""
WITH {COL}, r AS (SELECT *, row_number() OVER (PARTITION BY human_l1 ORDER BY id) <= greatest(1, floor((SELECT count(*) FROM tc) * 0.15::DOUBLE + 0.9999)) AS lead FROM tc)
SELECT opinion_id, lead, row_number() OVER (ORDER BY CASE WHEN NOT lead THEN 99 WHEN human_l1 = '产品质量类' THEN 1 WHEN human_l1 = '体验需求类' THEN 2 WHEN human_l1 = '服务类' THEN 3 ELSE 4 END, id) AS position FROM r""")
def _(spark, d):
    return ts.stratified_first(ts.training_collect(opinion(spark, d)).drop("original_text")).select("opinion_id", "lead", "position")


@query("class_balance", f"""
WITH {COL}, n AS (SELECT human_l1 AS l, count(*) AS n FROM tc GROUP BY 1), k AS (SELECT (SELECT max(n) FROM n WHERE l IN ('产品质量类','服务类','体验需求类')) AS target,
   (SELECT n FROM n WHERE l = '体验需求类') AS have, greatest(1, floor((SELECT count(*) FROM tc) * 0.02::DOUBLE)) AS cap),
 r AS (SELECT *, row_number() OVER (PARTITION BY human_l1 ORDER BY md5(concat(opinion_id, '|42')), opinion_id) AS rn FROM tc)
SELECT opinion_id, human_l1, unnest(generate_series(0, CASE WHEN human_l1 = '体验需求类' THEN greatest((target - rn) // have, 0) ELSE 0 END))::INT AS copy FROM r, k WHERE human_l1 <> '非问题' OR rn <= cap""")
def _(spark, d):
    return ts.class_balance(ts.training_collect(opinion(spark, d)).drop("original_text"), cap_share=0.02).select("opinion_id", "human_l1", "copy")


@query("train_valid_test", f"""
WITH {COL}, r AS (SELECT opinion_id, row_number() OVER (ORDER BY md5(concat(opinion_id, '|7')), opinion_id) AS rn, floor((SELECT count(*) FROM tc) * 0.9::DOUBLE) AS a, floor((SELECT count(*) FROM tc) * 0.05::DOUBLE) AS b FROM tc)
SELECT opinion_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'valid' ELSE 'test' END AS split FROM r""")
def _(spark, d):
    return ts.train_valid_test(ts.training_collect(opinion(spark, d)).drop("original_text"), seed=7).select("opinion_id", "split")


@query("shard_groups", """
WITH r AS (SELECT opinion_id, ((row_number() OVER (ORDER BY id) - 1) % 7)::INT AS shard FROM opinion) SELECT opinion_id, shard FROM r WHERE shard NOT IN (1, 4)""")
def _(spark, d):
    o = opinion(spark, d).select("id", "opinion_id")
    done = spark.range(1, 5, 3).select(F.col("id").cast("int").alias("shard"))
    return ts.shard_groups(o, 7, done).select("opinion_id", "shard")


@query("training_summary", f"""
WITH {COL}, {SPLIT} SELECT 'size' AS metric, 'collected' AS item, count(*) AS n FROM sp UNION ALL SELECT 'size', 'holdout', count(*) FROM sp WHERE split = 'holdout'
UNION ALL SELECT 'size', 'train', count(*) FROM sp WHERE split = 'train' UNION ALL SELECT 'size', 'hard_negative', count(*) FROM sp WHERE split = 'train' AND {HARD}
UNION ALL SELECT 'class', human_l1, count(*) FROM sp WHERE split = 'train' GROUP BY human_l1""")
def _(spark, d):
    return ts.training_summary(ts.holdout_split(ts.training_collect(opinion(spark, d)).drop("original_text")))
