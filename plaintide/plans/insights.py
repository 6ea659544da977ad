"""Theme, evidence and cross-record queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.functions.common import dim
from plaintide.operators import insight as ins
from plaintide.operators.filters import split_windows
from plaintide.packs import labels as lp, prose
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion
from plaintide.plans.registry import query
from plaintide.session import materialise
from plaintide.plans.scalars import car_sql, insight_ctes

# A small theme map in the usual shape: path to theme id; one L2 is left out, so it falls back.
THEMES = [(f"T{i:02d}", f"主题{i}") for i in range(1, 7)]
THEME_MAP = [(f"{l1}/L2-{b}/L3-{c}", f"T{(i * 5 + b * 3 + c) % 6 + 1:02d}")
             for i, l1 in enumerate(lp.L1_ORDER) for b in range(4) for c in range(3)]
_VALUES = ", ".join(f"('{p}', '{t}')" for p, t in THEME_MAP)
_NAMES = ", ".join(f"('{t}', '{n}')" for t, n in THEMES)

ENR = f"""{insight_ctes()},
 tm(path, tid) AS (VALUES {_VALUES}), tn(tid, name) AS (VALUES {_NAMES}),
 en AS (SELECT ins.* EXCLUDE (vin, phone, country), concat(l1, '/', l2, '/', l3) AS path, coalesce(tm.tid, 'T99') AS theme_id, coalesce(tn.name, tm.tid, '其他-待归类') AS theme_name,
   review_status = 1 AS reviewed, {q.EVENT_TS} AS ets, {car_sql()} AS car, upper({q.s('vin')}) AS vin, {q.s('phone')} AS phone, {q.s('country')} AS country
   FROM ins LEFT JOIN tm ON tm.path = concat(l1, '/', l2, '/', l3) LEFT JOIN tn ON tn.tid = tm.tid),
 mb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme_id, opinion_id ORDER BY id) AS mrn FROM en WHERE l1 <> '' AND l3 <> '') WHERE mrn = 1)"""


def dims(spark):
    return dim(spark, THEME_MAP, "path string, theme_id string"), dim(spark, THEMES, "theme_id string, name string")


def enriched(spark, d):
    return ins.insight_enrich(opinion(spark, d), *dims(spark), rules=prose.INSIGHT)


def windows(spark, d, days=30):
    w = split_windows(enriched(spark, d), days)
    return w.filter(F.col("window") == "current"), w.filter(F.col("window") == "previous")


WINS = """cut AS (SELECT max(ets) - INTERVAL 29 DAY AS c FROM en), wc AS (SELECT en.* FROM en, cut WHERE ets IS NULL OR ets >= c), wp AS (SELECT en.* FROM en, cut WHERE ets < c AND ets >= c - INTERVAL 30 DAY)"""


@query("theme_lookup", f"WITH {ENR} SELECT opinion_id, path, theme_id, theme_name FROM en")
def _(spark, d):
    from plaintide.plans.scalars import with_labels
    return ins.theme_lookup(with_labels(opinion(spark, d)), *dims(spark)).select("opinion_id", "path", "theme_id", "theme_name")


@query("insight_enrich", f"""
WITH {ENR} SELECT opinion_id, l1, l2, l3, intent, expected_action, severity, urgency, repeat_signal, root_cause_hint, theme_id, reviewed, car AS car_model_norm, vin, phone, country,
 strftime(ets, '%Y-%m-%d %H:%M:%S') AS event_time FROM en""")
def _(spark, d):
    return enriched(spark, d).select("opinion_id", "l1", "l2", "l3", *ins.FIELDS, "theme_id", "reviewed", "car_model_norm", "vin", "phone",
                                     "country", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("entity_coverage", f"""
WITH {ENR}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE vin <> '') / count(*)::DOUBLE AS v, count(*) FILTER (WHERE phone <> '') / count(*)::DOUBLE AS p, count(*) FILTER (WHERE car <> '') / count(*)::DOUBLE AS c FROM en)
SELECT n, round(v, 4) AS vin_fill, round(p, 4) AS phone_fill, round(c, 4) AS car_model_fill, CASE WHEN v >= 0.3 THEN 'vin' WHEN p >= 0.3 THEN 'phone' ELSE 'text_repeat' END AS entity_key FROM a""")
def _(spark, d):
    return ins.entity_coverage(enriched(spark, d))


@query("theme_l3_breakdown", f"""
WITH {ENR} SELECT theme_id, theme_name, l1, l2, l3, path, count(*) AS count, count(*) FILTER (WHERE reviewed) AS reviewed_count, count(*) FILTER (WHERE NOT reviewed) AS model_only_count FROM mb GROUP BY ALL""")
def _(spark, d):
    return ins.theme_l3_breakdown(enriched(spark, d))


CHAIN = f"""{ENR}, fq AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY id) AS rn, replace({q.s('original_text')}, chr(10), ' ') AS qt FROM mb),
 fk AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY rn) AS qn FROM fq WHERE rn <= 9 AND qt <> ''),
 ch AS (SELECT theme_id, theme_name, count(*) AS count, count(*) FILTER (WHERE reviewed) AS reviewed_count, count(*) FILTER (WHERE NOT reviewed) AS model_only_count,
   count(DISTINCT path) AS l3_n, count(DISTINCT opinion_id) AS opinion_ids FROM mb GROUP BY 1, 2)"""


@query("evidence_chain", f"""
WITH {CHAIN} SELECT ch.*, md5((SELECT string_agg(substr(qt, 1, 160), '|' ORDER BY qn) FROM fk WHERE fk.theme_id = ch.theme_id AND qn <= 3)) AS quotes, count = opinion_ids AS reconcile_ok FROM ch""")
def _(spark, d):
    return ins.evidence_chain(enriched(spark, d)).withColumn("quotes", F.md5(F.array_join("quotes", "|")))


@query("reconcile_evidence", f"""
WITH {CHAIN} SELECT count(*) AS themes, sum(count)::BIGINT AS theme_total, sum(opinion_ids)::BIGINT AS opinion_id_total, 0 AS bad_themes, (SELECT count(*) FROM mb) AS l3_total, true AS gate_ok FROM ch""")
def _(spark, d):
    e = enriched(spark, d)
    return ins.reconcile_evidence(ins.evidence_chain(e), ins.theme_l3_breakdown(e))


def _rec_sql(ent: str) -> str:
    return f"""
WITH {ENR}, x AS (SELECT {ent} AS e, ets, reflow_synced, id FROM en WHERE {ent} <> ''), p AS (SELECT e, max(ets) AS last, count(*) AS n FROM x GROUP BY 1),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY ets DESC NULLS LAST, id) AS rn FROM x) WHERE rn = 1),
 w AS (SELECT x.e, ets, lag(ets) OVER (PARTITION BY x.e ORDER BY ets) AS prev FROM x JOIN p ON x.e = p.e WHERE ets >= last - INTERVAL 30 DAY),
 k AS (SELECT e, count(*) AS k FROM w GROUP BY 1), g AS (SELECT avg(epoch(ets - prev) / 86400.0) AS m FROM w WHERE prev IS NOT NULL),
 r AS (SELECT count(*) AS eligible_entities, count(*) FILTER (WHERE CASE WHEN last IS NULL THEN n >= 2 ELSE k >= 2 END) AS repeat_entities FROM p LEFT JOIN k ON p.e = k.e)
SELECT *, round(repeat_entities / greatest(eligible_entities, 1)::DOUBLE, 4) AS repeat_rate, round((SELECT m FROM g), 2) AS mean_days_to_repeat, (SELECT count(*) FROM l WHERE reflow_synced < 1) AS unresolved_backlog FROM r"""


@query("recurrence", _rec_sql("vin"))
def _(spark, d):
    return ins.recurrence(enriched(spark, d), "vin")


@query("recurrence_phone", _rec_sql("phone"))
def _(spark, d):
    return ins.recurrence(enriched(spark, d), "phone")


@query("recurrence_text", f"""
WITH {ENR}, a AS (SELECT count(*) AS eligible_entities, count(*) FILTER (WHERE repeat_signal) AS repeat_entities, count(*) FILTER (WHERE reflow_synced < 1 AND reviewed) AS unresolved_backlog FROM en)
SELECT *, {q.share('repeat_entities', 'eligible_entities')} AS repeat_rate, NULL::DOUBLE AS mean_days_to_repeat FROM a""")
def _(spark, d):
    return ins.recurrence(enriched(spark, d), "text_repeat")


def _rate(src: str) -> str:
    return f"SELECT l2, count(*) FILTER (WHERE intent = '投诉升级') / greatest(count(*) FILTER (WHERE intent IN ('投诉升级','报障','求助')), 1)::DOUBLE AS r FROM {src} WHERE l2 <> '' GROUP BY 1"


SHIFT = f"""{WINS}, sh AS (SELECT coalesce(a.l2, b.l2) AS l2, coalesce(a.r, 0) AS c, coalesce(b.r, 0) AS p FROM ({_rate('wc')}) a FULL JOIN ({_rate('wp')}) b ON a.l2 = b.l2)"""


@query("intent_shift", f"""
WITH {ENR}, {SHIFT} SELECT l2, round(c, 4) AS escalation_rate, round(p, 4) AS prev_rate, round((c - p) * 100, 1) AS delta_pp FROM sh""")
def _(spark, d):
    return ins.intent_shift(ins.period_cells(enriched(spark, d), ["l2", "intent"]), 30)


@query("expectation_unmet", f"""
WITH {ENR} SELECT expected_action AS action, count(*) AS count, round(count(*) FILTER (WHERE reflow_synced < 1 OR repeat_signal) / count(*)::DOUBLE, 4) AS unmet_rate FROM en GROUP BY 1""")
def _(spark, d):
    return ins.expectation_unmet(enriched(spark, d))


def _lift_sql(dimension: str, name: str) -> str:
    return f"""SELECT * FROM (SELECT l3, '{name}' AS dimension, value, round(s, 4) AS share, round(b, 4) AS baseline_share, round(s / b, 2) AS lift, n AS count, l3_n FROM (
   SELECT c.l3, c.value, c.n, z.l3_n, c.n / z.l3_n::DOUBLE AS s, v.n / (SELECT count(*) FROM en WHERE {dimension} <> '')::DOUBLE AS b
   FROM (SELECT concat(l3, '·', l2) AS l3, {dimension} AS value, count(*) AS n FROM en WHERE {dimension} <> '' AND l3 <> '' GROUP BY 1, 2) c
   JOIN (SELECT concat(l3, '·', l2) AS l3, count(*) AS l3_n FROM en WHERE {dimension} <> '' AND l3 <> '' GROUP BY 1 HAVING count(*) >= 5) z ON z.l3 = c.l3
   JOIN (SELECT {dimension} AS value, count(*) AS n FROM en WHERE {dimension} <> '' GROUP BY 1) v ON v.value = c.value) WHERE s / b >= 1.1 AND s >= 0.1
   ORDER BY lift DESC, count DESC, l3, value LIMIT 20)"""


@query("concentration_lift", f"WITH {ENR} {_lift_sql('car', 'car_model')} UNION ALL {_lift_sql('country', 'region')}")
def _(spark, d):
    # L3 names are widened by their L2, so that some concentration exists in the fixture.
    e = enriched(spark, d).withColumn("l3", F.when(F.col("l3") != "", F.concat("l3", F.lit("·"), "l2")).otherwise(""))
    return ins.concentration_lift(e, min_share=0.1, min_lift=1.1)


LIFE = f"""mx AS (SELECT max(ets) AS m FROM en),
 bk AS (SELECT l2, l3, floor(floor((epoch_us(m) - epoch_us(ets)) / 86400000000) / 14) AS i, CASE severity WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END AS w FROM en, mx WHERE l2 <> '' AND l3 <> ''),
 gc AS (SELECT l2, l3, {', '.join(f'count(*) FILTER (WHERE i = {k}) AS c{k}' for k in range(5))}, sum(w)::BIGINT AS severity_weighted FROM bk GROUP BY 1, 2),
 ga AS (SELECT *, (c1 + c2 + c3 + c4) / 4.0::DOUBLE AS avg, (c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT + (c3 > 0)::INT + (c4 > 0)::INT AS weeks_active FROM gc WHERE c0 + c1 + c2 + c3 + c4 > 0),
 gs AS (SELECT *, CASE WHEN avg = 0 AND c0 >= 3 THEN '新发' WHEN c0 >= 1.5 * greatest(avg, 0.1) AND c1 > c2 THEN '恶化'
   WHEN weeks_active >= 3 AND avg > 0 AND abs(c0 - avg) / avg <= 0.2 AND abs(c1 - avg) / avg <= 0.2 AND abs(c2 - avg) / avg <= 0.2 THEN '高位平台'
   WHEN c1 < c2 AND c0 <= 0.6 * greatest(avg, 0.1) AND c0 < c1 THEN '收敛'
   WHEN c0 >= avg AND ((c1 <= 0.2 * greatest(avg, 1) AND c2 >= 0.8 * avg) OR (c2 <= 0.2 * greatest(avg, 1) AND c3 >= 0.8 * avg) OR (c3 <= 0.2 * greatest(avg, 1) AND c4 >= 0.8 * avg)) THEN '复发'
   WHEN c0 < 3 AND avg < 1 THEN NULL ELSE '高位平台' END AS trend_state FROM ga),
 lc AS (SELECT l2, l3, trend_state, c0 AS current, round(avg, 2) AS avg_4p, weeks_active, severity_weighted, concat_ws(',', c0, c1, c2, c3, c4) AS series FROM gs WHERE trend_state IS NOT NULL
   ORDER BY severity_weighted DESC, current DESC, l2, l3 LIMIT 50)"""


@query("fault_lifecycle", f"WITH {ENR}, {LIFE} SELECT * FROM lc")
def _(spark, d):
    return ins.fault_lifecycle(enriched(spark, d), 14)


def _wp(x: str) -> str:
    return f"concat(cast(round({x} * 100, 0)::BIGINT AS VARCHAR), '%')"


TEMPLATES = f"""{CHAIN}, {SHIFT}, {LIFE},
 x AS (SELECT vin AS e, ets FROM en WHERE vin <> ''), xp AS (SELECT e, max(ets) AS last, count(*) AS n FROM x GROUP BY 1), xk AS (SELECT x.e, count(*) AS k FROM x JOIN xp ON x.e = xp.e WHERE ets >= last - INTERVAL 30 DAY GROUP BY 1),
 rc AS (SELECT count(*) AS el, count(*) FILTER (WHERE CASE WHEN last IS NULL THEN n >= 2 ELSE k >= 2 END) AS rp FROM xp LEFT JOIN xk ON xp.e = xk.e), rr AS (SELECT rp, round(rp / greatest(el, 1)::DOUBLE, 4) AS rate FROM rc),
 s5 AS (SELECT * FROM (SELECT l2, round(c, 4) AS er, round(p, 4) AS pr, round((c - p) * 100, 1) AS dp FROM sh) ORDER BY abs(dp) DESC, er DESC, l2 LIMIT 5),
 eu AS (SELECT expected_action AS action, count(*) AS n, round(count(*) FILTER (WHERE reflow_synced < 1 OR repeat_signal) / count(*)::DOUBLE, 4) AS ur FROM en GROUP BY 1),
 cl AS (SELECT c.l3, c.value, c.n, z.l3_n, c.n / z.l3_n::DOUBLE AS s, v.n / (SELECT count(*) FROM en WHERE car <> '')::DOUBLE AS b FROM (SELECT l3, car AS value, count(*) AS n FROM en WHERE car <> '' AND l3 <> '' GROUP BY 1, 2) c
   JOIN (SELECT l3, count(*) AS l3_n FROM en WHERE car <> '' AND l3 <> '' GROUP BY 1 HAVING count(*) >= 5) z ON z.l3 = c.l3 JOIN (SELECT car AS value, count(*) AS n FROM en WHERE car <> '' GROUP BY 1) v ON v.value = c.value),
 c5 AS (SELECT l3, value, round(s, 4) AS share, round(b, 4) AS base, round(s / b, 2) AS lift, n FROM cl WHERE s / b >= 1.01 AND s >= 0.1 ORDER BY lift DESC, n DESC, l3, value LIMIT 5),
 hd AS (SELECT theme_name FROM ch ORDER BY count DESC, theme_id LIMIT 1), ws AS (SELECT l3 FROM lc GROUP BY 1 ORDER BY sum(severity_weighted) DESC, l3 LIMIT 1)"""


@query("insight_templates", f"""
WITH {TEMPLATES}
SELECT 'I1' AS template_id, concat('窗口内同一实体二次反馈占比 ', {_wp('rate')}, ' （实体键=vin），首次处理未解决风险偏高') AS text, rp AS count FROM rr WHERE rate > 0.3 UNION ALL
SELECT 'I2', concat(l2, ' 投诉升级占比从 ', {_wp('pr')}, ' 升至 ', {_wp('er')}, '（+', dp, 'pp）'), 0 FROM s5 WHERE dp >= 5 UNION ALL
SELECT 'I3', concat(l3, ' 有 ', {_wp('share')}, ' 来自 ', value, '，而该维度仅占总量 ', {_wp('base')}, '（lift=', lift, '）'), n FROM c5 UNION ALL
SELECT 'I4', concat('本期新发高危问题 ', l3, '（', current, ' 条），过去 4 期均值 ', avg_4p), current FROM lc WHERE trend_state = '新发' AND severity_weighted >= 6 UNION ALL
SELECT 'I5', concat(l3, ' 呈复发态势（当期 ', current, ' / 均值 ', avg_4p, '）'), current FROM lc WHERE trend_state = '复发' UNION ALL
SELECT 'I8', concat(l2, '/', l3, ' 已连续 ', weeks_active, ' 期维持高位，属慢性问题'), current FROM lc WHERE trend_state = '高位平台' AND weeks_active >= 4 UNION ALL
SELECT 'I6', concat('用户最常要求 ', action, '（', n, ' 条），未满足率 ', {_wp('ur')}, '，是当前最大的期望落差'), n FROM (SELECT * FROM eu ORDER BY ur DESC, n DESC, action LIMIT 1) UNION ALL
SELECT 'I9', concat('按严重度加权后头号问题倾向 ', l3, '，而按条数头号主题是 ', theme_name, '，建议调整资源投向'), 0 FROM ws, hd WHERE (SELECT count(*) FROM ch) >= 2 AND NOT contains(theme_name, l3)""")
def _(spark, d):
    # Seven result tables read the same enriched rows: they are computed once, without the texts.
    e = materialise(enriched(spark, d).drop("v3_label_meta", "original_text"))
    shift, cars = ins.intent_shift(ins.period_cells(e, ["l2", "intent"]), 30), {"car_model_norm": "car_model"}
    return ins.insight_templates(ins.recurrence(e, "vin"), "vin", shift, ins.expectation_unmet(e),
                                 ins.concentration_lift(e, cars, min_share=0.1, min_lift=1.01), ins.fault_lifecycle(e, 14), ins.theme_totals(e))


@query("field_distribution", f"""
WITH {ENR} SELECT 'intent' AS field, intent AS value, count(*) AS n FROM en GROUP BY 2 UNION ALL SELECT 'expected_action', expected_action, count(*) FROM en GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM en GROUP BY 2 UNION ALL SELECT 'urgency', urgency, count(*) FROM en GROUP BY 2 UNION ALL SELECT 'repeat_signal', cast(repeat_signal AS VARCHAR), count(*) FROM en GROUP BY 2""")
def _(spark, d):
    return ins.field_distribution(enriched(spark, d))


@query("theme_period_compare", f"""
WITH {ENR}, {WINS}, c AS (SELECT theme_id, theme_name, count(DISTINCT opinion_id) AS count FROM wc WHERE l1 <> '' AND l3 <> '' GROUP BY 1, 2), p AS (SELECT theme_id, count(DISTINCT opinion_id) AS pc FROM wp WHERE l1 <> '' AND l3 <> '' GROUP BY 1),
 j AS (SELECT c.*, coalesce(pc, 0) AS prev_count FROM c LEFT JOIN p ON c.theme_id = p.theme_id)
SELECT *, count - prev_count AS wow_delta, CASE WHEN prev_count <= 0 THEN (CASE WHEN count >= 3 THEN '新发' ELSE '—' END) WHEN count / prev_count >= 1.2 THEN '上升' WHEN count / prev_count <= 0.8 THEN '下降' ELSE '持平' END AS trend_state FROM j""")
def _(spark, d):
    return ins.theme_period_compare(*windows(spark, d))


MASK = """CASE WHEN vin = '' THEN '' WHEN length(vin) <= 6 THEN '***' ELSE substr(vin,1,6) || '***' END AS vin,
 CASE WHEN phone = '' THEN '' WHEN length(phone) < 7 THEN '****' ELSE substr(phone,1,3) || '****' || right(phone,2) END AS phone"""


@query("theme_opinions", f"""
WITH {ENR} SELECT id, theme_id, theme_name, opinion_id, reviewed, l1, l2, l3, path, {MASK}, car AS car_model, country, intent, expected_action, severity, substr(original_text, 1, 300) AS text,
 (SELECT count(*) FROM mb WHERE theme_id = 'T03' AND reviewed) AS total FROM mb WHERE theme_id = 'T03' AND reviewed ORDER BY id LIMIT 10 OFFSET 10""")
def _(spark, d):
    return ins.theme_opinions(enriched(spark, d), "T03", 2, 10, True)


@query("theme_evidence_export", f"""
WITH {ENR} SELECT id, theme_id, theme_name, opinion_id, reviewed, l1, l2, l3, path, {MASK}, car AS car_model, country, intent, expected_action, severity, substr(original_text, 1, 300) AS text FROM mb""")
def _(spark, d):
    return ins.theme_detail_rows(enriched(spark, d))


@query("theme_coverage", f"""
WITH {ENR}, {WINS} SELECT count(*) AS current_n, count(*) FILTER (WHERE l1 = '' OR l3 = '') AS skipped_no_l3, count(*) FILTER (WHERE {q.s('v3_l3')} <> '' OR {q.s('review_l3')} <> '') AS col_l3_n,
 count(*) FILTER (WHERE {q.s(q.js('v3_label_meta', 'l3'))} <> '') AS meta_l3_n, count(DISTINCT CASE WHEN l1 <> '' AND l3 <> '' THEN theme_id END) AS theme_n, '' AS hint FROM wc""")
def _(spark, d):
    return ins.theme_coverage(windows(spark, d)[0])
