"""Classification, matching and repair queries. They run on the prose pack, whose patterns occur in
the test tables; the default pack has the same shape."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.functions import labels
from plaintide.functions.common import WS, collapse, dim
from plaintide.operators import classify as C, match as M
from plaintide.packs import prose
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion, table
from plaintide.plans.registry import query
from plaintide.plans.scalars import legacy_sql

P, E, S, N = prose.P, prose.E, prose.S, prose.N
PK = prose.PACK
T = "original_text"
BODY = f"trim(regexp_replace(coalesce(original_text,''), '{WS}+', ' ', 'g'))"


def taxonomy(spark):
    return dim(spark, [(*r, i) for i, r in enumerate(prose.TAXONOMY)], "l1 string, l2 string, l3 string, freq int, pos int")


def clusters(spark):
    rows = [(a, b, c, n, k, s, i) for i, (a, b, c, n, k, s) in enumerate(prose.CLUSTERS)]
    return dim(spark, rows, "l1 string, l2 string, canonical string, count int, keywords array<string>, synonyms array<string>, pos int")


def whitelist(spark):
    return dim(spark, [(a, b, i) for i, (a, b) in enumerate(prose.WHITELIST)], "l1 string, l2 string, pos int")


def vals(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


TAX = f"tax(l1, l2, l3, freq, pos) AS (VALUES {vals([(*r, i) for i, r in enumerate(prose.TAXONOMY)])})"
CLU = f"clu(l1, l2, canonical, cnt, keywords, synonyms, pos) AS (VALUES {vals([(a, b, c, n, k, s, i) for i, (a, b, c, n, k, s) in enumerate(prose.CLUSTERS)])})"
WLS = f"wl(l1, l2, pos) AS (VALUES {vals([(a, b, i) for i, (a, b) in enumerate(prose.WHITELIST)])})"


def rx(t: str, p: str) -> str:
    return f"regexp_matches({t}, '(?is){p}')"


def anyw(t: str, ws) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"


def cnt(t: str, ws) -> str:
    return "(" + " + ".join(f"contains({t}, '{w}')::INT" for w in ws) + ")"


def prio_sql(t: str, field: str) -> str:
    out = "CASE"
    for r in prose.PRIORITY:
        cond = rx(t, ".*".join(f"(?:{p})" for p in r["parts"]))
        if r["deny"]:
            cond += f" AND NOT {rx(t, r['deny'])}"
        v = r[field]
        out += f" WHEN {cond} THEN " + (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE")
    return out + " END"


def score_sql(t: str, k: str) -> str:
    parts = []
    for e in prose.SCORES[k]:
        body = f"lower({t})" if e.get("lower") else t
        n = cnt(body, e["words"]) if e.get("each", True) else f"{anyw(body, e['words'])}::INT"
        gate = " AND ".join([anyw(t, g) for g in e.get("also", ())] + ([f"NOT {anyw(t, e['unless'])}"] if e.get("unless") else [])) or "true"
        parts.append(f"CASE WHEN {gate} THEN {n} * {e['weight']}::DOUBLE ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def decide_sql() -> str:
    return (f"CASE WHEN n >= 13.5 AND n > greatest(p, s, e) + 2.8 THEN '{N}' WHEN p >= 4.5 AND p >= greatest(s, e) - 1 THEN '{P}' WHEN s >= 7.0 AND s >= greatest(p, e) THEN '{S}' "
            f"WHEN e >= 6.0 AND e >= greatest(p, s) THEN '{E}' WHEN p >= greatest(s, e) THEN '{P}' ELSE '{S}' END")


def route_sql(t: str, l1: str) -> str:
    out = f"CASE {l1}"
    for cls, entries in prose.ROUTES.items():
        ranked = sorted(enumerate(entries), key=lambda x: (-x[1]["weight"], x[0]))
        inner = "CASE"
        for _, e in ranked:
            cond = anyw(t, e["words"]) + (f" AND {anyw(t, e['also'])}" if e.get("also") else "") + (f" AND NOT {anyw(f'lower({t})', e['unless'])}" if e.get("unless") else "")
            inner += f" WHEN {cond} THEN '{e['target']}'"
        dflt = PK["route_default"].get(cls)
        out += f" WHEN '{cls}' THEN {inner} " + (f"ELSE '{dflt}' " if dflt else "") + "END"
    return out + " END"


@query("priority_rules", f"""
WITH t AS (SELECT opinion_id, lower(original_text) AS x FROM opinion)
SELECT opinion_id, {prio_sql('x', 'l1')} AS l1, {prio_sql('x', 'l2')} AS l2, {prio_sql('x', 'l3')} AS l3, {prio_sql('x', 'confidence')} AS confidence FROM t""")
def _(spark, d):
    o = opinion(spark, d).withColumn("r", C.priority_rules(F.col(T), PK["priority"]))
    return o.select("opinion_id", "r.l1", "r.l2", "r.l3", "r.confidence")


SC = f"sc AS (SELECT *, {BODY} AS body, {score_sql(BODY, 'product')} AS p, {score_sql(BODY, 'service')} AS s, {score_sql(BODY, 'experience')} AS e, {score_sql(BODY, 'none')} AS n FROM opinion)"


@query("l1_keyword_score", f"WITH {SC} SELECT opinion_id, p AS s_product, s AS s_service, e AS s_experience, round(n, 6) AS s_none, {decide_sql()} AS scored_l1 FROM sc")
def _(spark, d):
    o = opinion(spark, d).withColumn("body", collapse(F.col(T)))
    return C.l1_keyword_score(o, "body", PK).select("opinion_id", "s_product", "s_service", "s_experience", F.round("s_none", 6).alias("s_none"), "scored_l1")


@query("l2_route", f"WITH {SC} SELECT opinion_id, {route_sql('body', decide_sql())} AS l2 FROM sc")
def _(spark, d):
    o = C.l1_keyword_score(opinion(spark, d).withColumn("body", collapse(F.col(T))), "body", PK)
    return o.select("opinion_id", C.l2_route(F.col("body"), F.col("scored_l1"), PK).alias("l2"))


ROUTED = f"""{SC}, {TAX}, {CLU}, rt AS (SELECT id, opinion_id, body, lower(body) AS low, l1, {route_sql('body', 'l1')} AS l2 FROM (SELECT *, {decide_sql()} AS l1 FROM sc)),
 grams AS (SELECT pos, lower(substr(l3, i, n)) AS g, substr(l3, i, n) AS raw FROM tax, (SELECT unnest([3,4,5,6]) AS n), (SELECT unnest(generate_series(1, 20)) AS i) WHERE i + n - 1 <= length(l3)),
 gd AS (SELECT pos, raw AS r0, min(g) AS g FROM grams GROUP BY 1, 2)"""


def lab_score(boost: float) -> str:
    return (f"(CASE WHEN contains(body, l3) OR contains(low, lower(l3)) THEN 120.0 ELSE 0 END + (SELECT count(*) FROM gd WHERE gd.pos = tax.pos AND contains(low, gd.g)) * 15.0 "
            f"+ (CASE WHEN length(l3) = 2 AND contains(body, l3) THEN 5.0 ELSE 0 END) + least(8.0, ln(1.0 + greatest(freq, 1))) + (CASE WHEN contains(body, tax.l2) THEN {boost} ELSE 0 END))::DOUBLE")


L3S = f"""l3r AS (SELECT rt.id, tax.l2, tax.l3, tax.pos, {lab_score(22.0)} AS sc FROM rt JOIN tax ON tax.l1 = rt.l1 AND tax.l2 = rt.l2),
 l3b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, pos) AS rn FROM l3r) WHERE rn = 1)"""
L3C = f"""l1r AS (SELECT rt.id, tax.l2, tax.l3, tax.pos, {lab_score(28.0)} AS sc FROM rt JOIN tax ON tax.l1 = rt.l1),
 l1b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, pos) AS rn FROM l1r) WHERE rn = 1)"""


def routed(spark, d):
    o = C.l1_keyword_score(opinion(spark, d).withColumn("body", collapse(F.col(T))), "body", PK, "l1")
    return o.withColumn("l2", C.l2_route(F.col("body"), F.col("l1"), PK)).select("id", "opinion_id", "body", "l1", "l2")


@query("l3_score", f"""
WITH {ROUTED}, {L3S}, {L3C} SELECT rt.opinion_id, CASE WHEN l3b.sc >= 9 THEN l3b.l3 END AS l3, CASE WHEN l3b.sc >= 9 THEN round(least(0.92, 0.52 + l3b.sc / 200.0), 6) END AS confidence,
  CASE WHEN l1b.sc >= 11 THEN l1b.l2 END AS class_l2, CASE WHEN l1b.sc >= 11 THEN l1b.l3 END AS class_l3, CASE WHEN l1b.sc >= 11 THEN round(least(0.92, 0.55 + l1b.sc / 200.0), 6) END AS class_confidence
FROM rt LEFT JOIN l3b ON l3b.id = rt.id LEFT JOIN l1b ON l1b.id = rt.id""")
def _(spark, d):
    r = M.l3_score_in_l1(M.l3_score(routed(spark, d), taxonomy(spark)), taxonomy(spark))
    return r.select("opinion_id", F.col("routed.l3").alias("l3"), F.round("routed.confidence", 6).alias("confidence"), F.col("scored.l2").alias("class_l2"),
                    F.col("scored.l3").alias("class_l3"), F.round("scored.confidence", 6).alias("class_confidence"))


CL3 = """cc AS (SELECT rt.id, clu.canonical, clu.pos, CASE WHEN length(canonical) >= 3 AND contains(body, canonical) THEN 0.66
    WHEN len(list_filter(keywords, lambda k: length(k) >= 3 AND contains(body, k))) > 0 THEN 0.63 WHEN len(list_filter(synonyms, lambda k: length(k) >= 3 AND contains(body, k))) > 0 THEN 0.62 END AS c
   FROM rt JOIN clu ON clu.l1 = rt.l1 AND clu.l2 = rt.l2), cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM cc WHERE c IS NOT NULL) WHERE rn = 1)"""


@query("cluster_l3", f"WITH {ROUTED}, {CL3} SELECT opinion_id, canonical AS l3, c::DOUBLE AS confidence FROM rt LEFT JOIN cb ON cb.id = rt.id")
def _(spark, d):
    return M.cluster_l3(routed(spark, d), clusters(spark)).select("opinion_id", "clustered.l3", "clustered.confidence")


GEN = """ge AS (SELECT l1, l2, l3 AS generic_l3, CASE WHEN r <= 1 THEN 0.48 ELSE 0.42 END AS generic_conf FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2 ORDER BY r, pos) AS rn FROM
   (SELECT *, CASE WHEN l3 = '通用' THEN 0 WHEN contains(l3, '无明确') OR contains(l3, '通用') THEN 1 ELSE 2 END AS r FROM tax)) WHERE rn = 1)"""
SYM = f"CASE WHEN l1 = '{P}' AND contains(body, 'ating') THEN 'sym-a' WHEN l1 = '{P}' AND contains(body, 're') THEN 'sym-b' END"


@query("generic_fallback", f"""
WITH {ROUTED}, {GEN} SELECT opinion_id, {SYM} AS l3, ge.generic_l3, ge.generic_conf::DOUBLE AS generic_conf,
 CASE WHEN rt.l1 = '{E}' OR contains(body, 'avec') OR contains(body, 'und') THEN 'weak-e' WHEN rt.l1 = '{S}' THEN 'weak-s' END AS weak_l3
FROM rt LEFT JOIN ge ON ge.l1 = rt.l1 AND ge.l2 = rt.l2""".replace("CASE WHEN l1 = ", "CASE WHEN rt.l1 = ").replace("WHEN l1 = ", "WHEN rt.l1 = "))
def _(spark, d):
    r = M.generic_l3(routed(spark, d), taxonomy(spark))
    return r.select("opinion_id", C.generic_fallback(F.col("body"), F.col("l1"), PK)["l3"].alias("l3"), F.col("generic.l3").alias("generic_l3"),
                    F.col("generic.confidence").alias("generic_conf"), C.weak_fallback(F.col("body"), F.col("l1"), PK)["l3"].alias("weak_l3"))


FUZ = """ex AS (SELECT id, tax.l1, tax.l2, tax.l3 FROM (SELECT rt.id, min(tax.pos) AS mp FROM rt JOIN tax ON length(tax.l3) >= 2 AND (contains(body, tax.l3) OR contains(low, lower(tax.l3))) GROUP BY 1) z JOIN tax ON tax.pos = z.mp),
 rg AS (SELECT raw AS g, min(pos) AS pos FROM grams GROUP BY 1),
 fz AS (SELECT * FROM (SELECT rt.id, tax.l1, tax.l2, tax.l3, row_number() OVER (PARTITION BY rt.id ORDER BY length(g) DESC, strpos(low, g), rg.pos) AS rn FROM rt JOIN rg ON contains(low, g) JOIN tax ON tax.pos = rg.pos) WHERE rn = 1)"""


@query("exact_fuzzy_label", f"""
WITH {ROUTED}, {FUZ} SELECT opinion_id, coalesce(ex.l3, fz.l3) AS l3, coalesce(ex.l2, fz.l2) AS l2, CASE WHEN ex.l3 IS NOT NULL THEN 0.88 WHEN fz.l3 IS NOT NULL THEN 0.68 END::DOUBLE AS confidence
FROM rt LEFT JOIN ex ON ex.id = rt.id LEFT JOIN fz ON fz.id = rt.id""")
def _(spark, d):
    return M.exact_fuzzy_label(routed(spark, d), taxonomy(spark)).select("opinion_id", "fuzzy.l3", "fuzzy.l2", "fuzzy.confidence")


# Gold: reviewed rows; probes: all rows, so that planted copies of a reviewed text are found.
GOLD = f"""gk AS (SELECT *, md5({BODY}) AS k FROM opinion),
 gr AS (SELECT * FROM (SELECT k, {q.canon('review_l1')} AS g1, {q.s('review_l2')} AS g2, {q.s('review_l3')} AS g3, row_number() OVER (PARTITION BY k ORDER BY id DESC) AS rn FROM gk
   WHERE review_status = 1 AND {q.s('original_text')} <> '' AND {q.s('review_l1')} <> '') WHERE rn = 1),
 tl AS (SELECT l1, l2 FROM (SELECT l1, l2, row_number() OVER (PARTITION BY l1 ORDER BY sum(freq) DESC, min(pos)) AS rn FROM tax GROUP BY 1, 2) WHERE rn = 1),
 fc AS (SELECT l1, l2, canonical FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2 ORDER BY pos) AS rn FROM clu) WHERE rn = 1),
 gd2 AS (SELECT gk.id, g1 AS l1, coalesce(nullif(g2,''), tl.l2, '') AS l2, g3 FROM gk JOIN gr ON gr.k = gk.k LEFT JOIN tl ON tl.l1 = g1),
 gold AS (SELECT gd2.id, gd2.l1, gd2.l2, coalesce(nullif(g3,''), canonical, '通用') AS l3 FROM gd2 LEFT JOIN fc ON fc.l1 = gd2.l1 AND fc.l2 = gd2.l2)"""


@query("gold_lookup", f"""
WITH {TAX}, {CLU}, {GOLD} SELECT opinion_id, gold.l1, gold.l2, gold.l3, CASE WHEN gold.l1 IS NOT NULL THEN 0.99 END::DOUBLE AS confidence FROM opinion o LEFT JOIN gold ON gold.id = o.id""")
def _(spark, d):
    o = opinion(spark, d)
    return M.gold_lookup(o, M.gold_rows(o), taxonomy(spark), clusters(spark)).select("opinion_id", "gold.l1", "gold.l2", "gold.l3", "gold.confidence")


HINT = f"""hk AS (SELECT k, arg_max(h, oid) AS h FROM (SELECT md5({BODY}) AS k, {q.try_canon('model_class')} AS h, opinion_id AS oid FROM opinion WHERE id % 3 = 0) WHERE h IS NOT NULL GROUP BY 1)"""


def hints(o):
    lib = o.filter(F.col("id") % 3 == 0).select(F.col(T).alias("原文"), F.col("model_class").alias("人工复核结果"), F.col("opinion_id").alias("舆情编号"))
    return M.clean_hints(lib)


@query("clean_hint", f"WITH {HINT} SELECT opinion_id, hk.h AS hint_l1 FROM (SELECT *, md5({BODY}) AS k FROM opinion) o LEFT JOIN hk ON hk.k = o.k")
def _(spark, d):
    o = opinion(spark, d)
    return M.clean_hint(o, hints(o)).select("opinion_id", "hint_l1")


CASC = f"""{SC}, {TAX}, {CLU}, {HINT}, {GOLD},
 c0 AS (SELECT sc.id, sc.opinion_id, sc.body, lower(sc.body) AS low, hk.h, gold.l1 AS g1, gold.l2 AS g2, gold.l3 AS g3, {prio_sql('lower(sc.body)', 'l1')} AS r1, {prio_sql('lower(sc.body)', 'l2')} AS r2,
   {prio_sql('lower(sc.body)', 'l3')} AS r3, {prio_sql('lower(sc.body)', 'confidence')} AS rc, {decide_sql()} AS dl1 FROM sc LEFT JOIN gold ON gold.id = sc.id LEFT JOIN hk ON hk.k = md5(sc.body)),
 rt AS (SELECT *, {route_sql('body', 'l1')} AS l2 FROM (SELECT *, coalesce(h, dl1) AS l1 FROM c0 WHERE g1 IS NULL AND r1 IS NULL)),
 grams AS (SELECT pos, lower(substr(l3, i, n)) AS g, substr(l3, i, n) AS raw FROM tax, (SELECT unnest([3,4,5,6]) AS n), (SELECT unnest(generate_series(1, 20)) AS i) WHERE i + n - 1 <= length(l3)),
 gd AS (SELECT pos, raw AS r0, min(g) AS g FROM grams GROUP BY 1, 2), {L3S}, {L3C}, {CL3}, {GEN}, {FUZ},
 m AS (SELECT rt.id, rt.h, CASE WHEN ge.l2 IS NULL THEN 0 WHEN l3b.sc >= 9 THEN 1 WHEN cb.c IS NOT NULL THEN 2 ELSE 3 END AS k, rt.l1, rt.l2, l3b.l3 AS a3, l3b.sc AS asc_, cb.canonical AS b3, cb.c AS bc, ge.generic_l3 AS c3, ge.generic_conf AS ccf,
   l1b.l2 AS d2, l1b.l3 AS d3, l1b.sc AS dsc, ex.l1 AS e1, ex.l2 AS e2, ex.l3 AS e3, fz.l1 AS f1, fz.l2 AS f2, fz.l3 AS f3, rt.body
   FROM rt LEFT JOIN l3b ON l3b.id = rt.id LEFT JOIN cb ON cb.id = rt.id LEFT JOIN ge ON ge.l1 = rt.l1 AND ge.l2 = rt.l2 LEFT JOIN l1b ON l1b.id = rt.id LEFT JOIN ex ON ex.id = rt.id LEFT JOIN fz ON fz.id = rt.id),
 mm AS (SELECT id, h, CASE WHEN k > 0 OR dsc >= 11 THEN l1 WHEN e3 IS NOT NULL THEN e1 WHEN f3 IS NOT NULL THEN f1 ELSE l1 END AS l1,
   CASE WHEN k > 0 THEN l2 WHEN dsc >= 11 THEN d2 WHEN e3 IS NOT NULL THEN e2 WHEN f3 IS NOT NULL THEN f2 END AS l2,
   CASE WHEN k = 1 THEN a3 WHEN k = 2 THEN b3 WHEN k = 3 THEN c3 WHEN dsc >= 11 THEN d3 WHEN e3 IS NOT NULL THEN e3 WHEN f3 IS NOT NULL THEN f3 ELSE
     coalesce({SYM}, CASE WHEN l1 = '{E}' OR contains(body,'avec') OR contains(body,'und') THEN 'weak-e' WHEN l1 = '{S}' THEN 'weak-s' END) END AS l3,
   CASE WHEN k = 1 THEN 'routed' WHEN k = 2 THEN 'cluster_l3' WHEN k = 3 THEN 'generic_l3' WHEN dsc >= 11 THEN 'scored' WHEN e3 IS NOT NULL THEN 'exact' WHEN f3 IS NOT NULL THEN 'fuzzy' ELSE 'generic' END AS mt FROM m)"""


@query("match_cascade", f"""
WITH {CASC}, fin AS (SELECT c0.opinion_id, coalesce(g1, r1, mm.l1) AS l1, coalesce(g3, r3, mm.l3) AS l3,
  CASE WHEN g1 IS NOT NULL THEN 'gold_review' WHEN c0.h IS NOT NULL THEN 'clean_l1' WHEN r1 IS NOT NULL THEN 'rule' WHEN mm.l3 = 'weak-s' THEN 'generic_l3' ELSE mm.mt END AS mt FROM c0 LEFT JOIN mm ON mm.id = c0.id)
SELECT opinion_id, CASE WHEN l3 IS NOT NULL THEN l1 END AS l1, l3, CASE WHEN l3 IS NOT NULL THEN mt END AS match_type FROM fin""")
def _(spark, d):
    o = opinion(spark, d)
    m = M.match_cascade(o, PK, taxonomy(spark), clusters(spark), M.gold_rows(o), hints(o))
    return m.select("opinion_id", "hit.l1", "hit.l3", "hit.match_type")


NEAR = f"""wo AS (SELECT l1, list(l2 ORDER BY pos) AS opts FROM wl GROUP BY 1)"""


def near_sql(c: str) -> str:
    chars = lambda x: f"list_distinct(list_filter(string_split({x}, ''), lambda y: y <> ''))"
    return (f"(SELECT o FROM (SELECT unnest(opts) AS o, unnest(generate_series(1, len(opts))) AS i) ORDER BY (o = {c}) DESC, "
            f"len(list_intersect({chars(c)}, {chars('o')}))::DOUBLE / greatest(1, len(list_distinct(list_concat({chars(c)}, {chars('o')})))) DESC, i LIMIT 1)")


@query("nearest_label", f"""
WITH {WLS}, {NEAR}, t AS (SELECT opinion_id, {q.canon('v3_l1')} AS l1, concat(v3_l2, CASE WHEN id % 3 = 0 THEN 'x' ELSE '' END) AS c FROM opinion)
SELECT opinion_id, l1, c AS l2, CASE WHEN opts IS NULL THEN c ELSE {near_sql('t.c')} END AS nearest_l2 FROM t LEFT JOIN wo USING (l1)""")
def _(spark, d):
    o = opinion(spark, d).select("opinion_id", labels.canonicalize_l1("v3_l1").alias("l1"), F.concat("v3_l2", F.when(F.col("id") % 3 == 0, "x").otherwise("")).alias("l2"))
    return M.nearest_label(o, whitelist(spark)).select("opinion_id", "l1", "l2", "nearest_l2")


@query("validate_triple", f"""
WITH {TAX}, {CLU}, {WLS}, {NEAR}, {GEN}, fc AS (SELECT l1, l2, canonical FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2 ORDER BY pos) AS rn FROM clu) WHERE rn = 1),
 t AS (SELECT opinion_id, {q.canon('v3_l1')} AS l1, v3_l2 AS c, CASE WHEN id % 4 = 0 THEN 'tionou' WHEN id % 4 = 1 THEN '' ELSE v3_l3 END AS l3 FROM opinion),
 u AS (SELECT opinion_id, l1, CASE WHEN opts IS NULL THEN c ELSE {near_sql('t.c')} END AS l2, l3 FROM t LEFT JOIN wo USING (l1)),
 tg AS (SELECT l1, l2, list(l3) AS tags FROM tax GROUP BY 1, 2)
SELECT opinion_id, u.l1 AS v_l1, u.l2 AS v_l2, CASE WHEN tags IS NULL THEN coalesce(nullif(u.l3,''), canonical, '通用') WHEN list_contains(tags, u.l3) THEN u.l3 ELSE generic_l3 END AS v_l3
FROM u LEFT JOIN tg ON tg.l1 = u.l1 AND tg.l2 = u.l2 LEFT JOIN ge ON ge.l1 = u.l1 AND ge.l2 = u.l2 LEFT JOIN fc ON fc.l1 = u.l1 AND fc.l2 = u.l2""")
def _(spark, d):
    o = opinion(spark, d).select("opinion_id", F.col("v3_l1").alias("l1"), F.col("v3_l2").alias("l2"),
                                 F.when(F.col("id") % 4 == 0, "tionou").when(F.col("id") % 4 == 1, "").otherwise(F.col("v3_l3")).alias("l3"))
    return M.validate_triple(o, taxonomy(spark), whitelist(spark), clusters(spark)).select("opinion_id", "v_l1", "v_l2", "v_l3")


# The standard list, with one excluded entry and phrases that stand for an entry.
STD = [(P, "L2-0", "tionou"), (P, "L2-0", "therin"), (P, "L2-0", "ab"), (P, "L2-1", "eauré"), (P, "L2-2", "entre le"), (S, "L2-1", "lichsch"), (S, "L2-3", "zz")]
STD_ALIAS = [(P, "L2-1", "ungenau", "eauré"), (P, "L2-0", "ation the", "tionou"), (S, "L2-3", "ouelle", "zz"), (S, "L2-1", "qqqq", "nope")]
STD_EX = [(P, "L2-0", "therin")]


def std_dims(spark):
    return M.standard_dim(dim(spark, STD, "l1 string, l2 string, l3 string"), dim(spark, STD_ALIAS, "l1 string, l2 string, l3 string, target_l3 string"),
                          dim(spark, STD_EX, "l1 string, l2 string, l3 string"))


def _std_best(src: str, name: str) -> str:
    return f"""{name}0 AS (SELECT rs.id, w, target, x, contains(body, w) AS sub, (SELECT count(*) FROM (SELECT unnest(generate_series(1, length(w) - 1)) AS i) WHERE contains(body, substr(w, i, 2))) AS n
   FROM rs JOIN {src} z ON z.l1 = rs.l1 AND z.l2 = rs.l2 WHERE length(w) >= 2),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sub DESC, CASE WHEN sub THEN -length(w) ELSE -n END, -length(w), w) AS rn FROM {name}0
   WHERE sub OR n >= CASE WHEN length(w) >= 4 THEN 2 ELSE greatest(1, length(w) - 1) END) WHERE rn = 1)"""


STDQ = f"""rs AS (SELECT id, opinion_id, coalesce(original_text,'') AS body, {q.canon('v3_l1')} AS l1, v3_l2 AS l2, v3_l3 AS l3 FROM opinion),
 se(l1, l2, l3) AS (VALUES {vals(STD_EX)}), sd0(l1, l2, w) AS (VALUES {vals(STD)}), sa0(l1, l2, w, target) AS (VALUES {vals(STD_ALIAS)}),
 sd AS (SELECT l1, l2, w, w AS target, (l1, l2, w) IN (SELECT (l1, l2, l3) FROM se) AS x FROM sd0),
 sa AS (SELECT a.l1, a.l2, a.w, a.target, (a.l1, a.l2, a.w) IN (SELECT (l1, l2, l3) FROM se) OR (a.l1, a.l2, a.target) IN (SELECT (l1, l2, l3) FROM se) AS x FROM sa0 a JOIN sd0 d ON d.l1 = a.l1 AND d.l2 = a.l2 AND d.w = a.target),
 {_std_best('sd', 'b1')}, {_std_best('sa', 'b2')},
 so AS (SELECT rs.*, (rs.l1, rs.l2) IN (SELECT (l1, l2) FROM sd0) AS known, coalesce(CASE WHEN NOT b1.x THEN b1.w END, CASE WHEN NOT b2.x THEN b2.target END) AS pick FROM rs LEFT JOIN b1 ON b1.id = rs.id LEFT JOIN b2 ON b2.id = rs.id),
 sr AS (SELECT *, CASE WHEN l1 IN ('{P}','{S}') AND (known OR l2 = 'L2-4') THEN coalesce(pick, '其他-待归类') END AS std_l3, CASE WHEN l1 IN ('{P}','{S}') AND (known OR l2 = 'L2-4') THEN (CASE WHEN pick IS NOT NULL THEN 0.58 ELSE 0.40 END) END::DOUBLE AS conf FROM so)"""


def std_rows(spark, d):
    return opinion(spark, d).select("id", "opinion_id", F.coalesce(T, F.lit("")).alias("body"), labels.canonicalize_l1("v3_l1").alias("l1"), F.col("v3_l2").alias("l2"), F.col("v3_l3").alias("l3"))


@query("l3_standard_resolve", f"WITH {STDQ} SELECT opinion_id, std_l3, conf FROM sr")
def _(spark, d):
    r = M.l3_standard_resolve(std_rows(spark, d), std_dims(spark), (P, S), ("L2-4",))
    return r.select("opinion_id", F.col("standard.l3").alias("std_l3"), F.col("standard.confidence").alias("conf"))


@query("l3_resolution_report", f"""
WITH {STDQ}, a AS (SELECT count(*) AS rows, count(*) FILTER (WHERE l3 IN ('','通用','其他-待归类')) AS generic_before, count(*) FILTER (WHERE l3 = '' AND conf = 0.58) AS fixed,
  count(*) FILTER (WHERE l3 = '' AND conf = 0.40) AS pending, count(*) FILTER (WHERE l3 = '' AND conf IS NULL) AS unchanged FROM sr)
SELECT *, round((generic_before - fixed - pending) / greatest(rows, 1)::DOUBLE, 4) AS generic_rate, (generic_before - fixed - pending) / greatest(rows, 1)::DOUBLE <= 0.12 AS gate_ok FROM a""")
def _(spark, d):
    return M.l3_resolution_report(std_rows(spark, d), std_dims(spark), (P, S), ("L2-4",))


def reloc_sql(t: str, i: int) -> str:
    return "CASE" + "".join(f" WHEN {rx(t, p)} THEN '{(a, b)[i]}'" for p, a, b in PK["relocate"]) + f" ELSE '{PK['relocate_default'][i]}' END"


CAP = f"""CASE WHEN tt = '' THEN 'empty_text' WHEN {rx('tt', 'schsch|ndnd')} THEN 'blocked:neg' WHEN {rx('tt', 'ouou')} AND {rx('tt', 're')} THEN 'blocked:dom' WHEN {rx('tt', 'paier')} AND NOT {rx('tt', 'le')} THEN 'blocked:open'
 WHEN nn <= 300 AND {rx('tt', 'the|le')} THEN 'eligible:short' WHEN {rx('tt', 'thank|éeauaux')} THEN 'eligible:praise' WHEN {rx('tt', 'icht')} AND {rx('tt', 'der')} THEN 'eligible:ask' ELSE 'no_capture_pattern' END"""
CAPQ = f"cq AS (SELECT *, {CAP} AS capture FROM (SELECT *, {q.s('original_text')} AS tt, length({q.sq('original_text')}) AS nn FROM opinion))"


@query("capture_diagnosis", f"WITH {CAPQ} SELECT opinion_id, capture FROM cq")
def _(spark, d):
    return C.capture_code(opinion(spark, d), T, PK).select("opinion_id", "capture")


@query("capture_summary", f"WITH {CAPQ} SELECT capture, count(*) AS n FROM cq GROUP BY 1")
def _(spark, d):
    return C.capture_summary(opinion(spark, d), T, PK)


def _hit(k: str) -> str:
    return f"regexp_matches(original_text, '(?i){prose.INSIGHT[k]}')"


INTENT = f"""CASE WHEN {_hit('praise')} AND NOT {_hit('fault')} AND NOT {_hit('escalate')} THEN '表扬' WHEN {_hit('escalate')} THEN '投诉升级' WHEN {_hit('help')} THEN '求助'
  WHEN {_hit('suggest')} AND NOT {_hit('fault')} THEN '建议' WHEN {_hit('fault')} THEN '报障' WHEN {_hit('consult')} THEN '咨询' WHEN o1 = '{N}' THEN (CASE WHEN {_hit('inform')} THEN '告知' ELSE '咨询' END)
  WHEN {_hit('inform')} THEN '告知' WHEN o1 = '{P}' THEN '报障' ELSE '告知' END"""
# The cascade's triple, then the whitelist guard, the conflict check and the routing of the row.
BATCHQ = f"""{CASC}, {WLS}, {NEAR}, {CAPQ},
 mz AS (SELECT mm.*, CASE WHEN l3 = 'sym-a' THEN 'L2-9' WHEN l3 = 'sym-b' THEN 'L2-8' WHEN l3 = 'weak-e' THEN 'L2-7' WHEN l3 = 'weak-s' THEN 'L2-6' ELSE l2 END AS z2,
   CASE WHEN mt = 'routed' THEN least(0.92, 0.52 + m.asc_ / 200.0) WHEN mt = 'cluster_l3' THEN m.bc WHEN mt = 'generic_l3' THEN m.ccf WHEN mt = 'scored' THEN least(0.92, 0.55 + m.dsc / 200.0) WHEN mt = 'exact' THEN 0.88 WHEN mt = 'fuzzy' THEN 0.68
     WHEN l3 LIKE 'sym-%' THEN 0.52 WHEN l3 = 'weak-e' THEN 0.45 WHEN l3 = 'weak-s' THEN 0.40 END::DOUBLE AS zc FROM (SELECT id, h, l1, l2, l3, mt FROM mm) mm JOIN (SELECT id, asc_, bc, ccf, dsc FROM m) m ON m.id = mm.id),
 h0 AS (SELECT c0.id, coalesce(g1, r1, mz.l1) AS l1, coalesce(g2, r2, mz.z2) AS l2, coalesce(g3, r3, mz.l3) AS l3, coalesce(CASE WHEN g1 IS NOT NULL THEN 0.99 END, rc, zc)::DOUBLE AS c,
   CASE WHEN g1 IS NOT NULL THEN 'gold_review' WHEN c0.h IS NOT NULL THEN 'clean_l1' WHEN r1 IS NOT NULL THEN 'rule' WHEN mz.l3 = 'weak-s' THEN 'generic_l3' ELSE mz.mt END AS mt FROM c0 LEFT JOIN mz ON mz.id = c0.id),
 h1 AS (SELECT cq.id, cq.opinion_id, cq.original_text, cq.review_status, capture, tt, CASE WHEN h0.l3 IS NULL THEN '' ELSE h0.l1 END AS l1, CASE WHEN h0.l3 IS NULL THEN '' ELSE h0.l2 END AS l2, coalesce(h0.l3, '') AS l3,
   CASE WHEN h0.l3 IS NULL THEN 0.0 ELSE c END AS c, CASE WHEN h0.l3 IS NULL THEN 'none' ELSE mt END AS mt FROM cq JOIN h0 ON h0.id = cq.id),
 h2 AS (SELECT h1.*, l1 = '{N}' AS isn, l1 = '{N}' OR l1 = '' OR l2 = '' AS skip, opts FROM h1 LEFT JOIN wo USING (l1)),
 h3 AS (SELECT *, NOT skip AND opts IS NOT NULL AND NOT list_contains(opts, l2) AS rej FROM h2),
 h4 AS (SELECT *, CASE WHEN isn THEN '' WHEN rej THEN opts[1] ELSE l2 END AS m2, CASE WHEN rej THEN least(c, 0.4) ELSE c END AS c2 FROM h3),
 h5 AS (SELECT *, NOT skip AND m2 = 'L2-3' AND {rx('original_text', 'ment')} AS cg, NOT skip AND starts_with(capture, 'eligible') AS cap FROM h4),
 h6 AS (SELECT *, mt = 'gold_review' AS au, CASE WHEN cg THEN {reloc_sql('original_text', 0)} ELSE l1 END AS l1b, CASE WHEN cg THEN {reloc_sql('original_text', 1)} ELSE m2 END AS l2b, CASE WHEN cg THEN least(c2, 0.45) ELSE c2 END AS c3 FROM h5),
 h7 AS (SELECT *, CASE WHEN au THEN l1 WHEN cap THEN '{N}' ELSE l1b END AS o1, CASE WHEN au THEN l2 WHEN cap THEN '' ELSE l2b END AS o2, CASE WHEN au THEN c WHEN cap THEN greatest(c3, 0.85) ELSE c3 END AS oc, (rej OR cg) AND NOT cap AND NOT au AS nr,
   (cap OR (rej AND NOT cap) OR (cg AND NOT cap)) AND NOT au AS guard FROM h6),
 h8 AS (SELECT *, CASE WHEN mt NOT IN ('gold_review', 'none') AND NOT nr THEN (CASE WHEN o1 = '{N}' AND {anyw('original_text', ('eaux', 'tion'))} THEN 'C1' WHEN o1 = '{S}' AND {anyw('original_text', ('ould', 'chung', 'paier'))} THEN 'C2'
   WHEN o1 = '{E}' AND {anyw('original_text', ('ould', 'chung', 'paier'))} THEN 'C3' WHEN o1 = '{S}' AND {anyw('original_text', ('eaux', 'tion'))} THEN 'C4' ELSE '' END) ELSE '' END AS ck FROM h7),
 bt AS (SELECT *, CASE WHEN ck <> '' THEN least(oc, 0.40) ELSE oc END AS fc, nr OR ck <> '' AS fr FROM h8)"""


@query("batch_classify", f"""
WITH {BATCHQ} SELECT opinion_id, o1 AS v3_l1, o2 AS v3_l2, l3 AS v3_l3, round(fc, 6) AS v3_confidence, mt AS v3_match_type, CASE WHEN tt = '' THEN review_status WHEN review_status = 1 THEN 1 WHEN fr OR fc < 0.52 THEN 2 ELSE 0 END AS review_status,
  ck AS conflict_kind, fr AS needs_review, {INTENT} AS intent FROM bt""")
def _(spark, d):
    o = opinion(spark, d)
    b = M.batch_classify(o, PK, taxonomy(spark), clusters(spark), whitelist(spark), M.gold_rows(o), hints(o), prose.INSIGHT)
    return b.select("opinion_id", "v3_l1", "v3_l2", "v3_l3", F.round("v3_confidence", 6).alias("v3_confidence"), "v3_match_type", "review_status", "conflict_kind", "needs_review", "intent")


@query("batch_route_metrics", f"""
WITH {BATCHQ}, r AS (SELECT *, CASE WHEN tt = '' THEN 'skipped_empty' WHEN mt = 'gold_review' THEN 'gold_hit' WHEN ck <> '' THEN 'conflict' WHEN mt = 'none' THEN 'failed' WHEN fr OR fc < 0.52 THEN 'rule_low_conf' ELSE 'rule_ok' END AS route FROM bt)
SELECT route, CASE WHEN route = 'conflict' THEN ck ELSE '' END AS kind, count(*) AS n, count(*) FILTER (WHERE guard AND route IN ('rule_ok', 'rule_low_conf')) AS guard_triggered FROM r GROUP BY 1, 2""")
def _(spark, d):
    from plaintide.operators.evaluate import route_metrics
    o = opinion(spark, d)
    b = M.batch_classify(o, PK, taxonomy(spark), clusters(spark), whitelist(spark), M.gold_rows(o), hints(o), prose.INSIGHT)
    return route_metrics(b.withColumn("cache_hit", F.lit(False)), F.lit(False))


@query("l2_whitelist_guard", f"""
WITH {WLS}, {NEAR}, {CAPQ}, a AS (SELECT id, opinion_id, original_text, capture, {q.canon_b('v3_l1')} AS l1, v3_l2 AS l2, v3_confidence AS c, {q.canon_b('v3_l1')} = '{N}' AS isn FROM cq),
 b AS (SELECT a.*, isn OR l1 = '' OR l2 = '' AS skip, opts FROM a LEFT JOIN wo USING (l1)),
 c AS (SELECT *, NOT skip AND opts IS NOT NULL AND NOT list_contains(opts, l2) AS rej FROM b),
 d AS (SELECT *, CASE WHEN isn THEN '' WHEN rej THEN opts[1] ELSE l2 END AS m2, CASE WHEN rej THEN least(c, 0.4) ELSE c END AS c2 FROM c),
 e AS (SELECT *, NOT skip AND m2 = 'L2-3' AND {rx('original_text', 'ment')} AS cg FROM d),
 f AS (SELECT *, CASE WHEN cg THEN {reloc_sql('original_text', 0)} ELSE l1 END AS l1b, CASE WHEN cg THEN {reloc_sql('original_text', 1)} ELSE m2 END AS l2b, CASE WHEN cg THEN least(c2, 0.45) ELSE c2 END AS c3, NOT skip AND starts_with(capture, 'eligible') AS cap FROM e)
SELECT opinion_id, CASE WHEN cap THEN '{N}' ELSE l1b END AS l1, CASE WHEN cap THEN '' ELSE l2b END AS l2, CASE WHEN cap THEN greatest(c3, 0.85) ELSE c3 END AS confidence, (rej OR cg) AND NOT cap AS needs_review,
  rej AND NOT cap AS l2_whitelist_reject, cg AND NOT cap AS l2_consult_guard, cap AS positive_capture FROM f""")
def _(spark, d):
    o = opinion(spark, d).select("opinion_id", T, labels.canonical_or_blank("v3_l1").alias("l1"), F.col("v3_l2").alias("l2"), F.col("v3_confidence").alias("confidence"), F.lit(False).alias("needs_review"))
    return C.l2_whitelist_guard(o, M.options_dim(whitelist(spark)), PK).select(
        "opinion_id", "l1", "l2", "confidence", "needs_review", "l2_whitelist_reject", "l2_consult_guard", "positive_capture")


@query("rule_conflict", f"""
SELECT opinion_id, CASE WHEN v3_l1 = '{N}' AND {anyw('original_text', ('eaux', 'tion'))} THEN 'C1' WHEN v3_l1 = '{S}' AND {anyw('original_text', ('ould', 'chung', 'paier'))} THEN 'C2'
  WHEN v3_l1 = '{E}' AND {anyw('original_text', ('ould', 'chung', 'paier'))} THEN 'C3' WHEN v3_l1 = '{S}' AND {anyw('original_text', ('eaux', 'tion'))} THEN 'C4' ELSE '' END AS conflict FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", C.rule_conflict(F.col("v3_l1"), F.col(T), PK["conflicts"], PK["conflict_groups"]).alias("conflict"))


G = PK["guard"]
DOM2 = f"CASE WHEN {rx('x', 'mentre')} THEN 'L2-2' WHEN {rx('x', 'qq')} THEN 'L2-1' WHEN {rx('x', 'zzz')} AND NOT {rx('x', 'qq')} AND NOT {rx('x', 'yy')} THEN '' WHEN {rx('x', 'eauou')} OR {rx('x', 'ationou')} THEN 'L2-1' ELSE '' END"


def _l2of(l1: str) -> str:
    return f"CASE {l1} WHEN '{P}' THEN pl2 WHEN '{S}' THEN sl2 ELSE 'L2-2' END"


GUARDQ = f"""{CAPQ}, g0 AS (SELECT opinion_id, source, coalesce(original_text,'') AS x, {q.canon('v3_l1')} AS l1, {q.s('v3_l2')} AS l2, starts_with(capture, 'eligible') AS elig FROM cq),
 g1 AS (SELECT *, {', '.join(f"{rx('x', v)} AS g_{k}" for k, v in G['signals'].items())}, {DOM2} AS dom2, CASE WHEN {rx('x', 'ouelle')} THEN 'L2-3' WHEN {rx('x', 'lich')} THEN 'L2-1' ELSE 'L2-4' END AS sl2,
   {reloc_sql('x', 0)} AS rel1, {reloc_sql('x', 1)} AS rel2 FROM g0),
 g2 AS (SELECT *, CASE WHEN dom2 <> '' THEN dom2 WHEN {rx('x', 'eau')} THEN 'L2-1' ELSE 'L2-0' END AS pl2 FROM g1),
 a1 AS (SELECT *, l1 = '{N}' AND g_issue AND NOT g_exempt AS f1, CASE WHEN g_product_tilt AND g_fault THEN '{P}' WHEN g_experience_tilt AND NOT g_fault THEN '{E}' WHEN g_service_tilt AND NOT g_product_tilt THEN '{S}'
    WHEN g_product_tilt THEN '{P}' WHEN g_wish AND NOT g_fault THEN '{E}' ELSE '{P}' END AS tilt FROM g2),
 a2 AS (SELECT * REPLACE (CASE WHEN f1 THEN tilt ELSE l1 END AS l1, CASE WHEN f1 THEN {_l2of('tilt')} ELSE l2 END AS l2) FROM a1),
 a3 AS (SELECT *, l2 = 'L2-3' AND g_negative AS f2 FROM a2),
 a4 AS (SELECT * REPLACE (CASE WHEN f2 THEN rel1 ELSE l1 END AS l1, CASE WHEN f2 THEN rel2 ELSE l2 END AS l2) FROM a3),
 a5 AS (SELECT *, l1 = '{N}' AND g_domain AND g_domain_complaint AS f3 FROM a4),
 a6 AS (SELECT * REPLACE (CASE WHEN f3 THEN '{P}' ELSE l1 END AS l1, CASE WHEN f3 THEN pl2 ELSE l2 END AS l2) FROM a5),
 a7 AS (SELECT *, l1 = '{N}' AND g_service_issue AS f4 FROM a6),
 a8 AS (SELECT * REPLACE (CASE WHEN f4 THEN '{S}' ELSE l1 END AS l1, CASE WHEN f4 THEN sl2 ELSE l2 END AS l2) FROM a7),
 b1 AS (SELECT *, CASE WHEN l1 = '{S}' AND g_product_tilt AND g_fault AND NOT g_service_tilt THEN '{P}' WHEN l1 = '{P}' AND g_service_tilt AND (NOT g_product_tilt OR (NOT g_fault AND g_service_word)) THEN '{S}'
    WHEN l1 = '{E}' AND g_product_tilt AND g_fault THEN '{P}' WHEN l1 = '{E}' AND g_service_tilt AND NOT g_product_tilt AND NOT g_fault AND NOT g_experience_tilt THEN '{S}'
    WHEN l1 = '{P}' AND g_experience_tilt AND NOT g_fault AND NOT g_service_tilt THEN '{E}' END AS tg FROM a8),
 b2 AS (SELECT * REPLACE (coalesce(tg, l1) AS l1, CASE WHEN tg IS NOT NULL THEN {_l2of('tg')} ELSE l2 END AS l2, f2 AND NOT (f3 OR f4 OR tg IS NOT NULL) AS f2), tg IS NOT NULL AS f5 FROM b1),
 b3 AS (SELECT *, elig AND NOT (f3 AND g_domain AND g_domain_consult) AND NOT (l1 = '{P}' AND l2 = 'L2-1' AND g_station_inquiry) AND NOT (l1 = '{N}' AND l2 = '') AS f6 FROM b2),
 b4 AS (SELECT * REPLACE (CASE WHEN f6 THEN '{N}' ELSE l1 END AS l1, CASE WHEN f6 THEN '' ELSE l2 END AS l2, f2 AND NOT f6 AS f2, f3 AND NOT f6 AS f3, f4 AND NOT f6 AS f4) FROM b3),
 b5 AS (SELECT *, NOT g_context_block AND ((g_coordination AND NOT g_coordination_block) OR (g_assist AND g_assist_intent AND NOT g_explicit_issue) OR ({rx('source', 'web|s1')} AND g_story AND NOT g_demand))
    AND NOT ((l1 = '{E}' AND l2 = 'L2-2') OR (l1 = '{P}' AND l2 = 'L2-2') OR (l1 = '{S}' AND l2 = 'L2-4')) AND NOT (l1 = '{P}' AND dom2 <> '' AND dom2 = l2) AS f7 FROM b4),
 b6 AS (SELECT * REPLACE (CASE WHEN f7 THEN '{N}' ELSE l1 END AS l1, CASE WHEN f7 THEN '' ELSE l2 END AS l2, f3 AND NOT f7 AS f3, f4 AND NOT f7 AS f4, f5 AND NOT f7 AS f5) FROM b5),
 b7 AS (SELECT *, l1 = '{P}' AND dom2 <> '' AND dom2 <> l2 AND NOT ((l2 = 'L2-2' AND dom2 = 'L2-1' AND (g_vehicle_dominant OR g_station_inquiry)) OR (l2 = 'L2-1' AND dom2 = 'L2-2' AND (g_station OR g_supplier))) AS f8 FROM b6),
 gc AS (SELECT opinion_id, l1, CASE WHEN f8 THEN dom2 WHEN l1 = '{N}' THEN '' ELSE l2 END AS l2, f1 AS f_non_issue_guard, f2 AS f_consult_misclass, f3 AS f_domain_guard, f4 AS f_service_guard, f5 AS f_rebalance, f6 AS f_captured, f7 AS f_context, f8 AS f_domain_l2 FROM b7)"""


def guarded(spark, d):
    o = opinion(spark, d).select("opinion_id", T, "source", F.col("v3_l1").alias("l1"), F.col("v3_l2").alias("l2"), F.col("v3_confidence"))
    return C.guard_chain(o, PK)


@query("guard_chain", f"WITH {GUARDQ} SELECT * FROM gc")
def _(spark, d):
    return guarded(spark, d).drop(T, "source", "v3_confidence")


@query("flag_confidence", f"""
WITH {GUARDQ}, j AS (SELECT gc.*, o.v3_confidence AS c FROM gc JOIN opinion o USING (opinion_id)), k1 AS (SELECT *, CASE WHEN f_non_issue_guard THEN greatest(c, 0.82) ELSE c END AS c1 FROM j),
 k2 AS (SELECT *, CASE WHEN f_consult_misclass THEN least(c1, 0.45) ELSE c1 END AS c2 FROM k1), k3 AS (SELECT *, CASE WHEN f_domain_guard THEN greatest(c2, 0.84) ELSE c2 END AS c3 FROM k2),
 k4 AS (SELECT *, CASE WHEN f_service_guard THEN greatest(c3, 0.83) ELSE c3 END AS c4 FROM k3)
SELECT opinion_id, CASE WHEN f_captured THEN greatest(c4, 0.86) ELSE c4 END AS confidence FROM k4""")
def _(spark, d):
    return guarded(spark, d).select("opinion_id", C.flag_confidence(F.col("v3_confidence")).alias("confidence"))


@query("review_routing", """
SELECT opinion_id, CASE WHEN review_status = 1 THEN 1 WHEN id % 9 = 0 OR v3_confidence < 0.52 THEN 2 ELSE 0 END AS new_status FROM opinion""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", C.review_routing(F.col("review_status"), F.col("id") % 9 == 0, F.col("v3_confidence")).alias("new_status"))


def kw_sql(t: str) -> str:
    sc = ", ".join(f"{cnt(t, w)} * {wt} AS s{i}" for i, (_, wt, w) in enumerate(PK["weights"]))
    cls = "CASE " + " ".join(f"WHEN s{i} = mx THEN '{c}'" for i, (c, _, _) in enumerate(PK["weights"])) + " END"
    return f"""kq0 AS (SELECT *, lower(original_text) AS lw FROM opinion), kq1 AS (SELECT *, {sc.replace(t, 'lw')} FROM kq0),
 kq2 AS (SELECT *, greatest(s0, s1, s2, s3) AS mx, list_sort(list_filter([s0, s1, s2, s3], lambda v: v > 0), 'DESC') AS ls, {anyw('lw', PK['non_issue'])} AND NOT {anyw('lw', PK['non_issue_negations'])} AS nz, {anyw('lw', PK['facilities'])} AND {anyw('lw', PK['triggers'])} AS fr FROM kq1),
 kq AS (SELECT *, CASE WHEN nz THEN '非问题' WHEN fr THEN '产品质量问题' WHEN mx > 0 THEN {cls} END AS kw_class, CASE WHEN nz OR fr THEN 1.0 WHEN mx <= 0 THEN 0.0 WHEN len(ls) = 1 THEN 0.9 ELSE round(least(1.0, 0.7 + (ls[1] - ls[2]) * 0.05), 2) END::DOUBLE AS kw_confidence FROM kq2)"""


@query("weighted_keyword_classify", f"WITH {kw_sql('lw')} SELECT opinion_id, kw_class, kw_confidence FROM kq")
def _(spark, d):
    return C.weighted_keyword_classify(opinion(spark, d), PK).select("opinion_id", "kw_class", "kw_confidence")


@query("force_consult", f"""
WITH t AS (SELECT opinion_id, lower(original_text) AS l, {q.sq('lower(original_text)')} AS sq FROM opinion)
SELECT opinion_id, NOT {anyw('l', ('schsch', 'ndnd'))} AND ((length(sq) BETWEEN 1 AND 15 AND {anyw('sq', ('a', 'e'))}) OR {anyw('l', ('merci', 'éeau'))} OR {anyw('l', ('quoi', 'with the'))}) AS forced FROM t""")
def _(spark, d):
    return opinion(spark, d).select("opinion_id", C.force_consult(F.col(T), ("schsch", "ndnd"), ("a", "e"), ("merci", "éeau"), ("quoi", "with the")).alias("forced"))


B = PK["boundary_words"]


@query("boundary_relabel", f"""
WITH t AS (SELECT opinion_id, {legacy_sql('model_class')} AS label, lower(original_text) AS l FROM opinion),
 u AS (SELECT *, {anyw('l', B['fault'])} AS has_fault, {anyw('l', B['suggest'])} AS has_suggest, {anyw('l', B['service'])} AS has_service, {anyw('l', B['non_issue'])} AS has_n FROM t),
 v AS (SELECT *, CASE WHEN has_fault THEN '产品质量问题' WHEN has_n THEN '非问题' WHEN has_suggest THEN '体验需求' WHEN has_service THEN '销售服务问题' ELSE label END AS corrected_label, CASE WHEN has_fault THEN 'f' WHEN has_n THEN 'n' WHEN has_suggest THEN 's' WHEN has_service THEN 'v' ELSE '' END AS reason FROM u)
SELECT opinion_id, label, corrected_label, reason, has_fault, has_suggest, has_service FROM v WHERE corrected_label <> label""")
def _(spark, d):
    o = opinion(spark, d).select("opinion_id", labels.legacy_class("model_class").alias("label"), T)
    return C.boundary_relabel(o, "label", PK).select("opinion_id", "label", "corrected_label", "reason", "has_fault", "has_suggest", "has_service")


@query("mixed_expression_rows", f"""
SELECT * FROM (SELECT opinion_id, CASE WHEN v3_l1 = '{E}' AND {anyw('original_text', ('tion', 'ung'))} THEN 'exp+fault' WHEN v3_l1 = '{S}' AND {anyw('original_text', ('eaueau',))} THEN 'srv+fault'
  WHEN v3_l1 = '{P}' AND {anyw('original_text', ('avec', 'ould'))} THEN 'prod+wish' END AS mix_type FROM opinion) WHERE mix_type IS NOT NULL""")
def _(spark, d):
    return C.mixed_expression_rows(opinion(spark, d), "v3_l1", PK).select("opinion_id", "mix_type")


@query("output_keyword_vote", f"""
WITH t AS (SELECT conv_id, turn, {cnt('lower(text)', ('tion', 'ment', 'eau'))} AS a, {cnt('lower(text)', ('lich', 'und', 'with'))} AS b, {cnt('lower(text)', ('que', 'of', 'der', 'le'))} AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= greatest(b, c) THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS vote FROM t""", needs_opinion=False)
def _(spark, d):
    groups = [("A", ("tion", "ment", "eau")), ("B", ("lich", "und", "with")), ("C", ("que", "of", "der", "le"))]
    return table(spark, d, "conversations").select("conv_id", "turn", C.output_keyword_vote(F.col("text"), groups).alias("vote"))


TAGS = [("L2-0", "质量问题"), ("L3-1", "营销服务"), ("web", "体验需求"), ("L2-3", "非问题")]
TAGQ = f"tg(tag, cls) AS (VALUES {vals(TAGS)})"


def tagged(o):
    return o.withColumns({"tag1": F.col("source"), "tag2": F.concat(F.lit(" "), labels.first_keyword("model_keyword")), "tag3": F.col("v3_l3")})


@query("tag_map_lookup", f"""
WITH {TAGQ} SELECT opinion_id, coalesce((SELECT cls FROM tg WHERE tag = trim(v3_l3)), (SELECT cls FROM tg WHERE tag = {q.kw1()}), (SELECT cls FROM tg WHERE tag = trim(source))) AS mapped FROM opinion""")
def _(spark, d):
    return C.tag_map_lookup(tagged(opinion(spark, d)), dim(spark, TAGS, "tag string, class string")).select("opinion_id", "mapped")


@query("learn_tags", f"""
WITH {TAGQ}, c AS (SELECT coalesce(nullif(trim(v3_l3),''), nullif({q.kw1()},''), nullif(trim(source),'')) AS tag, {legacy_sql('review_l1')} AS cls, id FROM opinion),
 n AS (SELECT tag, arg_min(cls, id) AS cls FROM c WHERE tag IS NOT NULL AND cls IN ('质量问题','营销服务','体验需求','咨询','非问题') GROUP BY 1)
SELECT tag, cls AS class FROM tg UNION ALL SELECT tag, cls FROM n WHERE tag NOT IN (SELECT tag FROM tg)""")
def _(spark, d):
    from plaintide.packs.labels import LEGACY_CLASSES
    o = tagged(opinion(spark, d)).select("tag1", "tag2", "tag3", labels.legacy_class("review_l1").alias("class"), F.col("id").alias("seq"))
    return C.learn_tags(dim(spark, TAGS, "tag string, class string"), o, LEGACY_CLASSES)


CORE = [w for _, _, ws in PK["weights"] for w in ws[:20]] + list(PK["non_issue"][:20])


@query("feed_cascade", f"""
WITH {TAGQ}, {kw_sql('lw')}, m AS (SELECT *, CASE WHEN id % 2 = 0 THEN coalesce((SELECT cls FROM tg WHERE tag = trim(v3_l3)), (SELECT cls FROM tg WHERE tag = {q.kw1()}), (SELECT cls FROM tg WHERE tag = trim(source))) END AS mp FROM kq),
 r AS (SELECT opinion_id, coalesce(mp, kw_class, model_class) AS result, CASE WHEN mp IS NOT NULL THEN 1.0 WHEN kw_class IS NOT NULL THEN kw_confidence WHEN {anyw('lw', CORE)} THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence,
   CASE WHEN mp IS NOT NULL THEN 'tag_map' WHEN kw_class IS NOT NULL THEN 'keywords' ELSE 'model' END AS way FROM m)
SELECT *, confidence >= 0.9 AS auto_reviewed FROM r""")
def _(spark, d):
    even = F.col("id") % 2 == 0
    o = tagged(opinion(spark, d)).withColumns({c: F.when(even, F.col(c)).otherwise("") for c in ("tag1", "tag2", "tag3")})
    return C.feed_cascade(o, dim(spark, TAGS, "tag string, class string"), PK).select("opinion_id", "result", "confidence", "way", "auto_reviewed")


@query("model_response_parse", f"""
WITH {WLS}, {NEAR}, t AS (SELECT opinion_id, regexp_extract(concat('answer: ', CASE WHEN id % 19 = 0 THEN replace(v3_label_meta, '"l1"', '"x"') ELSE v3_label_meta END, ' done'), '(?s)\\{{.*\\}}', 0) AS o FROM opinion),
 u AS (SELECT *, {q.try_canon(q.s(q.js('o', 'l1')))} AS c1, {q.s(q.js('o', 'l2'))} AS c2, try_cast({q.js('o', 'confidence')} AS DOUBLE) AS cf FROM t),
 v AS (SELECT u.*, CASE WHEN o = '' OR NOT json_valid(o) THEN 'parse_failed' WHEN c1 IS NULL OR NOT (c1 = '{N}' OR coalesce(list_contains(opts, c2), false)) THEN 'whitelist_reject' ELSE 'ok' END AS status FROM u LEFT JOIN wo ON wo.l1 = c1)
SELECT opinion_id, status, CASE WHEN status = 'ok' THEN c1 ELSE '' END AS l1, CASE WHEN status = 'ok' AND c1 <> '{N}' THEN c2 ELSE '' END AS l2, '低' AS risk_level, CASE WHEN status = 'ok' THEN coalesce(cf, 0.75) ELSE 0.0 END AS confidence FROM v""")
def _(spark, d):
    meta = F.when(F.col("id") % 19 == 0, F.replace("v3_label_meta", F.lit('"l1"'), F.lit('"x"'))).otherwise(F.col("v3_label_meta"))
    o = opinion(spark, d).select("opinion_id", F.concat(F.lit("answer: "), meta, F.lit(" done")).alias("answer"))
    return C.model_response_parse(o, "answer", M.options_dim(whitelist(spark))).select("opinion_id", "status", "l1", "l2", "risk_level", "confidence")


@query("fewshot_examples", f"""
WITH qs AS (SELECT item_id AS qid, text FROM benchmark), tk AS (SELECT DISTINCT qid, lower(unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 6))) AS tok FROM (SELECT qid, regexp_extract_all(text, '[一-鿿]{{2,}}|[A-Za-z]{{2,}}') AS l FROM qs)),
 rv AS (SELECT id, coalesce(nullif(reviewed_at,''), create_time, '') AS ts, original_text AS sm FROM opinion WHERE review_status = 1 AND {q.s('review_l1')} <> '' AND {q.s('review_l2')} <> ''),
 cd AS (SELECT DISTINCT qid, rv.id, ts FROM tk JOIN rv ON contains(lower(sm), tok)), c24 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ts DESC, id DESC) AS rn FROM cd) WHERE rn <= 24),
 fb AS (SELECT id, ts FROM rv ORDER BY ts DESC, id DESC LIMIT 20), al AS (SELECT qid, id, ts FROM c24 UNION ALL SELECT qid, fb.id, fb.ts FROM qs, fb WHERE qid NOT IN (SELECT qid FROM c24)),
 sh AS (SELECT al.*, len(list_intersect(list_distinct(string_split(qs.text, '')), list_distinct(string_split(rv.sm, '')))) AS shared FROM al JOIN qs USING (qid) JOIN rv ON rv.id = al.id)
SELECT qid, rank::INT AS rank, id, shared::INT AS shared FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, ts DESC, id DESC) AS rank FROM sh) WHERE rank <= 4""")
def _(spark, d):
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return M.fewshot_examples(qs, opinion(spark, d)).select("qid", "rank", "id", "shared")


@query("label_audit_import", f"""
WITH {WLS}, {NEAR}, sh AS (SELECT CASE WHEN id % 11 = 0 THEN concat('X', opinion_id) ELSE opinion_id END AS oid, CASE WHEN id % 6 = 1 THEN '' ELSE model_class END AS n1, CASE WHEN id % 6 IN (1, 2) AND id % 12 <> 1 THEN '' WHEN id % 6 = 3 THEN '别名' WHEN id % 6 = 4 THEN 'L2' ELSE v3_l2 END AS n2 FROM opinion WHERE id % 2 = 0 OR id % 3 = 0),
 a AS (SELECT oid, {q.canon_b('n1')} AS l1, n1, n2, CASE WHEN n2 = '别名' THEN 'L2-1' ELSE n2 END AS nm FROM sh),
 b AS (SELECT a.*, opts, list_filter(opts, lambda o: starts_with(o, nm) OR starts_with(nm, o)) AS pf, list_filter(opts, lambda o: contains(o, nm) OR contains(nm, o)) AS ct FROM a LEFT JOIN wo USING (l1)),
 c AS (SELECT *, CASE WHEN n2 = '' THEN '' WHEN opts IS NULL OR list_contains(opts, nm) THEN nm WHEN len(pf) = 1 THEN pf[1] WHEN len(ct) = 1 THEN ct[1] END AS l2 FROM b)
SELECT oid AS opinion_id, c.l1 AS new_l1, l2 AS new_l2, CASE WHEN o.opinion_id IS NOT NULL THEN {q.s('o.review_l1')} END AS old_l1, CASE WHEN o.opinion_id IS NOT NULL THEN {q.s('o.review_l2')} END AS old_l2,
 CASE WHEN n1 = '' AND n2 = '' THEN 'empty' WHEN n1 = '' THEN 'invalid:no_l1' WHEN n2 = '' AND c.l1 <> '{N}' THEN 'invalid:no_l2' WHEN l2 IS NULL THEN 'invalid:not_listed' WHEN o.opinion_id IS NULL THEN 'unknown_id'
   WHEN {q.s('o.review_l1')} = c.l1 AND {q.s('o.review_l2')} = l2 THEN 'same' ELSE 'change' END AS outcome FROM c LEFT JOIN opinion o ON o.opinion_id = c.oid""")
def _(spark, d):
    i = F.col("id")
    o = opinion(spark, d)
    sheet = o.filter((i % 2 == 0) | (i % 3 == 0)).select(
        F.when(i % 11 == 0, F.concat(F.lit("X"), "opinion_id")).otherwise(F.col("opinion_id")).alias("opinion_id"), F.when(i % 6 == 1, "").otherwise(F.col("model_class")).alias("new_l1"),
        F.when((i % 6).isin(1, 2) & (i % 12 != 1), "").when(i % 6 == 3, "别名").when(i % 6 == 4, "L2").otherwise(F.col("v3_l2")).alias("new_l2"))
    return M.label_audit_import(sheet, o, whitelist(spark), {"别名": "L2-1"})
