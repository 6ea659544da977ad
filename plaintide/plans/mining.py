"""Text mining, similarity, clusters and taxonomy queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.functions import labels
from plaintide.functions.common import dim
from plaintide.functions.text import keyword_tokens
from plaintide.operators import hooks, keywords as kwd, mining as mn, similarity as sim, taxonomy as tx
from plaintide.packs import labels as lp
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion, table
from plaintide.plans.insights import ENR, enriched
from plaintide.plans.labelling import TAX, WLS, taxonomy, vals, whitelist
from plaintide.plans.registry import query
from plaintide.plans.scalars import tokens_sql

TOK = f"tk AS (SELECT doc_id, lang, unnest({tokens_sql('text')}) AS tok FROM documents)"


def docs(spark, d):
    return table(spark, d, "documents")


@query("keyword_tf", f"""
WITH {TOK}, c AS (SELECT doc_id, tok, count(*) AS n FROM tk GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1),
 r AS (SELECT c.doc_id, tok, n, n / total::DOUBLE AS score, row_number() OVER (PARTITION BY c.doc_id ORDER BY n / total::DOUBLE DESC, tok) AS rank FROM c JOIN t ON c.doc_id = t.doc_id)
SELECT doc_id, tok AS token, n, round(score, 8) AS score, rank::INT AS rank FROM r WHERE rank <= 20""", needs_opinion=False)
def _(spark, d):
    return kwd.keyword_tf(docs(spark, d)).withColumn("score", F.round("score", 8))


@query("class_top_words", f"""
WITH r AS (SELECT review_l1 AS label, unnest({tokens_sql('original_text')}) AS word FROM opinion WHERE review_status = 1), c AS (SELECT label, word, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 3),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rn FROM c) WHERE rn <= 50),
 u AS (SELECT label, word, n FROM k UNION ALL SELECT DISTINCT review_l1, 'known', 0 FROM opinion WHERE review_l1 IS NOT NULL)
SELECT label, word, max(n)::BIGINT AS n FROM u GROUP BY 1, 2""")
def _(spark, d):
    o = opinion(spark, d)
    known = o.filter(F.col("review_l1").isNotNull()).select(F.col("review_l1").alias("label"), F.lit("known").alias("word")).distinct()
    return kwd.class_top_words(o.filter(labels.is_reviewed()), "review_l1", "original_text", 3, 50, known)


@query("keyword_weights", f"""
WITH r AS (SELECT DISTINCT id, review_l1 AS label, unnest({tokens_sql('original_text')}) AS word FROM opinion WHERE review_status = 1 AND coalesce(review_l1,'') <> ''),
 c AS (SELECT label, word, count(*) AS n, min(id) AS fi FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fi DESC, word) AS rn FROM c)
SELECT label, word, n, round(least(6.0, pow(1.08, n)), 4) AS weight FROM k WHERE rn <= 280""")
def _(spark, d):
    o = opinion(spark, d).filter(labels.is_reviewed())
    return kwd.keyword_weights(o, "review_l1", F.array_distinct(keyword_tokens("original_text")))


def _rank_rounds(n: int) -> str:
    out = "r0 AS (SELECT DISTINCT lang, a, 1.0::DOUBLE AS s FROM sy)"
    for i in range(1, n + 1):
        out += f", r{i} AS (SELECT sy.lang, sy.b AS a, 0.15 + 0.85 * sum(r.s / dg.deg) AS s FROM sy JOIN r{i-1} r ON r.lang = sy.lang AND r.a = sy.a JOIN dg ON dg.lang = sy.lang AND dg.a = sy.a GROUP BY 1, 2)"
    return out


@query("cooccur_rank", f"""
WITH tk AS (SELECT doc_id, lang, {tokens_sql('text')} AS t FROM documents), px AS (SELECT doc_id, lang, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS p FROM tk),
 pr AS (SELECT DISTINCT x.lang, least(x.tok, y.tok) AS a, greatest(x.tok, y.tok) AS b FROM px x JOIN px y ON x.doc_id = y.doc_id AND y.p IN (x.p + 1, x.p + 2, x.p + 3) AND x.tok <> y.tok),
 sy AS (SELECT lang, a, b FROM pr UNION ALL SELECT lang, b, a FROM pr), dg AS (SELECT lang, a, count(*) AS deg FROM sy GROUP BY 1, 2), {_rank_rounds(10)},
 k AS (SELECT lang, a AS word, round(s, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY round(s, 6) DESC, a) AS rank FROM r10)
SELECT lang, word, round(score, 4) AS score FROM k WHERE rank <= 20""", needs_opinion=False)
def _(spark, d):
    return mn.cooccur_rank(docs(spark, d)).select("lang", "word", F.round("score", 4).alias("score"))


EMBEDDED = f"""
WITH t AS (SELECT doc_id, {q.sq('lower(text)')} AS t0 FROM documents), p AS (SELECT doc_id, CASE WHEN length(t0) < 3 THEN substr(t0 || '···', 1, 3) ELSE t0 END AS t FROM t),
 g AS (SELECT doc_id, t, unnest(generate_series(1, length(t) - 2)) AS i FROM p), h AS (SELECT doc_id, right(md5(substr(t, i, 3)), 4) AS x FROM g),
 c AS (SELECT doc_id, ('0x' || right(x, 2))::INT AS dim, sum(CASE WHEN (('0x' || left(x, 2))::INT & 1) = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY 1, 2),
 n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM c GROUP BY 1)
SELECT c.doc_id, count(*) AS nnz, round(sum(CASE WHEN dim < 8 THEN v / n ELSE 0 END), 6) AS head, round(sum(v / n * dim), 4) AS weighted FROM c JOIN n ON c.doc_id = n.doc_id WHERE v <> 0 GROUP BY 1"""


@query("hashing_embedding", EMBEDDED, needs_opinion=False)
def _(spark, d):
    e = sim.hashing_embedding(docs(spark, d))
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.round(F.sum(F.when(F.col("dim") < 8, F.col("value")).otherwise(0.0)), 6).alias("head"),
                                   F.round(F.sum(F.col("value") * F.col("dim")), 4).alias("weighted"))


@query("embed_model", EMBEDDED, needs_opinion=False)
def _(spark, d):
    v = hooks.embed(docs(spark, d), body="text").select("doc_id", F.posexplode("vector").alias("dim", "value")).filter("value <> 0")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.round(F.sum(F.when(F.col("dim") < 8, F.col("value")).otherwise(0.0)), 6).alias("head"),
                                   F.round(F.sum(F.col("value") * F.col("dim")), 4).alias("weighted"))


@query("similar_pairs", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 5) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4""",
       needs_opinion=False)
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return sim.similar_pairs(e, 0.4).withColumn("sim", F.round("sim", 5))


def clusters_sql(vectors: str) -> str:
    """The clusters of vectors e (id, v): components at all 71 thresholds from 0.25 to 0.95 by the spread of the least label, then the search
    from 0.55 in hundredths."""
    return f"""
WITH RECURSIVE {vectors},
 p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.id < b.id WHERE round(list_dot_product(a.v, b.v), 9) >= 0.25),
 g AS (SELECT i::INT AS t, i / 100.0::DOUBLE AS thr FROM generate_series(25, 95) x(i)),
 o AS (SELECT t, a, b FROM p JOIN g ON sim >= thr),
 ed AS (SELECT t, a, b FROM o UNION ALL SELECT t, b, a FROM o UNION SELECT t, a, a FROM o UNION SELECT t, b, b FROM o),
 lab AS (SELECT 0 AS i, t, a AS id, a AS c, true AS go FROM ed WHERE a = b UNION ALL
   SELECT i, t, id, c, bool_or(c <> old) OVER () FROM (SELECT l.i + 1 AS i, ed.t, ed.a AS id, min(l.c) AS c, max(CASE WHEN ed.b = ed.a THEN l.c END) AS old FROM lab l JOIN ed ON ed.t = l.t AND ed.b = l.id WHERE l.go GROUP BY 1, 2, 3)),
 co AS (SELECT t, id, c FROM lab WHERE i = (SELECT max(i) FROM lab)), sz AS (SELECT t, c, count(*) AS size FROM co GROUP BY 1, 2 HAVING count(*) >= 3),
 st AS (SELECT g.t, count(sz.c) AS n, coalesce(max(size), 0) AS largest FROM g LEFT JOIN sz ON sz.t = g.t GROUP BY 1),
 se AS (SELECT 0 AS try, 0 AS used, 55 AS nxt, 'rounds' AS reason, false AS stop UNION ALL
   SELECT try + 1, t, CASE reason WHEN 'none' THEN greatest(25, t - 4) WHEN 'too_large' THEN least(95, t + 3) WHEN 'too_many' THEN greatest(55, t - 2) ELSE t END, reason,
     t = CASE reason WHEN 'none' THEN greatest(25, t - 4) WHEN 'too_large' THEN least(95, t + 3) WHEN 'too_many' THEN greatest(55, t - 2) ELSE t END
   FROM (SELECT se.try, st.t, CASE WHEN n = 0 THEN 'none' WHEN largest > greatest(floor((SELECT count(*) FROM e) * 0.35), 12) THEN 'too_large' WHEN n > 15 THEN 'too_many' ELSE 'ok' END AS reason
     FROM se JOIN st ON st.t = se.nxt WHERE NOT se.stop AND se.try < 24)),
 en AS (SELECT used, reason FROM se ORDER BY try DESC LIMIT 1)
SELECT co.id, co.c AS cluster, size, used / 100.0::DOUBLE AS threshold, reason FROM en JOIN co ON co.t = used JOIN sz ON sz.t = used AND sz.c = co.c"""


@query("similarity_clusters", clusters_sql("e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"), needs_opinion=False)
def _(spark, d):
    return clustered(spark, d)


def clustered(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return sim.similarity_clusters(e)


@query("text_clusters", clusters_sql(f"""t AS (SELECT doc_id, {q.sq('lower(text)')} AS t0 FROM documents), tp AS (SELECT doc_id, CASE WHEN length(t0) < 3 THEN substr(t0 || '···', 1, 3) ELSE t0 END AS t FROM t),
 gr AS (SELECT doc_id, t, unnest(generate_series(1, length(t) - 2)) AS i FROM tp), h AS (SELECT doc_id, right(md5(substr(t, i, 3)), 4) AS x FROM gr),
 ce AS (SELECT doc_id, ('0x' || right(x, 2))::INT AS dim, sum(CASE WHEN (('0x' || left(x, 2))::INT & 1) = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY 1, 2),
 no AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM ce GROUP BY 1),
 e AS (SELECT no.doc_id AS id, list(coalesce(v / n, 0)::FLOAT::DOUBLE ORDER BY d) AS v FROM no JOIN range(256) r(d) ON true LEFT JOIN ce ON ce.doc_id = no.doc_id AND ce.dim = d WHERE n > 0 GROUP BY 1)"""), needs_opinion=False)
def _(spark, d):
    v = sim.dense_vectors(sim.hashing_embedding(docs(spark, d)), "doc_id").withColumnRenamed("doc_id", "id")
    return sim.similarity_clusters(v)


HINTS = f"""{ENR}, hc AS (SELECT *, concat('kw:', substr({q.sq("coalesce(nullif(trim(root_cause_hint),''), nullif(trim(l3),''), nullif(substr(original_text,1,40),''), '未标注')")}, 1, 8)) AS cluster FROM en),
 hs AS (SELECT cluster, count(*) AS size FROM hc GROUP BY 1 HAVING count(*) >= 3), hm AS (SELECT hc.*, size FROM hc JOIN hs USING (cluster))"""


@query("hint_clusters", f"WITH {HINTS} SELECT id, cluster, size FROM hm")
def _(spark, d):
    return mn.hint_clusters(enriched(spark, d)).select("id", "cluster", "size")


PROF = f"""{HINTS}, l2c AS (SELECT cluster, list_sort(list(DISTINCT l2) FILTER (WHERE l2 <> '')) AS l2s, count(*) AS count, sum(CASE severity WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END)::BIGINT AS severity_weighted,
   count(*) FILTER (WHERE severity = '高') AS sev_high, count(*) FILTER (WHERE severity = '中') AS sev_mid, count(*) FILTER (WHERE severity = '低') AS sev_low, count(DISTINCT CASE WHEN l3 <> '' THEN l3 END) AS l3_n FROM hm GROUP BY 1),
 l3c AS (SELECT cluster, l3 FROM (SELECT cluster, l3, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, l3) AS rn FROM hm WHERE l3 <> '' GROUP BY 1, 2) WHERE rn = 1),
 pf AS (SELECT l2c.*, coalesce(l3c.l3, CASE WHEN len(l2s) = 1 THEN l2s[1] WHEN len(l2s) > 1 THEN concat('跨L2:', array_to_string(l2s[1:3], '+')) END) AS theme FROM l2c LEFT JOIN l3c USING (cluster))"""


@query("cluster_profile", f"""
WITH {PROF} SELECT cluster, array_to_string(l2s, '|') AS l2s, count, severity_weighted, sev_high, sev_mid, sev_low, l3_n, theme, len(l2s) >= 2 AS cross_l2, len(l2s) >= 3 AS cross_l2_ge3,
  (SELECT md5(string_agg(replace({q.s('original_text')}, chr(10), ' '), '|' ORDER BY id)) FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS rn FROM hm WHERE {q.s('original_text')} <> '') z WHERE z.cluster = pf.cluster AND rn <= 3) AS quotes FROM pf""")
def _(spark, d):
    p = mn.hint_profile(enriched(spark, d))
    return p.select("cluster", F.array_join("l2_list", "|").alias("l2s"), F.col("count").cast("bigint").alias("count"), "severity_weighted", "sev_high", "sev_mid", "sev_low", "l3_n", "theme",
                    "cross_l2", "cross_l2_ge3", F.md5(F.array_join("quotes", "|")).alias("quotes"))


@query("cluster_purity", f"""
WITH {HINTS}, g AS (SELECT cluster, review_l1, count(*) AS n FROM hm WHERE review_l1 IS NOT NULL GROUP BY 1, 2) SELECT hs.cluster, round(max(n) / sum(n)::DOUBLE, 4) AS purity FROM hs LEFT JOIN g ON g.cluster = hs.cluster GROUP BY 1""")
def _(spark, d):
    e = enriched(spark, d).withColumn("cluster", F.concat(F.lit("kw:"), mn.hint_key()))
    return mn.label_purity(e, label="review_l1", min_size=3)


@query("cross_label_insights", f"""
WITH {PROF} SELECT 'I7' AS template_id, concat('「', theme, '」横跨 ', array_to_string(l2s, ', '), ' 共 ', count, ' 条，按现有标签口径被拆散，实际可能是单一根因') AS text, count, cluster AS cluster_id FROM pf WHERE len(l2s) >= 3""")
def _(spark, d):
    p = mn.hint_profile(enriched(spark, d))
    return mn.cross_label_insights(p).withColumn("count", F.col("count").cast("bigint"))


@query("cross_label_gate", f"""
WITH {PROF} SELECT count(*) AS clusters, count(*) FILTER (WHERE len(l2s) >= 2) AS cross, count(*) FILTER (WHERE len(l2s) >= 3) AS cross_ge3, max(count) AS largest,
  count(*) FILTER (WHERE len(l2s) >= 2) >= 1 AND max(count) / (SELECT count(*) FROM en) < 0.5 AS gate_ok FROM pf""")
def _(spark, d):
    e = enriched(spark, d)
    return mn.cross_label_gate(mn.hint_profile(e), opinion(spark, d).select("id")).withColumn("largest", F.col("largest").cast("bigint"))


# Triples from the model labels, widened so that renames and moves apply.
TRI = f"""tri AS (SELECT {q.s('v3_l1')} AS a, {q.s('v3_l2')} AS b, concat(v3_l3, CASE WHEN v3_l3 = '' THEN '' WHEN id % 7 = 0 THEN '故障' WHEN id % 5 = 0 THEN '建议' WHEN id % 3 = 0 THEN '车机卡顿' ELSE '' END) AS c FROM opinion),
 tf AS (SELECT a AS l1, b AS l2, c AS l3, count(*) AS freq FROM tri WHERE a <> '' AND b <> '' AND c <> '' GROUP BY 1, 2, 3)"""


def triples(spark, d):
    i = F.col("id")
    c = F.concat("v3_l3", F.when(F.col("v3_l3") == "", "").when(i % 7 == 0, "故障").when(i % 5 == 0, "建议").when(i % 3 == 0, "车机卡顿").otherwise(""))
    return tx.label_triple_frequency(opinion(spark, d).withColumn("c", c), "v3_l1", "v3_l2", "c")


RENAMES = [("车机卡顿", "卡顿-车机"), ("充电慢", "充电-速度慢")]
MOVES = [("产品质量类", ("故障", "异响", "黑屏")), ("服务类", ("服务投诉",)), ("体验需求类", ("建议", "希望改进"))]


@query("label_triple_frequency", f"WITH {TRI} SELECT * FROM tf")
def _(spark, d):
    return triples(spark, d)


@query("taxonomy_build", f"WITH {TRI} SELECT l1, l2, string_agg(l3, '|' ORDER BY freq DESC, l3) AS labels, sum(freq)::BIGINT AS total FROM tf GROUP BY 1, 2")
def _(spark, d):
    return tx.taxonomy_build(triples(spark, d)).select("l1", "l2", F.array_join("labels", "|").alias("labels"), "total")


@query("taxonomy_scan", f"""
WITH {TRI} SELECT l1, l2, l3, freq::INT AS freq, (row_number() OVER (PARTITION BY l1, l2 ORDER BY freq DESC, l3) - 1)::INT AS pos FROM tf""")
def _(spark, d):
    return tx.taxonomy_scan(tx.taxonomy_json(triples(spark, d), 5))


@query("taxonomy_optimise", f"""
WITH {TRI}, n AS (SELECT l1, l2, replace(replace(l3, '车机卡顿', '卡顿-车机'), '充电慢', '充电-速度慢') AS l3, freq FROM tf),
 m AS (SELECT CASE WHEN l1 <> '产品质量类' AND regexp_matches(l3, '故障|异响|黑屏') THEN '产品质量类' WHEN l1 <> '服务类' AND regexp_matches(l3, '服务投诉') THEN '服务类'
   WHEN l1 <> '体验需求类' AND regexp_matches(l3, '建议|希望改进') THEN '体验需求类' ELSE l1 END AS l1, l2, l3, freq FROM n)
SELECT l1, l2, l3, sum(freq)::BIGINT AS freq FROM m GROUP BY 1, 2, 3""")
def _(spark, d):
    return tx.taxonomy_optimise(triples(spark, d), RENAMES, MOVES)


@query("taxonomy_optimise_log", f"""
WITH {TRI} SELECT count(*) FILTER (WHERE contains(l3, '车机卡顿')) AS renamed, count(*) FILTER (WHERE (l1 <> '产品质量类' AND contains(l3, '故障')) OR (l1 <> '体验需求类' AND contains(l3, '建议') AND NOT (l1 <> '产品质量类' AND contains(l3, '故障')))) AS moved FROM tf""")
def _(spark, d):
    return tx.optimise_log(triples(spark, d), RENAMES, MOVES).agg(F.count_if("renamed").alias("renamed"), F.count_if("moved").alias("moved"))


@query("taxonomy_sample_check", f"""
WITH {TRI}, rw AS (SELECT {q.canon('review_l1')} AS l1, review_l2 AS l2, concat(review_l3, CASE WHEN id % 7 = 0 THEN '故障' ELSE '' END) AS l3 FROM opinion WHERE review_status = 1),
 s AS (SELECT * FROM rw ORDER BY md5(concat_ws('|', l1, l2, l3, '42')), l1, l2, l3 LIMIT 100)
SELECT l1, l2, l3, CASE WHEN l1 NOT IN (SELECT l1 FROM tf) THEN 'no_l1' WHEN (l1, l2) NOT IN (SELECT (l1, l2) FROM tf) THEN 'no_l2' WHEN (l1, l2, l3) NOT IN (SELECT (l1, l2, l3) FROM tf) THEN 'no_l3' ELSE '' END AS reason FROM s""")
def _(spark, d):
    o = opinion(spark, d).filter(labels.is_reviewed())
    rows = o.select(labels.canonicalize_l1("review_l1").alias("l1"), F.col("review_l2").alias("l2"), F.concat("review_l3", F.when(F.col("id") % 7 == 0, "故障").otherwise("")).alias("l3"))
    return tx.taxonomy_sample_check(rows, triples(spark, d))


HIER = [(lp.PRODUCT, "座舱问题-0"), (lp.PRODUCT, "L2问题"), (lp.PRODUCT, "充电"), (lp.SERVICE, "售后L2"), (lp.SERVICE, "L2-3"), (lp.EXPERIENCE, "建议类"), (lp.NON_ISSUE, "咨询")]
HQ = f"hi(l1, l2, pos) AS (VALUES {vals([(a, b, i) for i, (a, b) in enumerate(HIER)])})"


def hierarchy(spark):
    return dim(spark, [(a, b, i) for i, (a, b) in enumerate(HIER)], "l1 string, l2 string, pos int")


def _j(a: str, b: str) -> str:
    ch = lambda x: f"list_distinct(list_filter(string_split({x}, ''), lambda y: y <> ''))"
    return f"(len(list_intersect({ch(a)}, {ch(b)}))::DOUBLE / greatest(1, len(list_distinct(list_concat({ch(a)}, {ch(b)})))))"


@query("l2_alignment", f"""
WITH {HQ}, nm AS (SELECT DISTINCT {q.canon('v3_l1')} AS l1, v3_l2 AS raw_l2 FROM opinion WHERE v3_l2 <> ''),
 s AS (SELECT nm.l1, raw_l2, hi.l2, pos, CASE WHEN contains(raw_l2, hi.l2) OR contains(hi.l2, raw_l2) THEN greatest({_j('raw_l2', 'hi.l2')}, 0.45) ELSE {_j('raw_l2', 'hi.l2')} END AS sc FROM nm JOIN hi ON hi.l1 = nm.l1)
SELECT l1, raw_l2, CASE WHEN sc >= 0.12 THEN l2 END AS l2, round(sc, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l1, raw_l2 ORDER BY sc DESC, pos) AS rn FROM s) WHERE rn = 1""")
def _(spark, d):
    n = opinion(spark, d).select(labels.canonicalize_l1("v3_l1").alias("l1"), F.col("v3_l2").alias("l2"))
    return tx.l2_alignment(n, hierarchy(spark))


def label_freqs(spark, d):
    t = kwd.keyword_counts(docs(spark, d), ["lang"], "text")
    return t.filter(F.col("n") >= 3).select(F.col("lang").alias("l1"), F.lit("words").alias("l2"), "label", "n")


@query("similar_labels", f"""
WITH tk AS (SELECT lang, unnest({tokens_sql('text')}) AS label FROM documents), f AS (SELECT DISTINCT l1, array_to_string(list_sort(cs), '') AS k, cs FROM
   (SELECT lang AS l1, list_sort(list_distinct(string_split(label, ''))) AS cs FROM tk GROUP BY lang, label HAVING count(*) >= 3))
SELECT a.l1, 'words' AS l2, a.k AS chars, b.k AS other FROM f a JOIN f b ON a.l1 = b.l1 AND a.k <> b.k AND len(b.cs) BETWEEN 0.8 * len(a.cs) AND len(a.cs) / 0.8
WHERE len(list_intersect(a.cs, b.cs)) / (len(a.cs) + len(b.cs) - len(list_intersect(a.cs, b.cs)))::DOUBLE >= 0.8""", needs_opinion=False)
def _(spark, d):
    return tx.similar_sets(label_freqs(spark, d), 0.8)


@query("label_cluster_merge", f"""
WITH RECURSIVE tk AS (SELECT lang AS l1, unnest({tokens_sql('text')}) AS label FROM documents), fr AS (SELECT l1, label, count(*) AS n FROM tk WHERE length(label) >= 2 GROUP BY 1, 2 HAVING count(*) >= 3),
 al AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS bit FROM (SELECT DISTINCT unnest(string_split(label, '')) AS ch FROM fr)),
 mk AS (SELECT l1, label, any_value(n) AS n, bit_or(1::HUGEINT << bit::INT) AS mask FROM (SELECT *, unnest(string_split(label, '')) AS ch FROM fr) JOIN al USING (ch) GROUP BY 1, 2),
 w AS (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, label) AS rn FROM mk),
 gm AS (SELECT DISTINCT l1, 0::BIGINT AS rn, []::HUGEINT[] AS masks, []::BIGINT[] AS seeds, 0::BIGINT AS own FROM w UNION ALL
   SELECT l1, rn, CASE WHEN spot IS NULL THEN list_append(masks, mask) ELSE masks END, CASE WHEN spot IS NULL THEN list_append(seeds, rn) ELSE seeds END, coalesce(seeds[spot], rn)
   FROM (SELECT g.l1, w.rn, w.mask, g.masks, g.seeds, nullif(list_position(list_transform(g.masks, lambda s: bit_count(s & w.mask) / bit_count(s | w.mask)::DOUBLE >= 0.8), true), 0) AS spot FROM gm g JOIN w ON w.l1 = g.l1 AND w.rn = g.rn + 1)),
 me AS (SELECT w.l1, w.label, w.n, c.label AS canonical FROM gm JOIN w ON w.l1 = gm.l1 AND w.rn = gm.rn JOIN w c ON c.l1 = gm.l1 AND c.rn = gm.own),
 kw AS (SELECT DISTINCT l1, canonical, substr(label, i::INT, z::INT) AS g FROM (SELECT *, unnest(generate_series(1, length(label) - z + 1)) AS i FROM me JOIN (VALUES (2), (3), (4)) v(z) ON length(label) >= z)),
 ka AS (SELECT kw.l1, canonical, string_agg(g, '|' ORDER BY length(g) DESC, coalesce(n, 0) DESC, g) AS keywords FROM kw LEFT JOIN fr ON fr.l1 = kw.l1 AND fr.label = g GROUP BY 1, 2),
 sy AS (SELECT l1, canonical, sum(n)::BIGINT AS count, coalesce(string_agg(label, '|' ORDER BY n DESC, label) FILTER (label <> canonical), '') AS synonyms FROM me GROUP BY 1, 2)
SELECT sy.l1, 'words' AS l2, canonical, count, synonyms, keywords FROM sy JOIN ka USING (l1, canonical)""", needs_opinion=False)
def _(spark, d):
    m = tx.label_cluster_merge(label_freqs(spark, d), 0.8)
    return m.select("l1", "l2", "canonical", "count", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("keywords", "|").alias("keywords"))


@query("taxonomy_feedback", f"""
WITH {TAX}, ad AS (SELECT {q.canon('review_l1')} AS l1, review_l2 AS l2, CASE WHEN id % 3 = 0 THEN 'tionou' ELSE review_l3 END AS l3, count(*) AS n FROM opinion WHERE review_status = 1 AND coalesce(review_l2,'') <> '' AND CASE WHEN id % 3 = 0 THEN 'tionou' ELSE review_l3 END <> '' GROUP BY 1, 2, 3)
SELECT coalesce(tax.l1, ad.l1) AS l1, coalesce(tax.l2, ad.l2) AS l2, coalesce(tax.l3, ad.l3) AS l3, (coalesce(freq, 0) + coalesce(n, 0))::BIGINT AS freq, CASE WHEN freq IS NULL THEN 'new' WHEN n IS NULL THEN 'known' ELSE 'counted' END AS kind
FROM tax FULL JOIN ad ON tax.l1 = ad.l1 AND tax.l2 = ad.l2 AND tax.l3 = ad.l3""")
def _(spark, d):
    r = opinion(spark, d).filter(labels.is_reviewed()).select(F.col("review_l1").alias("l1"), F.col("review_l2").alias("l2"),
                                                              F.when(F.col("id") % 3 == 0, "tionou").otherwise(F.col("review_l3")).alias("l3"))
    return tx.taxonomy_feedback(whitelist(spark), taxonomy(spark), r)


@query("whitelist_feedback", f"""
WITH {WLS}, n AS (SELECT DISTINCT {q.canon('review_l1')} AS l1, review_l2 AS l2 FROM opinion WHERE review_status = 1 AND coalesce(review_l2,'') <> '')
SELECT l1, l2, true AS listed FROM wl UNION ALL SELECT l1, l2, false FROM n WHERE (l1, l2) NOT IN (SELECT (l1, l2) FROM wl)""")
def _(spark, d):
    r = opinion(spark, d).filter(labels.is_reviewed()).select(F.col("review_l1").alias("l1"), F.col("review_l2").alias("l2"))
    return tx.whitelist_feedback(whitelist(spark), r)


HIST = f"""hl AS (SELECT {q.canon("coalesce(review_l1,'')")} AS l1, {q.s('review_l2')} AS l2 FROM opinion UNION SELECT {q.canon('model_class')}, {q.kw1()} FROM opinion
  UNION SELECT {q.canon(q.s(q.js('v3_label_meta', 'l1')))}, {q.s(q.js('v3_label_meta', 'l2'))} FROM opinion), hq AS (SELECT DISTINCT l1, l2 FROM hl WHERE l2 <> '')"""


@query("historical_l2", f"WITH {HIST} SELECT * FROM hq")
def _(spark, d):
    return tx.historical_l2(opinion(spark, d))


@query("merged_l2_options", f"""
WITH {HIST}, {WLS}, {HQ}, u AS (SELECT l1, l2, min(p) AS p FROM (SELECT l1, l2, pos AS p FROM wl UNION ALL SELECT l1, l2, NULL FROM hi UNION ALL SELECT l1, l2, NULL FROM hq) GROUP BY 1, 2)
SELECT l1, l2, row_number() OVER (PARTITION BY l1 ORDER BY p NULLS LAST, l2)::INT AS position FROM u""")
def _(spark, d):
    return tx.merged_l2_options(whitelist(spark), hierarchy(spark), tx.historical_l2(opinion(spark, d)))


@query("taxonomy_counts", f"WITH {TRI} SELECT l1, count(DISTINCT l2) AS l2_count, count(*) AS l3_count FROM tf GROUP BY 1")
def _(spark, d):
    return tx.taxonomy_counts(triples(spark, d))


@query("standard_validate", f"""
WITH {TRI}, {WLS}, st AS (SELECT l1, l2, l3 FROM tf UNION ALL SELECT l1, l2, l3 FROM tf WHERE freq > 20 UNION ALL SELECT DISTINCT l1, l2, '' FROM tf WHERE l2 = 'L2-1'),
 f AS (SELECT 'duplicate' AS k, concat(l1, '/', l2, '/', l3) AS item, count(*) AS n FROM st GROUP BY 2 HAVING count(*) > 1 UNION ALL
   SELECT 'multi_parent', l3, count(DISTINCT concat(l1, '/', l2)) FROM st GROUP BY 2 HAVING count(DISTINCT concat(l1, '/', l2)) > 1 UNION ALL
   SELECT 'empty_l3', concat(l1, '/', l2), count(*) FROM st WHERE l3 = '' GROUP BY 2 UNION ALL
   SELECT DISTINCT 'unmapped_l2', l2, 1 FROM st WHERE l2 NOT IN (SELECT l2 FROM wl) AND l2 <> 'L2-9' UNION ALL
   SELECT 'count', l1, count(*) FROM st GROUP BY 2 HAVING count(*) <> CASE l1 WHEN '产品质量类' THEN 129 WHEN '服务类' THEN 85 ELSE -1 END)
SELECT k AS "check", item, n FROM f UNION ALL SELECT 'ok', CASE WHEN count(*) = 0 THEN 'true' ELSE 'false' END, count(*) FROM f""")
def _(spark, d):
    t = triples(spark, d)
    st = t.select("l1", "l2", "l3").union(t.filter("freq > 20").select("l1", "l2", "l3")).union(
        t.filter("l2 = 'L2-1'").select("l1", "l2", F.lit("")).distinct())
    return tx.standard_validate(st, whitelist(spark), {"L2-9": "L2-0"}, {lp.PRODUCT: 129, lp.SERVICE: 85})


@query("theme_map_validate", f"""
WITH {TRI}, pt AS (SELECT DISTINCT concat(l1, '/', l2, '/', l3) AS path FROM tf), tm AS (SELECT path, concat('T', lpad(cast(ascii(right(path, 1)) % 40 AS string), 2, '0')) AS theme_id, ascii(left(path, 1)) % 7 = 0 AS sec FROM pt WHERE NOT contains(path, '/L2-4/')
   UNION ALL SELECT 'x/y/z', 'T77', false), tn AS (SELECT concat('T', lpad(cast(i AS string), 2, '0')) AS theme_id FROM generate_series(0, 35) t(i) UNION ALL SELECT 'T99'),
 a AS (SELECT (SELECT count(*) FROM pt) AS path_count, (SELECT count(*) FROM pt WHERE path NOT IN (SELECT path FROM tm)) AS missing, (SELECT count(*) FROM tm WHERE path NOT IN (SELECT path FROM pt)) AS invalid,
  (SELECT count(*) FROM tm WHERE theme_id NOT IN (SELECT theme_id FROM tn)) AS unknown_theme, (SELECT count(*) FROM tm WHERE sec) AS primary_also_secondary, 36 AS formal_themes, 1 AS fallback_present)
SELECT *, round((path_count - missing) / greatest(path_count, 1)::DOUBLE, 4) AS coverage, false AS ok FROM a""")
def _(spark, d):
    t = triples(spark, d)
    path = t.select(F.concat_ws("/", "l1", "l2", "l3").alias("path")).distinct()
    tid = F.concat(F.lit("T"), F.lpad((F.ascii(F.right("path", F.lit(1))) % 40).cast("string"), 2, "0"))
    tm = path.filter(~F.col("path").contains("/L2-4/")).withColumn("theme_id", tid).withColumn(
        "secondary", F.when(F.ascii(F.left("path", F.lit(1))) % 7 == 0, F.array("theme_id")).otherwise(F.array(F.lit("T00x"))))
    tm = tm.unionByName(spark.range(1).select(F.lit("x/y/z").alias("path"), F.lit("T77").alias("theme_id"), F.array(F.lit("T00x")).alias("secondary")))
    themes = spark.range(36).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("theme_id")).union(spark.range(1).select(F.lit("T99")))
    return tx.theme_map_validate(t, tm, themes)
