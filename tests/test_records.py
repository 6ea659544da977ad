"""Planted rows: small cases with known answers."""
import datetime as dt

from pyspark.sql import functions as F

from plaintide.functions import dates, labels, meta, text as tx
from plaintide.functions.insight import with_insight_fields
from plaintide.operators import classify as C, evaluate as ev, filters, insight as ins, match as M, report, review, rules as R, trainset as ts
from plaintide.packs import default_rules, labels as lp, prose
from plaintide.packs.default_rules import PACK, TAXONOMY


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_class_names(spark):
    cases = {"质量 问题": lp.PRODUCT, "　体验": lp.EXPERIENCE, "我的产品 质量": lp.PRODUCT, "价格咨询": lp.NON_ISSUE, "营销和服务": lp.SERVICE, "售后": lp.SERVICE, "??": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", labels.try_canonicalize_l1("v").alias("c")).collect()
    assert {r["v"]: r["c"] for r in rows} == cases
    assert one(spark, "??", labels.canonicalize_l1) == lp.SERVICE
    assert one(spark, " ", labels.canonical_or_blank) == ""
    assert "质量问题" in labels.l1_filter_variants("产品质量")


def test_broken_json_is_null(spark):
    docs = ['{"l1": "a"', '{"l1": "a"} x', '[{"l1": "a"}]', "", None, '{"l1": true}', '{"l1": {"x": 1}}', '{"l1": null}', "5"]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in docs], "v string").select(meta.json_get("v", "l1").alias("r")).collect()]
    assert got == [None, None, None, None, None, "true", '{"x":1}', None, None]
    assert one(spark, '{"a": {"b": 1}}', lambda c: meta.json_get(c, "a.b")) is None


def test_dates_disagree_on_purpose(spark):
    f = lambda fn: lambda v: one(spark, v, fn)
    assert str(f(dates.parse_time)("2026/1/27 8:14")) == "2026-01-27 08:14:00"
    assert str(f(dates.parse_time)("2026-01-27T08:14:00")) == "2026-01-27 00:00:00"
    assert str(f(dates.parse_time)("2026-01")) == "2026-01-01 00:00:00"
    assert f(dates.parse_time)("2026-13-40") is None
    assert f(dates.report_event_day)("2026.01.27 10:00") == "2026-01-27"
    assert f(dates.report_event_day)("2026-01") == "2026-01-01"
    assert f(dates.stats_day)("2026/3/7") == "2026-03-07"
    assert f(dates.stats_day)("20260307") == "2026-03-07"
    assert f(dates.iso_day)("2026/3/7") is None


def test_text_helpers(spark):
    assert one(spark, "a　b \n c", tx.gold_key) == one(spark, "a b c", tx.gold_key)
    assert one(spark, "a　b", tx.dedupe_key) == one(spark, "ab", tx.dedupe_key)
    assert one(spark, "13812345678 and LJUAB12C3DE456789", tx.scrub) == "138****0000 and VIN****"
    assert one(spark, "ELETRE/emira", tx.model_name) == "Eletre"
    assert one(spark, "a; emeya", tx.model_name) == "EMEYA"
    assert one(spark, "VIN: LJUAB12C3DE456789 x", tx.extract_vin) == "LJUAB12C3DE456789"
    assert one(spark, "我 这车 abc 12", tx.keyword_tokens) == ["这车", "abc"]


def test_insight_order(spark):
    rows = [("投诉并感谢", "投诉升级"), ("感谢师傅", "表扬"), ("感谢，但是黑屏", "报障"), ("请问怎么用", "咨询"), ("建议优化", "建议"), ("随便", "报障")]
    df = spark.createDataFrame([(t, lp.PRODUCT, "", "", want) for t, want in rows], "original_text string, l1 string, l2 string, l3 string, want string")
    for r in with_insight_fields(df).collect():
        assert r["intent"] == r["want"], r["original_text"]


def test_patterns_fold_all_alphabets(spark):
    """Case folds beyond ASCII, but no dotted or dotless i is an i, and a vertical tab is no blank."""
    rules = {**prose.INSIGHT, "fault": "eauré.x", "severe": "ins", "repeat": r"an\s+en"}
    rows = [("EAURÉ\rX", "报障", "中", False), ("eauré\nx", "告知", "低", False), ("İnS ıns", "告知", "低", False), ("INſ", "告知", "高", False),
            ("AN EN", "告知", "低", True), ("an\x0ben", "告知", "低", False)]
    df = spark.createDataFrame([(t, lp.SERVICE, "", "") for t, *_ in rows], "original_text string, l1 string, l2 string, l3 string")
    got = {r["original_text"]: (r["intent"], r["severity"], r["repeat_signal"]) for r in with_insight_fields(df, rules=rules).collect()}
    assert got == {t: tuple(want) for t, *want in rows}


def test_batch_fields_fold_all_alphabets(spark):
    df = spark.createDataFrame([(1, "EAURÉ", 0)], "id long, original_text string, review_status int").withColumn("opinion_id", F.col("id").cast("string"))
    out = M.batch_classify(df, PACK, *default_dims(spark), insight_rules=prose.INSIGHT).first()
    assert out["intent"] == "报障" and '"intent":"报障"' in out["v3_label_meta"]


def test_vehicle_ids_end_at_ascii_words(spark):
    vin = "ABCDEFGHJKLMNPRST"
    assert one(spark, f"é{vin}é", tx.extract_vin) == vin and one(spark, f"x{vin}", tx.extract_vin) == ""
    assert one(spark, f"vın {vin.lower()}x", tx.extract_vin) == "" and one(spark, f"vIn\n：{vin.lower()}x", tx.extract_vin) == vin
    assert one(spark, "MODEL: a b\t\xa0。", tx.extract_model) == "a b\t"


def test_default_rules(spark):
    cases = {"车机经常黑屏死机": "座舱问题", "充电站地锁打不开": "LFC问题", "很好": "咨询与表扬", "销售顾问不错 就是提车延期": "销售服务问题", "感谢感谢": "咨询与表扬"}
    df = spark.createDataFrame([(k,) for k in cases], "original_text string")
    got = {r["original_text"]: r["h"]["l2"] for r in df.select("original_text", C.priority_rules(F.col("original_text"), PACK["priority"]).alias("h")).collect()}
    assert got == cases


def default_dims(spark):
    tax = spark.createDataFrame([(*r, i) for i, r in enumerate(TAXONOMY)], "l1 string, l2 string, l3 string, freq int, pos int")
    clu = spark.createDataFrame([], "l1 string, l2 string, canonical string, count int, keywords array<string>, synonyms array<string>, pos int")
    wl = tax.groupBy("l1", "l2").agg(F.min("pos").alias("pos"))
    return tax, clu, wl


def test_default_pack_end_to_end(spark):
    rows = [(1, "车机黑屏，多次投诉没有处理", 0), (2, "感谢门店小李", 0), (3, "", 0), (4, "闪充站坏了", 1), (5, "希望座椅功能能再多一些", 0), (6, "希望增加座椅功能", 0)]
    df = spark.createDataFrame(rows, "id long, original_text string, review_status int").withColumn("opinion_id", F.col("id").cast("string"))
    out = {r["id"]: r for r in M.batch_classify(df, PACK, *default_dims(spark)).collect()}
    assert out[1]["v3_l1"] == lp.PRODUCT and out[1]["v3_l2"] == "座舱问题"
    assert out[3]["v3_l1"] == "" and out[3]["v3_match_type"] == "none"
    assert out[4]["review_status"] == 1 and out[4]["v3_l2"] == "LFC问题"
    assert out[5]["v3_l1"] == lp.EXPERIENCE and out[6]["v3_l1"] == lp.NON_ISSUE  # a soft wish for more is captured
    assert all(meta_ok(r["v3_label_meta"]) for r in out.values())


def meta_ok(doc):
    import json
    return {"l1", "l2", "intent", "severity"} <= set(json.loads(doc))


def test_default_guard_chain(spark):
    rows = [("1", "车机黑屏了，要求处理", lp.NON_ISSUE, ""), ("2", "爆胎需要道路救援，请协助安排", lp.SERVICE, "售后服务问题"), ("3", "感谢销售顾问热情接待", lp.SERVICE, "销售服务问题")]
    df = spark.createDataFrame(rows, "opinion_id string, original_text string, l1 string, l2 string").withColumn("source", F.lit("tel"))
    got = {r["opinion_id"]: r for r in C.guard_chain(df, PACK).collect()}
    assert got["1"]["l1"] == lp.PRODUCT and got["1"]["f_non_issue_guard"] and got["1"]["l2"] == "座舱问题"
    assert got["2"]["l1"] == lp.NON_ISSUE and got["2"]["f_context"]
    assert got["3"]["l1"] == lp.NON_ISSUE and got["3"]["f_captured"] and got["3"]["l2"] == ""


def test_default_context_tables(spark):
    """Whole context tables: help on the road and appointments are non-issue, unless something is still open."""
    rows = [("roadside", "车辆扎钉了", "", 1), ("roadside_block", "车辆扎钉了，为什么还没来", "", 0), ("maintenance", "预约一下周末的保养", "", 1),
            ("aftersales", "售后那边帮忙对接一下", "", 1), ("aftersales_block", "售后那边帮忙对接一下，没人接听", "", 0), ("coordination", "需要门店清洗", "", 1),
            ("coordination_place", "充电站什么时候能否用", "", 0), ("context_block", "预约保养，安排取车", "", 0), ("pickup", "预约保养，上门取车", "售后服务问题", 0),
            ("release_words", "需要联系，OTA", "别的", 0)]
    l1 = {"pickup": lp.SERVICE, "release_words": lp.EXPERIENCE}
    df = spark.createDataFrame([(k, t, l1.get(k, lp.PRODUCT), l2) for k, t, l2, _ in rows], "opinion_id string, original_text string, l1 string, l2 string")
    got = {r["opinion_id"]: r for r in C.guard_chain(df.withColumn("source", F.lit("tel")), PACK | {"capture": PACK["capture"] | {"eligible": []}}).collect()}
    assert {k: int(got[k]["f_context"]) for k, _, _, _ in rows} == {k: want for k, _, _, want in rows}


def test_sequence_needs_order(spark):
    r = [{"parts": ("ab", "cd"), "l1": "x", "l2": "", "l3": "", "confidence": 0.5}]
    df = spark.createDataFrame([("ab..cd",), ("cd..ab",)], "t string").select(R.first_rule(F.col("t"), r)["l1"].alias("h"))
    assert [x["h"] for x in df.collect()] == ["x", None]


def test_evidence_counts_a_repeat_once(spark):
    rows = [(1, "A", True), (2, "A", True), (3, "B", False), (4, "", False), (5, "", False)]
    df = spark.createDataFrame(rows, "id long, opinion_id string, reviewed boolean").withColumns(
        {"theme_id": F.lit("T1"), "theme_name": F.lit("n"), "l1": F.lit("a"), "l2": F.lit("b"), "l3": F.lit("c"), "path": F.lit("a/b/c"), "original_text": F.col("opinion_id")})
    c = ins.evidence_chain(df).first()
    assert (c["count"], c["reviewed_count"], c["model_only_count"], c["opinion_ids"], c["reconcile_ok"]) == (4, 1, 3, 2, False)


def test_repeat_rate_half(spark):
    rows = [(1, "V1", "2026-01-01"), (2, "V1", "2026-01-06"), (3, "V2", "2026-01-03"), (4, "V3", None), (5, "V3", None)]
    df = spark.createDataFrame(rows, "id long, vin string, d string").select("id", "vin", F.to_timestamp("d").alias("event_ts"), F.lit(0).alias("reflow_synced"))
    r = ins.recurrence(df.filter("vin <> 'V3'")).first()
    assert (r["repeat_rate"], r["mean_days_to_repeat"], r["eligible_entities"]) == (0.5, 5.0, 2)
    assert ins.recurrence(df).first()["repeat_entities"] == 2


def test_anomaly_window(spark):
    rows = [("电池", "2026-01-30", 12), ("电池", "2026-01-20", 4), ("座椅", "2026-01-02", 8)]
    df = spark.createDataFrame([(l2, d) for l2, d, n in rows for _ in range(n)], "review_l2 string, reviewed_at string").withColumns(
        {"review_status": F.lit(1), "create_time": F.col("reviewed_at"), "v3_label_meta": F.lit('{"l3_phrases": ["续航差", "x"]}')})
    got = report.l2_anomalies(df, dt.date(2026, 1, 31)).collect()
    assert [(r["l2"], r["current"], r["avg_4p"], r["pct_change"], r["phrases"]) for r in got] == [("电池", 12, 1.0, 1100.0, "续航差:12")]


def test_lifecycle_states(spark):
    series = {"new": (4, 0, 0, 0, 0), "worse": (9, 3, 2, 2, 2), "flat": (5, 5, 5, 5, 5), "down": (1, 4, 6, 6, 6), "back": (6, 0, 6, 6, 6)}
    rows, i = [], 0
    for name, counts in series.items():
        for k, n in enumerate(counts):
            for _ in range(n):
                i += 1
                rows.append((i, name, dt.datetime(2026, 3, 31) - dt.timedelta(days=7 * k)))
    df = spark.createDataFrame(rows, "id long, l3 string, event_ts timestamp").withColumns({"l2": F.lit("x"), "severity": F.lit("中")})
    got = {r["l3"]: r["trend_state"] for r in ins.fault_lifecycle(df).collect()}
    assert got == {"new": "新发", "worse": "恶化", "flat": "高位平台", "down": "收敛", "back": "复发"}


def test_confirm_refuses_blocked_batch(spark):
    rows = [(1, "a", lp.PRODUCT, "x", "B"), (2, "b", "", "", "B"), (3, "c", lp.PRODUCT, "x", "C")]
    df = spark.createDataFrame(rows, "id long, opinion_id string, model_class string, model_keyword string, upload_batch string").withColumns(
        {"review_status": F.lit(0), "review_l1": F.lit(""), "review_l2": F.lit(""), "review_l3": F.lit(""), "v3_label_meta": F.lit(""), "reflow_synced": F.lit(0), "original_text": F.lit("t")})
    assert review.confirm_batch(df, "B", "r", "s").filter("applied").count() == 0
    got = review.confirm_batch(df, "C", "r", "s").filter("applied").first()
    assert (got["opinion_id"], got["review_l1"], got["review_l2"], got["review_status"]) == ("c", lp.PRODUCT, "x", 1)
    assert review.readiness(df.filter("upload_batch = 'C'")).first()["state"] == "confirmable"


def test_holdout_is_disjoint_and_stable(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("opinion_id"))
    a = ts.holdout_split(df, seed=1)
    b = ts.holdout_split(df.repartition(7), seed=1)
    h = lambda d: {r["opinion_id"] for r in d.filter("split = 'holdout'").collect()}
    assert len(h(a)) == 10 and h(a) == h(b)
    assert ts.holdout_split(df.limit(1)).filter("split = 'holdout'").count() == 0


def test_global_rank_is_exact(spark):
    from plaintide.functions.common import global_rank, rank_within
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = global_rank(df, [F.desc("id")]).collect()
    assert all(r["rank"] == 1000 - r["id"] for r in got)
    w = rank_within(df, "g", [F.col("id")]).collect()
    assert all(r["rn"] == r["id"] // 3 + 1 for r in w)


def test_empty_tables(spark):
    cols = "id long, opinion_id string, review_status int, review_l1 string, review_l2 string, v3_l1 string, v3_l2 string, v3_label_meta string, model_class string, model_keyword string, create_time string, reviewed_at string, reflow_synced int"
    e = spark.createDataFrame([], cols)
    assert report.kpi_snapshot(e, dt.date(2024, 1, 1)).first()["total"] == 0
    assert ev.accuracy_report(e).first()["l1_accuracy"] is None
    assert report.daily_accuracy_trend(e, dt.date(2024, 1, 1), 7).count() == 7
    assert filters.split_windows(e.withColumn("event_ts", F.lit(None).cast("timestamp")), 7).count() == 0


def test_sql_functions(spark):
    from plaintide.sqlfunctions import register
    register(spark)
    r = spark.sql("""select canonical_l1('质量 问题') a, canonical_l1('价格咨询') b, canonical_l1('??') c, voc_json_extract('{"l1": 1}', '$.l1') d,
                     voc_json_extract('{"l1": {"x": 1}}', '$.l1.x') e, text_fingerprint('a b') = text_fingerprint('ab') f""").first()
    assert tuple(r) == (lp.PRODUCT, lp.NON_ISSUE, lp.SERVICE, "1", None, True)


def test_taxonomy_documents_are_read_level_by_level(spark):
    from plaintide.operators import taxonomy as tx
    docs = [('{"_note": 1, "A": {"_x": 2, "a": {"标签列表": ["q\'s", "r"], "频次": 9, "详情": {"q\'s": 7}}, "b": {"频次": 1}}, "B": {"c": {"标签列表": ["s"]}}}',), ("not json",), (None,)]
    got = sorted(tuple(r) for r in tx.taxonomy_scan(spark.createDataFrame(docs, "doc string")).collect())
    assert got == [("A", "a", "q's", 7, 0), ("A", "a", "r", 1, 1), ("B", "c", "s", 1, 0)]
    triples = spark.createDataFrame([("A", "a", f"l{i:03d}", 100 - i % 7) for i in range(25)] + [("B", "b", "x", 1)], "l1 string, l2 string, l3 string, freq int")
    parts = tx.taxonomy_json(triples, 10)
    assert parts.count() == 4
    rows = tx.taxonomy_scan(parts).collect()
    order = sorted([(r["l3"], r["freq"]) for r in triples.collect() if r["l1"] == "A"], key=lambda x: (-x[1], x[0]))
    assert [(r["l3"], r["freq"]) for r in sorted(rows, key=lambda r: r["pos"]) if r["l1"] == "A"] == order
