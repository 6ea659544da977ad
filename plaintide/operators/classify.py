"""Scoring, repair and routing of labels. Every rule set arrives as a pack."""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import any_case, any_of, bound, filled, squeeze, strip, text
from plaintide.functions.meta import is_json_object, json_get
from plaintide.operators import rules as R
from plaintide.operators.signals import decision
from plaintide.packs import labels as lp
from plaintide.schema import LOW_CONFIDENCE_BELOW


def priority_rules(body: Column, rules: Sequence[Mapping], low: Column | None = None) -> Column:
    """Triple of the first pattern rule that holds on the lower-cased text, which may be given."""
    return bound(F.lower(body) if low is None else low, lambda x: R.first_rule_lower(x, rules))


def l1_scores(df: DataFrame, body: str, pack: Mapping, low: Column | None = None) -> DataFrame:
    """Adds s_product, s_service, s_experience, s_none."""
    t, low = F.col(body), F.lower(F.col(body)) if low is None else low
    return df.withColumns({f"s_{k}": R.weighted_score(t, low, pack["scores"][k]) for k in ("product", "service", "experience", "none")})


def l1_decision() -> Column:
    """Non-issue only far above the rest; then product, service, experience by their floors.
    Fixed values: the thresholds."""
    p, s, e, n = (F.col(f"s_{k}") for k in ("product", "service", "experience", "none"))
    return (F.when((n >= 13.5) & (n > F.greatest(p, s, e) + 2.8), lp.NON_ISSUE)
            .when((p >= 4.5) & (p >= F.greatest(s, e) - 1), lp.PRODUCT)
            .when((s >= 7.0) & (s >= F.greatest(p, e)), lp.SERVICE)
            .when((e >= 6.0) & (e >= F.greatest(p, s)), lp.EXPERIENCE)
            .when(p >= F.greatest(s, e), lp.PRODUCT).otherwise(lp.SERVICE))


def l1_keyword_score(df: DataFrame, body: str, pack: Mapping, out: str = "scored_l1", low: Column | None = None) -> DataFrame:
    d = l1_scores(df, body, pack, low)
    return d.withColumn(out, F.when(F.col(body) == "", lp.SERVICE).otherwise(l1_decision()))


def l2_route(body: Column, l1: Column, pack: Mapping, low: Column | None = None) -> Column:
    """L2 by keyword groups of the class; a class may name a default."""
    low = F.lower(body) if low is None else low
    out = F.lit(None).cast("string")
    for cls, entries in pack["routes"].items():
        found = R.route(body, low, entries)
        default = pack.get("route_default", {}).get(cls)
        out = F.when(l1 == cls, F.coalesce(found, F.lit(default)) if default else found).otherwise(out)
    return out


def generic_fallback(body: Column, l1: Column, pack: Mapping) -> Column:
    """Per-symptom default of a class, as a triple."""
    out = R.no_triple()
    for e in reversed(pack["symptoms"]):
        hit = (l1 == e["when_l1"]) & R.has_word(body, e["words"])
        out = F.when(hit, R.triple(e["l1"], e["l2"], e["l3"], e["confidence"], "generic")).otherwise(out)
    return out


def weak_fallback(body: Column, l1: Column, pack: Mapping) -> Column:
    """Last resort of the rule path."""
    w = pack["weak"]
    exp = (l1 == lp.EXPERIENCE) | R.has_word(body, w["wish_words"])
    a, b = w["experience"], w["service"]
    return (F.when(exp, R.triple(lp.EXPERIENCE, a[0], a[1], a[2], "generic"))
            .when(l1 == lp.SERVICE, R.triple(lp.SERVICE, b[0], b[1], b[2], "generic_l3")))


def l2_whitelist_guard(df: DataFrame, whitelist: DataFrame, pack: Mapping, body: str = "original_text") -> DataFrame:
    """Repairs (l1, l2, confidence, needs_review) against the whitelist, then moves a praise label on
    a negative text, then captures plain praise and questions as non-issue.

    ``whitelist`` has l1 and ``options`` (array in order).
    """
    t = F.col(body)
    j = df.join(whitelist.select(F.col("l1").alias("_wl1"), "options"), F.col("l1") == F.col("_wl1"), "left").drop("_wl1")
    none = labels.canonical_or_blank("l1") == lp.NON_ISSUE
    skip = none | (text("l1") == "") | (text("l2") == "")
    bad = ~skip & (F.size(F.coalesce("options", F.array().cast("array<string>"))) > 0) & ~F.array_contains("options", F.col("l2"))
    j = j.withColumns({"_skip": skip, "l2_whitelist_reject": F.coalesce(bad, F.lit(False))})
    rej = F.col("l2_whitelist_reject")
    j = j.withColumns({"l2": F.when(F.col("_skip") & none, "").when(rej, F.get("options", F.lit(0))).otherwise(F.col("l2")),
                       "l1": F.when(none, lp.NON_ISSUE).otherwise(F.col("l1")),
                       "confidence": F.when(rej, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence")),
                       "needs_review": F.coalesce("needs_review", F.lit(False)) | rej}).drop("options")
    wrong = ~F.col("_skip") & (F.col("l2") == pack["consult_l2"]) & R.has(t, pack["negative"])
    moved = relocate(t, pack)
    j = j.withColumns({"l2_consult_guard": wrong, "_to": F.when(wrong, moved)})
    j = j.withColumns({"l1": F.coalesce("_to.l1", "l1"), "l2": F.coalesce("_to.l2", "l2"),
                       "confidence": F.when(F.col("l2_consult_guard"), F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence")),
                       "needs_review": F.col("needs_review") | F.col("l2_consult_guard")}).drop("_to")
    j = capture_code(j, body, pack)
    cap = ~F.col("_skip") & F.col("capture_ok")
    j = j.withColumn("positive_capture", cap)
    c = F.col("positive_capture")
    return j.withColumns({"l1": F.when(c, lp.NON_ISSUE).otherwise(F.col("l1")), "l2": F.when(c, "").otherwise(F.col("l2")),
                          "confidence": F.when(c, F.greatest("confidence", F.lit(0.85))).otherwise(F.col("confidence")),
                          "needs_review": F.col("needs_review") & ~c, "l2_consult_guard": F.col("l2_consult_guard") & ~c,
                          "l2_whitelist_reject": F.col("l2_whitelist_reject") & ~c}).drop("_skip", "capture", "capture_ok")


def relocate(t: Column, pack: Mapping) -> Column:
    """(l1, l2) for a text that was taken for praise, by the first keyword group it holds."""
    pair = lambda a, b: F.struct(F.lit(a).alias("l1"), F.lit(b).alias("l2"))
    d = pack["relocate_default"]
    return R.ordered_case([(R.has(t, p), pair(a, b)) for p, a, b in pack["relocate"]], pair(*d))


def rule_conflict(l1: Column, body: Column, conflicts: Sequence[Mapping], groups: Mapping[str, Sequence[str]]) -> Column:
    """Id of the first conflict rule whose class is the label and whose words occur; else empty."""
    return R.ordered_case([((l1 == c["when_l1"]) & R.has_word(body, list(dict.fromkeys(groups[c["keyword_group"]]))), c["id"])
                           for c in conflicts], "")


def capture_code(df: DataFrame, body: str, pack: Mapping) -> DataFrame:
    """Adds ``capture``: the first blocking reason, else the first eligible reason, else
    ``no_capture_pattern``; and ``capture_ok``, whether the text counts as plain praise or question.

    All patterns of the pack's decision list are looked for in one reading of the text (see ``operators.signals``).
    """
    d = df.withColumn("_cap", decision(pack["capture"])(strip(F.coalesce(F.col(body), F.lit("")))))
    return d.withColumns({"capture": F.col("_cap.code"), "capture_ok": F.col("_cap.eligible")}).drop("_cap")


def capture_summary(df: DataFrame, body: str, pack: Mapping) -> DataFrame:
    return capture_code(df, body, pack).groupBy("capture").agg(F.count(F.lit(1)).alias("n"))


def _domain_l2(t: Column, pack: Mapping) -> Column:
    """L2 that the domain wording asks for; empty when it leaves it open."""
    g = pack["domain_l2"]
    ask = R.has(t, g["inquiry"]) & ~R.has(t, g["supplier"]) & ~R.has(t, g["strong_fault"])
    return (F.when(R.has(t, g["vehicle_side"]), g["vehicle_l2"]).when(R.has(t, g["supplier"]), g["station_l2"]).when(ask, "")
            .when(R.has(t, g["station_fault"]) | R.has(t, g["station"]), g["station_l2"]).otherwise(""))


def guard_chain(df: DataFrame, pack: Mapping, body: str = "original_text", source: str = "source") -> DataFrame:
    """Ordered repair of (l1, l2) with one flag per stage; later stages drop flags of earlier ones.

    Patterns are evaluated once into flags of the text; the stages then work on booleans and two
    label columns, one projection per stage, so the plan stays shallow.
    """
    t = F.coalesce(F.col(body), F.lit(""))
    p = pack["guard"]
    sig = {f"_g_{k}": R.has(t, v) for k, v in p["signals"].items()}
    d = df.withColumns(sig).withColumn("_dom_l2", _domain_l2(t, pack))
    d = capture_code(d, body, pack).withColumnRenamed("capture_ok", "_eligible")
    g = lambda k: F.col(f"_g_{k}")
    d = d.withColumns({"_service_l2": R.ordered_case([(R.has(t, x), y) for x, y in p["service_l2"]], p["service_l2_default"]),
                       "_product_l2": F.coalesce(F.nullif("_dom_l2", F.lit("")), R.ordered_case([(R.has(t, x), y) for x, y in p["product_l2"]], p["product_l2_default"])),
                       "_rel": relocate(t, pack)})
    l2_of = lambda c: F.when(c == lp.PRODUCT, F.col("_product_l2")).when(c == lp.SERVICE, F.col("_service_l2")).otherwise(p["experience_l2_default"])
    d = d.withColumns({"l1": labels.canonicalize_l1("l1"), "l2": text("l2")})

    # 1. A non-issue label on a text with issue words.
    cond = (F.col("l1") == lp.NON_ISSUE) & g("issue") & ~g("exempt")
    tilt = (F.when(g("product_tilt") & g("fault"), lp.PRODUCT).when(g("experience_tilt") & ~g("fault"), lp.EXPERIENCE)
            .when(g("service_tilt") & ~g("product_tilt"), lp.SERVICE).when(g("product_tilt"), lp.PRODUCT)
            .when(g("wish") & ~g("fault"), lp.EXPERIENCE).otherwise(lp.PRODUCT))
    d = _stage(d, "f_non_issue_guard", cond, tilt, l2_of)
    # 2. A praise label on a negative text.
    d = d.withColumn("f_consult_misclass", (F.col("l2") == pack["consult_l2"]) & g("negative"))
    d = d.withColumns({"l1": F.when(F.col("f_consult_misclass"), F.col("_rel.l1")).otherwise(F.col("l1")),
                       "l2": F.when(F.col("f_consult_misclass"), F.col("_rel.l2")).otherwise(F.col("l2"))})
    # 3. A complaint inside the special domain cannot be a non-issue.
    d = _stage(d, "f_domain_guard", (F.col("l1") == lp.NON_ISSUE) & g("domain") & g("domain_complaint"), F.lit(lp.PRODUCT), l2_of)
    # 4. A service-quality complaint cannot be a non-issue.
    d = _stage(d, "f_service_guard", (F.col("l1") == lp.NON_ISSUE) & g("service_issue"), F.lit(lp.SERVICE), l2_of)
    # 5. Balance between the business classes by the tilt of the text.
    l1, prod, srv, exp, fault = F.col("l1"), g("product_tilt"), g("service_tilt"), g("experience_tilt"), g("fault")
    target = (F.when((l1 == lp.SERVICE) & prod & fault & ~srv, lp.PRODUCT)
              .when((l1 == lp.PRODUCT) & srv & (~prod | (~fault & g("service_word"))), lp.SERVICE)
              .when((l1 == lp.EXPERIENCE) & prod & fault, lp.PRODUCT)
              .when((l1 == lp.EXPERIENCE) & srv & ~prod & ~fault & ~exp, lp.SERVICE)
              .when((l1 == lp.PRODUCT) & exp & ~fault & ~srv, lp.EXPERIENCE))
    d = d.withColumn("_target", target)
    d = _stage(d, "f_rebalance", F.col("_target").isNotNull(), F.col("_target"), l2_of)
    later = F.col("f_domain_guard") | F.col("f_service_guard") | F.col("f_rebalance")
    d = d.withColumn("f_consult_misclass", F.col("f_consult_misclass") & ~later)
    # 6. Plain praise and questions are non-issue, unless the domain stage has just ruled otherwise.
    ask_domain = g("domain") & g("domain_consult")
    keep_domain = (F.col("l1") == lp.PRODUCT) & (F.col("l2") == pack["domain_l2"]["station_l2"]) & g("station_inquiry")
    cap = F.col("_eligible") & ~(F.col("f_domain_guard") & ask_domain) & ~keep_domain & ~((F.col("l1") == lp.NON_ISSUE) & (F.col("l2") == ""))
    d = d.withColumn("f_captured", F.coalesce(cap, F.lit(False)))
    c = F.col("f_captured")
    d = d.withColumns({"l1": F.when(c, lp.NON_ISSUE).otherwise(F.col("l1")), "l2": F.when(c, "").otherwise(F.col("l2")),
                       **{f: F.col(f) & ~c for f in ("f_consult_misclass", "f_domain_guard", "f_service_guard")}})
    # 7. Coordination, assistance and story texts are non-issue, with label exceptions.
    app = any_case(F.coalesce(F.col(source), F.lit("")), p["story_source"]) & g("story") & ~g("demand")
    opt = lambda k: g(k) if k in p["signals"] else F.lit(False)  # noqa: E731  signals that a pack may leave out
    coordination = g("coordination") & ~g("coordination_block") & ~(opt("coordination_place") & opt("coordination_push"))
    assist = (opt("aftersales") & ~opt("aftersales_block")) | ((opt("roadside") | opt("maintenance")) & ~opt("roadside_block"))
    ctx = ~g("context_block") & (coordination | assist | (g("assist") & g("assist_intent") & ~g("explicit_issue")) | app)
    guarded = any_of([(F.col("l1") == a) & F.col("l2").isin(*b) for a, b in p["context_keep"].items()]
                     + [(F.col("l1") == a) & (F.col("l2") != "" if b is None else F.col("l2").isin(*b)) & g(k) for a, b, k in p.get("context_keep_if", ())])
    same = (F.col("l1") == lp.PRODUCT) & (F.col("_dom_l2") != "") & (F.col("_dom_l2") == F.col("l2"))
    d = d.withColumn("f_context", F.coalesce(ctx & ~guarded & ~same, F.lit(False)))
    x = F.col("f_context")
    d = d.withColumns({"l1": F.when(x, lp.NON_ISSUE).otherwise(F.col("l1")), "l2": F.when(x, "").otherwise(F.col("l2")),
                       **{f: F.col(f) & ~x for f in ("f_domain_guard", "f_service_guard", "f_rebalance")}})
    # 8. The domain's own L2 boundary, unless the present L2 is protected.
    veh, sta = pack["domain_l2"]["vehicle_l2"], pack["domain_l2"]["station_l2"]
    skip = (((F.col("l2") == veh) & (F.col("_dom_l2") == sta) & (g("vehicle_dominant") | g("station_inquiry")))
            | ((F.col("l2") == sta) & (F.col("_dom_l2") == veh) & (g("station") | g("supplier"))))
    flip = (F.col("l1") == lp.PRODUCT) & (F.col("_dom_l2") != "") & (F.col("_dom_l2") != F.col("l2")) & ~skip
    d = d.withColumn("f_domain_l2", F.coalesce(flip, F.lit(False)))
    d = d.withColumn("l2", F.when(F.col("f_domain_l2"), F.col("_dom_l2")).when(F.col("l1") == lp.NON_ISSUE, "").otherwise(F.col("l2")))
    return d.drop(*[c for c in d.columns if c.startswith("_") and c not in df.columns], "capture")


def _stage(d: DataFrame, flag: str, cond: Column, l1: Column, l2_of) -> DataFrame:
    d = d.withColumn(flag, F.coalesce(cond, F.lit(False)))
    d = d.withColumn("l1", F.when(F.col(flag), l1).otherwise(F.col("l1")))
    return d.withColumn("l2", F.when(F.col(flag), l2_of(F.col("l1"))).otherwise(F.col("l2")))


def flag_confidence(c: Column) -> Column:
    """Floors and ceilings by flag, in order. Fixed values."""
    for flag, fn, v in (("f_non_issue_guard", F.greatest, 0.82), ("f_consult_misclass", F.least, 0.45), ("f_domain_guard", F.greatest, 0.84),
                        ("f_service_guard", F.greatest, 0.83), ("f_captured", F.greatest, 0.86)):
        c = F.when(F.col(flag), fn(c, F.lit(v))).otherwise(c)
    return c


def review_routing(status: Column, forced: Column, confidence: Column, threshold: float = LOW_CONFIDENCE_BELOW) -> Column:
    """Reviewed stays reviewed; forced or weak rows wait for review; the rest is done."""
    return F.when(status == 1, 1).when(forced | (confidence < threshold), 2).otherwise(0)


def weighted_keyword_classify(df: DataFrame, pack: Mapping, body: str = "original_text") -> DataFrame:
    """Non-issue words first, then a facility with a trouble word, then class weights.
    Adds kw_class (NULL if nothing hits), kw_confidence."""
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    d = df.withColumn("_low", low)
    low = F.col("_low")
    d = d.withColumns({f"_s{i}": R.word_count(low, [w.lower() for w in words]) * weight for i, (cls, weight, words) in enumerate(pack["weights"])})
    opts = [F.struct(F.col(f"_s{i}").alias("s"), F.lit(-i).alias("p"), F.lit(cls).alias("c")) for i, (cls, _, _) in enumerate(pack["weights"])]
    d = d.withColumn("_ranked", F.reverse(F.array_sort(F.filter(F.array(*opts), lambda x: x["s"] > 0))))
    none = R.has_word(low, pack["non_issue"]) & ~R.has_word(low, pack["non_issue_negations"])
    forced = R.has_word(low, pack["facilities"]) & R.has_word(low, pack["triggers"])
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    conf = F.when(second.isNull(), 0.9).otherwise(F.least(F.lit(1.0), F.lit(0.7) + (best["s"] - second["s"]) * 0.05))
    return d.withColumns({
        "kw_class": F.when(none, lp.NON_ISSUE).when(forced, pack["weights"][0][0]).otherwise(best["c"]),
        "kw_confidence": F.when(none | forced, 1.0).when(best.isNull(), 0.0).otherwise(F.round(conf, 2)),
    }).drop("_low", "_ranked", *[f"_s{i}" for i in range(len(pack["weights"]))])


def force_consult(body: Column, blockers: Sequence[str], benign: Sequence[str], praise: Sequence[str], query: Sequence[str]) -> Column:
    """No blocking word, and a short benign text or any praise or query word."""
    low = F.lower(F.coalesce(body, F.lit("")))
    n = F.length(squeeze(low))
    return ~R.has_word(low, [b.lower() for b in blockers]) & (
        (n.between(1, 15) & R.has_word(squeeze(low), benign)) | R.has_word(low, [p.lower() for p in praise]) | R.has_word(low, [x.lower() for x in query]))


def boundary_relabel(df: DataFrame, label: str, pack: Mapping, body: str = "original_text") -> DataFrame:
    """Rows whose label the boundary words contradict, with the new label and the reason."""
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    d = df.withColumns({f"has_{k}": R.has_word(low, pack["boundary_words"][k]) for k in ("fault", "non_issue", "suggest", "service")})
    b = pack["boundary"]
    pairs = [(F.col(f"has_{k}"), F.struct(F.lit(cls).alias("label"), F.lit(why).alias("reason"))) for k, cls, why in b]
    d = d.withColumn("_fix", R.ordered_case(pairs, F.struct(F.col(label).alias("label"), F.lit("").alias("reason"))))
    return d.filter(F.col("_fix.label") != F.col(label)).withColumns(
        {"corrected_label": F.col("_fix.label"), "reason": F.col("_fix.reason")}).drop("_fix")


def mixed_expression_rows(df: DataFrame, label: str, pack: Mapping, body: str = "original_text") -> DataFrame:
    """Rows whose label meets another class's keywords, with the type of the mix."""
    t = F.coalesce(F.col(body), F.lit(""))
    kind = R.ordered_case([((F.col(label) == cls) & R.has_word(t, words), name) for cls, words, name in pack["mixed"]], F.lit(None).cast("string"))
    return df.withColumn("mix_type", kind).filter(F.col("mix_type").isNotNull())


def output_keyword_vote(answer: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Class whose words occur most often in a free answer, class order on a tie; NULL if none."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    opts = [F.struct(R.word_count(low, words).alias("n"), F.lit(-i).alias("p"), F.lit(cls).alias("c")) for i, (cls, words) in enumerate(groups)]
    best = F.array_max(F.array(*opts))
    return F.when(best["n"] > 0, best["c"])


def tag_map_lookup(df: DataFrame, tag_map: DataFrame, tags: Sequence[str] = ("tag3", "tag2", "tag1")) -> DataFrame:
    """Class of the most specific tag found in the map; NULL if none."""
    d = df
    for i, c in enumerate(tags):
        side = tag_map.select(F.col("tag").alias(f"_k{i}"), F.col("class").alias(f"_c{i}"))
        d = d.join(side, strip(c) == F.col(f"_k{i}"), "left")
    return d.withColumn("mapped", F.coalesce(*[f"_c{i}" for i in range(len(tags))])).drop(*[f"_{x}{i}" for i in range(len(tags)) for x in "kc"])


def learn_tags(tag_map: DataFrame, corrections: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The map with tags learnt from corrections: the most specific tag given, if it is unknown.
    The earliest correction of a tag decides. Corrections carry tag1..tag3, class and seq."""
    key = F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in ("tag3", "tag2", "tag1")])
    new = (corrections.filter(F.col("class").isin(*classes)).withColumn("tag", key).filter(F.col("tag").isNotNull())
           .groupBy("tag").agg(F.min_by("class", "seq").alias("class")))
    return tag_map.select("tag", "class").unionByName(new.join(tag_map.select("tag"), "tag", "left_anti"))


def feed_cascade(df: DataFrame, tag_map: DataFrame, pack: Mapping, model: str = "model_class", body: str = "original_text",
                 classes: Sequence[str] = lp.LEGACY_CLASSES) -> DataFrame:
    """Tag map (1.0), weighted keywords, then the given model class; says how, and whether the row
    counts as reviewed."""
    d = weighted_keyword_classify(tag_map_lookup(df, tag_map), pack, body)
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    core = [w.lower() for _, _, words in pack["weights"] for w in words[:20]] + [w.lower() for w in pack["non_issue"][:20]]
    m = F.col("mapped").isin(*classes) & F.col("mapped").isNotNull()
    k, v = F.col("kw_class").isNotNull(), filled(model)
    out = lambda a, b, c, e: F.when(m, a).when(k, b).when(v, c).otherwise(e)
    d = d.withColumns({"result": out(F.col("mapped"), F.col("kw_class"), F.col(model), F.lit("")),
                       "confidence": out(F.lit(1.0), F.col("kw_confidence"), F.when(R.has_word(low, core), 0.95).otherwise(0.85), F.lit(0.0)),
                       "way": out(F.lit("tag_map"), F.lit("keywords"), F.lit("model"), F.lit("failed"))})
    return d.withColumn("auto_reviewed", F.col("confidence") >= 0.9).drop("mapped", "kw_class", "kw_confidence")


def model_response_parse(df: DataFrame, answer: str, whitelist: DataFrame) -> DataFrame:
    """Outermost JSON object of a model answer, checked: L1 must canonicalise, L2 must be allowed
    for it. Adds status, l1, l2, risk_level, confidence, keywords."""
    d = df.withColumn("_o", F.regexp_extract(F.coalesce(F.col(answer), F.lit("")), r"(?s)\{.*\}", 0))
    pick = lambda *ks: F.coalesce(*[F.nullif(text(json_get("_o", k)), F.lit("")) for k in ks], F.lit(""))
    ok = is_json_object("_o")
    d = d.withColumns({"_ok": ok, "_l1": labels.try_canonicalize_l1(pick("l1", "一级标签")), "_l2": pick("l2", "二级标签"),
                       "_risk": pick("风险等级", "risk_level"), "_kw": pick("问题关键词", "keywords"),
                       "_conf": json_get("_o", "confidence").try_cast("double")})
    d = d.join(whitelist.select(F.col("l1").alias("_wl1"), "options"), F.col("_l1") == F.col("_wl1"), "left")
    none = F.col("_l1") == lp.NON_ISSUE
    fine = none | F.coalesce(F.array_contains("options", F.col("_l2")), F.lit(False))
    status = (F.when(~F.coalesce(F.col("_ok"), F.lit(False)), "parse_failed")
              .when(F.col("_l1").isNull() | ~fine, "whitelist_reject").otherwise("ok"))
    d = d.withColumn("status", status)
    good = F.col("status") == "ok"
    listed = F.from_json(F.when(F.col("_kw").startswith("["), F.col("_kw")), "array<string>")
    kws = F.slice(F.filter(F.transform(F.coalesce(listed, F.split("_kw", ",")), strip), lambda x: x != ""), 1, 12)
    return d.withColumns({
        "l1": F.when(good, F.col("_l1")).otherwise(""), "l2": F.when(good & ~none, F.col("_l2")).otherwise(""),
        "risk_level": F.when(good & F.col("_risk").isin("高", "中", "低"), F.col("_risk")).otherwise("低"),
        "confidence": F.when(good, F.coalesce(F.nullif("_conf", F.lit(0.0)), F.lit(0.75))).otherwise(0.0),
        "keywords": F.when(good, kws).otherwise(F.array().cast("array<string>")),
    }).drop("_o", "_ok", "_l1", "_l2", "_risk", "_kw", "_conf", "_wl1", "options")
