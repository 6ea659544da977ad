"""Accuracy, error slices, rule replay, comparison runs and review priorities."""
from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import any_case, collapse, count_when, filled, global_rank, pct, share, strip, text
from plaintide.functions.dates import event_time
from plaintide.functions.meta import json_map, materialized
from plaintide.operators.keyed import pick_per_key
from plaintide.packs import audit as ap, labels as lp


def _business(c: Column) -> Column:
    return c.isin(*lp.BUSINESS_L1)


def paired(df: DataFrame) -> DataFrame:
    """Reviewed rows with canonical labels of both sides: human_l1/l2, model_l1/l2 (may be empty)."""
    m1, m2 = labels.model_labels()
    return df.filter(labels.is_reviewed()).withColumns({
        "human_l1": labels.canonical_or_blank("review_l1"), "human_l2": collapse(text("review_l2")),
        "model_l1": labels.canonical_or_blank(m1), "model_l2": collapse(m2)})



def _c(name: str) -> Column:
    return F.col(name)


def _judged() -> Column:
    return (_c("human_l1") != "") & (_c("model_l1") != "")


def _l2_open() -> Column:
    return _judged() & _business(_c("human_l1")) & (_c("human_l1") == _c("model_l1"))


def _accuracy_aggs() -> list[Column]:
    l2 = _l2_open() & (_c("human_l2") != "")
    return [
        F.count(F.lit(1)).alias("total_reviewed"), count_when(_judged()).alias("l1_denominator"),
        count_when(_judged() & (_c("human_l1") == _c("model_l1"))).alias("l1_correct"),
        count_when(l2).alias("l2_denominator"), count_when(l2 & (_c("human_l2") == _c("model_l2"))).alias("l2_correct"),
        count_when(_c("human_l1") == "").alias("skipped_no_human_l1"),
        count_when((_c("human_l1") != "") & (_c("model_l1") == "")).alias("skipped_no_model_l1"),
        count_when(_judged() & ~_l2_open()).alias("skipped_l2_nonissue_or_mismatch"),
        count_when(_l2_open() & (_c("human_l2") == "")).alias("skipped_l2_no_human_l2")]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"l1_accuracy": share(F.col("l1_correct"), F.col("l1_denominator")),
                           "l2_accuracy": share(F.col("l2_correct"), F.col("l2_denominator"))})


def accuracy_report(df: DataFrame) -> DataFrame:
    return _with_rates(paired(df).agg(*_accuracy_aggs()))


def accuracy_by_batch(df: DataFrame) -> DataFrame:
    return _with_rates(paired(df).groupBy("upload_batch").agg(*_accuracy_aggs()))


def confusion_pairs(df: DataFrame, level: str = "l1", top: int = 10, blank: str = "（模型空缺）") -> DataFrame:
    """Most frequent wrong ``model → human`` pairs at one level."""
    p = paired(df)
    wrong = (_judged() & (_c("model_l1") != _c("human_l1")) if level == "l1"
             else _l2_open() & (_c("human_l2") != "") & (_c("human_l2") != _c("model_l2")))
    model = F.coalesce(F.nullif(F.col(f"model_{level}"), F.lit("")), F.lit(blank))
    return (p.filter(wrong).groupBy(F.concat(model, F.lit(" → "), F.col(f"human_{level}")).alias("pair"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("pair")).limit(top))


def l1_error_rows(df: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Rows whose canonical L1 differ, with the pair as a label; a window drops undated rows."""
    p = paired(df).filter(_judged() & (_c("model_l1") != _c("human_l1")))
    if since is not None:
        p = p.filter(event_time() >= F.lit(since))
    return p.select("opinion_id", F.concat("model_l1", F.lit("→"), "human_l1").alias("pair"), "human_l1", "human_l2",
                    "model_l1", "model_l2")


def match_type_mix(df: DataFrame, blank: str = "（空）") -> DataFrame:
    mt = F.coalesce(F.nullif(strip("v3_match_type"), F.lit("")), F.lit(blank))
    return paired(df).filter(_judged()).groupBy(mt.alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


def _pool() -> Column:
    return (F.when((_c("human_l1") == lp.NON_ISSUE) & _business(_c("model_l1")), "primary")
            .when(_business(_c("human_l1")) & (_c("model_l1") == lp.NON_ISSUE), "regression")
            .when(_c("human_l1") != _c("model_l1"), "other").otherwise("correct"))


def error_pools(df: DataFrame) -> DataFrame:
    return (paired(df).filter(_judged()).groupBy(_pool().alias("pool")).agg(F.count(F.lit(1)).alias("n")))


def replay_compare(rows: DataFrame) -> DataFrame:
    """Fixed and broken counts of a replay against the baseline, over columns human_*, model_*,
    replay_*; L2 is judged where the baseline's L1 was right."""
    r = rows.withColumns({c: labels.canonicalize_l1(c) for c in ("human_l1", "model_l1", "replay_l1")})
    r = r.withColumns({c: collapse(text(c)) for c in ("human_l2", "model_l2", "replay_l2")})
    b1, a1 = _c("model_l1") == _c("human_l1"), _c("replay_l1") == _c("human_l1")
    l2 = _business(_c("human_l1")) & b1 & (_c("human_l2") != "")
    b2, a2 = _c("model_l2") == _c("human_l2"), _c("replay_l2") == _c("human_l2")
    out = r.agg(F.count(F.lit(1)).alias("l1_total"), count_when(b1).alias("l1_before_correct"),
                count_when(a1).alias("l1_after_correct"), count_when(~b1 & a1).alias("l1_fixed"),
                count_when(b1 & ~a1).alias("l1_broken"), count_when(l2).alias("l2_total"),
                count_when(l2 & b2).alias("l2_before_correct"), count_when(l2 & a2).alias("l2_after_correct"),
                count_when(l2 & ~b2 & a2).alias("l2_fixed"), count_when(l2 & b2 & ~a2).alias("l2_broken"))
    zero = F.lit(0.0)
    for lv in ("l1", "l2"):
        for side in ("before", "after"):
            out = out.withColumn(f"{lv}_{side}_pct", F.coalesce(pct(F.col(f"{lv}_{side}_correct"), F.col(f"{lv}_total")), zero))
        out = out.withColumn(f"{lv}_net", F.col(f"{lv}_fixed") - F.col(f"{lv}_broken"))
    return out


def replay_gate(rows: DataFrame, max_primary: int = 2, max_regression: int = 8) -> DataFrame:
    """Per pool: size, fixable, broken, gain in points over all rows, and whether broken is in bounds."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hit, kept = _c("replay_l1") == _c("human_l1"), _c("model_l1") == _c("human_l1")
    g = rows.groupBy(_pool().alias("pool")).agg(F.count(F.lit(1)).alias("pool_size"), count_when(~kept & hit).alias("fixable"),
                                                count_when(kept & ~hit).alias("broken"))
    limit = F.when(F.col("pool") == "primary", max_primary).when(F.col("pool") == "regression", max_regression)
    return g.withColumns({"gain_pp": pct(F.col("fixable"), total),
                          "gate_ok": F.coalesce(F.col("broken") <= limit, F.lit(True))})


def label_patch_rows(rows: DataFrame, stamp: str, meta: str = "v3_label_meta") -> DataFrame:
    """Rows a replay would put right, with the patched JSON and its stored columns. Running it on
    its own output selects nothing, because a patched model equals the human label."""
    l1_fix = (_c("human_l1") != "") & (_c("model_l1") != _c("human_l1")) & (_c("replay_l1") == _c("human_l1"))
    l2_fix = (_business(_c("human_l1")) & (_c("model_l1") == _c("human_l1")) & (_c("replay_l1") == _c("human_l1"))
              & (_c("human_l2") != "") & (_c("model_l2") != _c("human_l2")) & (_c("replay_l2") == _c("human_l2")))
    # A generator instead of a filter: a filter would be pushed below the projection that makes the
    # labels and repeat each label expression at every mention.
    r = rows.withColumn("kind", F.explode(F.split(F.when(l1_fix, "l1").when(l2_fix, "l2"), ",")))
    old = json_map(meta)
    names = ("l1", "l2", "patched_at")
    kept = F.map_filter(old, lambda k, v: ~k.isin(*names))
    new = F.create_map(F.lit("l1"), F.col("replay_l1"), F.lit("l2"), F.col("replay_l2"), F.lit("patched_at"), F.lit(stamp))
    r = r.withColumn(meta, F.to_json(F.map_concat(kept, new)))
    return r.withColumns(materialized(meta))


def weekly_period_stats(df: DataFrame, since: dt.datetime, base_reviewed: int = 0, base_mismatch: int = 0,
                        quiet_weeks: int = 0, fixable: int = 0, need_reviewed: int = 3000, need_mismatch: int = 800,
                        need_weeks: int = 2) -> DataFrame:
    """Period counts, the five most frequent wrong pairs and whether retraining is due."""
    p = paired(df).filter(_judged()).withColumn("_in", F.coalesce(event_time() >= F.lit(since), F.lit(False)))
    wrong = _c("human_l1") != _c("model_l1")
    head = p.agg(count_when(F.col("_in")).alias("new_reviewed"), count_when(F.col("_in") & wrong).alias("new_l1_wrong"),
                 F.greatest(F.count(F.lit(1)) - base_reviewed, F.lit(0)).alias("delta_reviewed"),
                 F.greatest(count_when(wrong) - base_mismatch, F.lit(0)).alias("delta_mismatch"))
    top = (p.filter(F.col("_in") & wrong).groupBy(F.concat("model_l1", F.lit(" → "), "human_l1").alias("pair"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("pair")).limit(5))
    listed = top.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pair"))),
        lambda x: F.concat(x["pair"], F.lit(":"), (-x["k"]).cast("string"))), "|").alias("a")).scalar()
    reasons = F.concat_ws(",", F.when(F.col("delta_reviewed") >= need_reviewed, "reviewed"),
                          F.when(F.col("delta_mismatch") >= need_mismatch, "mismatch"),
                          F.when(F.lit(fixable < 5 and quiet_weeks >= need_weeks), "quiet"))
    return head.withColumns({
        "top_pairs": listed,
        "ready_reasons": reasons}).withColumn("ready", F.col("ready_reasons") != "")


def accuracy_timeline(points: DataFrame) -> DataFrame:
    """One point per second (report records beat others, later beats earlier), all-zero points
    dropped, with differences to the point before."""
    rank = F.when(F.col("source").startswith("report:"), 2).otherwise(1)
    one = pick_per_key(points.withColumn("eval_time", F.date_trunc("second", "eval_time")), ["eval_time"], [rank, F.col("seq")])
    kept = one.filter((F.col("l1_accuracy_pct") != 0) | (F.col("l2_accuracy_pct") != 0))
    # The point before is the one with the rank before: a join, since a global lag would be one task.
    ranked = global_rank(kept, [F.col("eval_time")], "_r")
    values = ("l1_accuracy_pct", "l2_accuracy_pct", "cumulative_reviewed")
    before = ranked.select((F.col("_r") + 1).alias("_r"), *[F.col(c).alias("_p_" + c) for c in values])
    j = ranked.join(before, "_r", "left")
    diff = lambda c: F.col(c) - F.col("_p_" + c)
    return j.withColumns({"delta_l1_pp": F.round(diff(values[0]), 2), "delta_l2_pp": F.round(diff(values[1]), 2),
                          "delta_reviewed": diff(values[2])}).drop("_r", *["_p_" + c for c in values])


def accuracy_history(history: DataFrame, new: DataFrame, keep: int = 30, threshold: float = 98.0) -> DataFrame:
    """History with the new point, the newest ``keep`` of them, and a flag at the threshold."""
    return (history.unionByName(new).orderBy(F.desc("timestamp")).limit(keep)
            .withColumn("auto_mode", F.col("accuracy") >= threshold))


def ab_compare(df: DataFrame, baseline: Column, candidate: Column, margin: float = 2.0) -> DataFrame:
    """Accuracy of two prediction columns on the same rows and whether the candidate wins."""
    r = df.withColumns({"_h": labels.canonical_or_blank("review_l1"), "_b": labels.canonical_or_blank(baseline),
                        "_k": labels.canonical_or_blank(candidate)}).filter(F.col("_h") != "")
    out = r.agg(count_when(F.col("_b") != "").alias("baseline_total"), count_when(F.col("_b") == F.col("_h")).alias("baseline_correct"),
                count_when(F.col("_k") != "").alias("candidate_total"), count_when(F.col("_k") == F.col("_h")).alias("candidate_correct"))
    out = out.withColumns({f"{s}_pct": F.coalesce(pct(F.col(f"{s}_correct"), F.col(f"{s}_total")), F.lit(0.0))
                           for s in ("baseline", "candidate")})
    return (out.withColumn("delta_pp", F.round(F.col("candidate_pct") - F.col("baseline_pct"), 2))
            .withColumn("candidate_beats", F.col("delta_pp") >= margin))


def char_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the character sets; zero when either has fewer than two characters."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ""),
                                                lambda x: x != ""))
    x, y = chars(a), chars(b)
    return F.when((F.size(x) >= 2) & (F.size(y) >= 2),
                  F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def taxonomy_match_rows(df: DataFrame) -> DataFrame:
    """Per row: exact agreement at three levels (auto_* against human_*), compatible agreement
    inside L1 agreement, and the list of levels that differ."""
    r = df
    for lv in ("l1", "l2", "l3"):
        r = r.withColumn(f"{lv}_ok", (F.col(f"human_{lv}") != "") & (F.col(f"auto_{lv}") == F.col(f"human_{lv}")))
    r = r.withColumns({
        "l2_compat": F.col("l1_ok") & (F.col("l2_ok") | (char_jaccard("auto_l2", "human_l2") >= 0.28)),
        "l3_compat": F.col("l1_ok") & (F.col("l3_ok") | (char_jaccard("auto_l3", "human_l3") >= 0.22))})
    names = (("l1_ok", "一级"), ("l2_ok", "二级"), ("l3_ok", "三级"))
    return r.withColumn("reason", F.concat_ws("/", *[F.when(~F.col(c), n) for c, n in names]))


def taxonomy_match_report(df: DataFrame) -> DataFrame:
    r = taxonomy_match_rows(df)
    out = r.agg(F.count(F.lit(1)).alias("total"), *[count_when(F.col(f"{lv}_ok")).alias(f"{lv}_match") for lv in ("l1", "l2", "l3")],
                count_when(F.col("l2_compat")).alias("l2_compat"), count_when(F.col("l3_compat")).alias("l3_compat"))
    return out.withColumns({"l1_rate": pct(F.col("l1_match"), F.col("total")), "l2_rate": pct(F.col("l2_match"), F.col("total")),
                            "l3_rate": pct(F.col("l3_match"), F.col("total")), "l2_compat_rate": pct(F.col("l2_compat"), F.col("l1_match")),
                            "l3_compat_rate": pct(F.col("l3_compat"), F.col("l1_match"))})


def route_metrics(df: DataFrame, use_model: Column, threshold: float = 0.52) -> DataFrame:
    """Exclusive routing counters of one run plus the non-exclusive guard counter.

    Columns read: empty_text, match_type, cache_hit, was_conflict, conflict_kind, guard,
    needs_review, confidence.
    """
    mt = F.coalesce("match_type", F.lit(""))
    forced = F.coalesce("needs_review", F.lit(False)) | mt.isin("qwen_parse_failed", "qwen_whitelist_reject", "qwen_row_failed", "classify_error", "none")
    route = (F.when(F.col("empty_text"), "skipped_empty").when(mt == "gold_review", "gold_hit")
             .when(use_model & mt.isin("qwen_row_failed", "classify_error"), "llm_failed")
             .when(use_model & F.coalesce("cache_hit", F.lit(False)), "llm_cache_hit")
             .when(use_model, "llm_arbitrated").when(F.col("was_conflict"), "conflict")
             .when(mt.isin("classify_error", "none"), "failed")
             .when(forced | (F.coalesce("confidence", F.lit(0.0)) < threshold), "rule_low_conf").otherwise("rule_ok"))
    r = df.withColumn("route", route)
    kind = F.when((F.col("route") == "conflict") & (F.coalesce("conflict_kind", F.lit("")) != ""), F.col("conflict_kind"))
    guard = F.col("route").isin("rule_ok", "rule_low_conf") & F.coalesce("guard", F.lit(False))
    return r.groupBy("route", F.coalesce(kind, F.lit("")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), count_when(guard).alias("guard_triggered"))


def ambiguity_reasons(rules=ap.TEXT_HINTS, domain_l2=ap.DOMAIN_L2, consult_l2: str = ap.CONSULT_L2) -> Column:
    """Reason codes of one pair of labels and its text, in order, without repeats."""
    body = F.coalesce(F.col("original_text"), F.lit(""))
    hit = {k: any_case(body, v) for k, v in rules.items()}
    h1, m1, h2, m2 = _c("human_l1"), _c("model_l1"), _c("human_l2"), _c("model_l2")
    asks = hit["consult"] & ~hit["issue"]
    flip = (h1 == lp.NON_ISSUE) & (m1 == lp.PRODUCT)
    domain = F.when(hit["domain"], F.when((h2 == consult_l2) & m2.isin(*domain_l2), "lfc_consult_vs_lfc")
                    .when(h2.isin(*domain_l2) & (m2 == consult_l2), "lfc_lfc_vs_consult")
                    .when(flip, F.when(asks, "lfc_pure_consult").when(hit["issue"], "lfc_issue_signal"))
                    .when((h1 != m1) & asks, "lfc_pure_consult"))
    pairs = F.when(flip, "top_l1_product_nonissue").when((m1 == lp.SERVICE) & (h1 == lp.NON_ISSUE), "top_l1_service_nonissue").when(
        (m1 == lp.NON_ISSUE) & (h1 == lp.PRODUCT), "top_l1_nonissue_product").when(
        (m1 == lp.NON_ISSUE) & (h1 == lp.SERVICE), "top_l1_nonissue_service")
    return F.array_compact(F.array(domain, F.when(flip & hit["praise"], "praise_vs_product"),
                                   F.when((h1 == lp.NON_ISSUE) & (m1 == lp.SERVICE) & hit["praise"], "sales_praise_boundary"), pairs))


def ambiguity_rows(df: DataFrame, rules=ap.TEXT_HINTS, domain_l2=ap.DOMAIN_L2, consult_l2: str = ap.CONSULT_L2,
                   only: Sequence[str] | None = None, priorities=ap.PRIORITY) -> DataFrame:
    p = paired(df).filter(_judged() & filled("original_text"))
    p = p.withColumn("reasons", ambiguity_reasons(rules, domain_l2, consult_l2))
    if only is not None:
        p = p.withColumn("reasons", F.filter("reasons", lambda r: r.isin(*only)))
    p = p.filter(F.size("reasons") > 0)
    table = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    best = F.array_max(F.transform("reasons", lambda r: F.coalesce(F.try_element_at(table, r), F.lit(10))))
    return p.withColumn("score", best + F.least(F.lit(5), F.size("reasons") - 1))


def ambiguity_queue(df: DataFrame, top: int = 200, **kw) -> DataFrame:
    """Doubtful reviewed rows, the most doubtful first."""
    return (ambiguity_rows(df, **kw).orderBy(F.desc("score"), F.asc("opinion_id")).limit(top)
            .select("opinion_id", "human_l1", "human_l2", "model_l1", "model_l2",
                    F.concat_ws("|", "reasons").alias("reasons"), "score"))


def ambiguity_reason_counts(df: DataFrame, **kw) -> DataFrame:
    return ambiguity_rows(df, **kw).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def action_hints(full: DataFrame, window: DataFrame, replay: DataFrame, top_error: DataFrame | None = None) -> DataFrame:
    """Advice codes from one-row results: overall accuracy, window accuracy and replay counts."""
    get = lambda d, c: d.select(c).scalar()
    w_tot, w_ok = get(window, "l1_denominator"), get(window, "l1_correct")
    f = get(full, "l1_accuracy") * 100
    w = F.coalesce(F.try_divide(w_ok * F.lit(100.0), w_tot), F.lit(0.0))
    broken, fixed = get(replay, "l1_broken"), get(replay, "l1_fixed")
    codes = F.array_compact(F.array(
        F.when(w_tot < 80, "few_rows"),
        F.when(w >= 84, "stable").when(w >= 80, "watch_top_errors").otherwise("iterate_rules"),
        F.when(f - w > 2, "report_both_windows"),
        F.when(broken > 8, "narrow_rules").when((broken == 0) & (fixed >= 20), "rules_healthy").when(broken <= 3, "rules_acceptable")))
    return full.sparkSession.range(1).select(F.explode(codes).alias("hint"))


def audit_sample(df: DataFrame, as_of: dt.date, days: int = 7, n: int = 50, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of the last days in a seeded hash order, so a rerun gives the same rows."""
    lo = F.lit(dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days))
    hi = F.lit(dt.datetime.combine(as_of, dt.time()) + dt.timedelta(days=1))
    t = event_time()
    return (df.filter((t >= lo) & (t < hi)).withColumn("sample_key", F.md5(F.concat("opinion_id", F.lit(f"|{seed}"))))
            .orderBy("sample_key", "opinion_id").limit(n))
