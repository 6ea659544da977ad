"""Themes with evidence, recurrence, shifts, concentration and life cycles across records."""
from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.functions import labels
from plaintide.functions.common import hint_small, count_when, filled, share, strip, text, top_rows
from plaintide.functions.dates import event_time
from plaintide.functions.insight import with_insight_fields
from plaintide.functions.meta import json_get
from plaintide.functions.text import mask_phone, mask_vin, model_name
from plaintide.operators.keyed import pick_per_key
from plaintide.operators.paging import By, page_rows
from plaintide.packs import insight as pk
from plaintide.session import materialise

FALLBACK_THEME = ("T99", "其他-待归类")
FIELDS = ("intent", "expected_action", "severity", "urgency", "repeat_signal", "root_cause_hint")


def theme_path(l1="l1", l2="l2", l3="l3") -> Column:
    return F.concat_ws("/", text(l1), text(l2), text(l3))


def theme_lookup(df: DataFrame, theme_map: DataFrame, themes: DataFrame) -> DataFrame:
    """Path to theme; a miss goes to the fallback theme."""
    dims = (theme_map.join(themes, "theme_id", "left")
            .select("path", "theme_id", F.coalesce("name", "theme_id").alias("theme_name")))
    j = df.withColumn("path", theme_path()).join(hint_small(dims, theme_map), "path", "left")
    return j.withColumns({"theme_id": F.coalesce("theme_id", F.lit(FALLBACK_THEME[0])),
                          "theme_name": F.coalesce("theme_name", F.lit(FALLBACK_THEME[1]))})


def insight_enrich(df: DataFrame, theme_map: DataFrame, themes: DataFrame, rules=pk.DEFAULT) -> DataFrame:
    """Labels, insight fields (the JSON's own win when it names an intent), theme, time, model."""
    l1, l2, l3 = labels.insight_labels()
    r = with_insight_fields(df.withColumns({"l1": l1, "l2": l2, "l3": l3}), rules=rules)
    stored = text(json_get("v3_label_meta", "intent"))
    r = r.withColumn("_own", stored != "")
    own = {k: json_get("v3_label_meta", k) for k in FIELDS}
    own["repeat_signal"] = F.coalesce(own["repeat_signal"].try_cast("boolean"), F.lit(False))
    r = r.withColumns({k: F.when(F.col("_own"), own[k]).otherwise(F.col(k)) for k in FIELDS}).drop("_own")
    r = theme_lookup(r, theme_map, themes)
    return r.withColumns({
        "reviewed": labels.is_reviewed(), "event_ts": event_time(), "car_model_norm": model_name("car_model"),
        "vin": F.upper(text("vin")), "phone": text("phone"), "country": text("country"),
        "reflow_synced": F.coalesce("reflow_synced", F.lit(0))})


def entity_coverage(rows: DataFrame, min_fill: float = 0.30) -> DataFrame:
    """Fill rates and the entity key they allow."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    out = rows.agg(F.count(F.lit(1)).alias("n"), (count_when(filled("vin")) / n).alias("v"), (count_when(filled("phone")) / n).alias("p"),
                   (count_when(filled("car_model_norm")) / n).alias("c"))
    key = F.when(F.col("v") >= min_fill, "vin").when(F.col("p") >= min_fill, "phone").otherwise("text_repeat")
    return out.select("n", F.round("v", 4).alias("vin_fill"), F.round("p", 4).alias("phone_fill"),
                      F.round("c", 4).alias("car_model_fill"), key.alias("entity_key"))


def theme_members(rows: DataFrame) -> DataFrame:
    """One thin row per (theme, opinion): the first in row order; rows without an id all stay.
    An aggregate with map-side combine, so a theme that holds a third of the rows is no hot spot."""
    thin = rows.filter(filled("l1") & filled("l3")).select(
        "theme_id", "theme_name", "id", text("opinion_id").alias("opinion_id"), "l1", "l2", "l3", "path", "reviewed")
    keyed = thin.withColumn("_key", F.coalesce(F.nullif("opinion_id", F.lit("")), F.concat(F.lit("#"), "id")))
    return pick_per_key(keyed, ["theme_id", "_key"], [F.col("id")], last=False).drop("_key")


def theme_l3_breakdown(rows: DataFrame) -> DataFrame:
    """Counts per (theme, path): total, reviewed, model only."""
    return theme_members(rows).groupBy("theme_id", "theme_name", "l1", "l2", "l3", "path").agg(
        F.count(F.lit(1)).alias("count"), count_when(F.col("reviewed")).alias("reviewed_count"),
        count_when(~F.col("reviewed")).alias("model_only_count"))


def theme_quotes(rows: DataFrame, per_theme: int = 3, chars: int = 160) -> DataFrame:
    """The first quotes of each theme among its first ``3 * per_theme`` opinions. Ids are chosen
    from thin rows; only the chosen rows bring their text."""
    first = top_rows(theme_members(rows), ["theme_id"], [F.asc("id")], per_theme * 3, salt_by=["id"]).select("theme_id", "id", "rn")
    body = F.regexp_replace(strip("original_text"), "\n", " ")
    t = first.join(rows.select("id", body.alias("quote")), "id").filter(F.col("quote") != "")
    w = Window.partitionBy("theme_id").orderBy("rn")
    return (t.withColumn("quote_no", F.row_number().over(w)).filter(F.col("quote_no") <= per_theme)
            .select("theme_id", "quote_no", "id", F.substring("quote", 1, chars).alias("quote")))


def theme_totals(rows: DataFrame) -> DataFrame:
    """Per theme: total, reviewed, model only, number of paths, distinct opinions."""
    return theme_members(rows).groupBy("theme_id", "theme_name").agg(
        F.count(F.lit(1)).alias("count"), count_when(F.col("reviewed")).alias("reviewed_count"),
        count_when(~F.col("reviewed")).alias("model_only_count"), F.count_distinct("path").alias("l3_n"),
        F.count_distinct(F.nullif("opinion_id", F.lit(""))).alias("opinion_ids"))


def evidence_chain(rows: DataFrame, per_theme: int = 3) -> DataFrame:
    """Theme totals with quotes. Opinion ids stay as rows (``theme_members``); only the few quotes are
    gathered into an array."""
    m = theme_totals(rows)
    q = theme_quotes(rows, per_theme).groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("quote_no", "quote"))).alias("q"))
    out = m.join(q, "theme_id", "left").withColumn("quotes", F.transform("q", lambda x: x["quote"])).drop("q")
    return out.withColumn("reconcile_ok", (F.col("count") == F.col("opinion_ids"))
                          & (F.col("count") == F.col("reviewed_count") + F.col("model_only_count")))


def reconcile_evidence(chain: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Theme totals, path totals and distinct ids must agree, per theme and overall."""
    l3 = breakdown.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("l3_total")).scalar()
    out = chain.agg(F.count(F.lit(1)).alias("themes"), F.coalesce(F.sum("count"), F.lit(0)).alias("theme_total"),
                    F.coalesce(F.sum("opinion_ids"), F.lit(0)).alias("opinion_id_total"),
                    count_when(~F.col("reconcile_ok")).alias("bad_themes")).withColumn("l3_total", l3)
    return out.withColumn("gate_ok", (F.col("theme_total") == F.col("l3_total")) & (F.col("theme_total") == F.col("opinion_id_total"))
                          & (F.col("bad_themes") == 0))


def recurrence(rows: DataFrame, entity: str = "vin", window_days: int = 30) -> DataFrame:
    """Repeat rate, mean gap and backlog per entity key.

    Consecutive gaps inside a window add up to its last minus its first event, so no ordering of
    an entity's rows is needed: two aggregates give everything, and a hot entity costs no sort.
    """
    if entity == "text_repeat":
        n = F.greatest(F.count(F.lit(1)), F.lit(1))
        return rows.agg(n.alias("eligible_entities"), count_when(F.col("repeat_signal")).alias("repeat_entities"),
                        count_when((F.col("reflow_synced") < 1) & F.col("reviewed")).alias("unresolved_backlog")).select(
            "eligible_entities", "repeat_entities", share(F.col("repeat_entities"), F.col("eligible_entities")).alias("repeat_rate"),
            F.lit(None).cast("double").alias("mean_days_to_repeat"), "unresolved_backlog")
    thin = rows.filter(F.col(entity) != "").select(F.col(entity).alias("entity"), "event_ts", "reflow_synced", "id")
    per = thin.groupBy("entity").agg(
        F.max("event_ts").alias("last"), F.count(F.lit(1)).alias("n"),
        F.max_by("reflow_synced", F.struct(F.coalesce("event_ts", F.lit("0001-01-01").cast("timestamp")), -F.col("id"))).alias("latest_sync"))
    cut = F.col("last") - F.make_dt_interval(F.lit(window_days))
    dated = thin.filter(F.col("event_ts").isNotNull()).select("entity", "event_ts")
    inside = (dated.join(per.select("entity", "last"), "entity").filter(F.col("event_ts") >= cut)
              .groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.min("event_ts").alias("first")))
    e = per.join(inside, "entity", "left")
    repeat = F.when(F.col("last").isNull(), F.col("n") >= 2).otherwise(F.col("k") >= 2)
    span = (F.unix_micros("last") - F.unix_micros("first")) / F.lit(86_400_000_000.0)
    out = e.agg(F.count(F.lit(1)).alias("eligible_entities"), count_when(repeat).alias("repeat_entities"),
                F.sum(F.when(F.col("k") >= 2, span)).alias("_span"), F.sum(F.when(F.col("k") >= 2, F.col("k") - 1)).alias("_gaps"),
                count_when(F.col("latest_sync") < 1).alias("unresolved_backlog"))
    return out.select("eligible_entities", "repeat_entities",
                      F.round(F.col("repeat_entities") / F.greatest("eligible_entities", F.lit(1)), 4).alias("repeat_rate"),
                      F.round(F.col("_span") / F.col("_gaps"), 2).alias("mean_days_to_repeat"), "unresolved_backlog")


def period_cells(rows: DataFrame, keys: Sequence[str], time: str = "event_ts") -> DataFrame:
    """(keys, age, n): rows counted by the keys and by their age, in days begun since the newest row; NULL for rows without a
    time. One scan for the newest time and one for the cells, from which any window of whole days is then read."""
    newest = rows.agg(F.max(time).alias("m")).scalar()
    age = F.ceil((F.unix_micros(newest) - F.unix_micros(time)) / F.lit(86_400_000_000.0)).cast("int")
    return materialise(rows.groupBy(*keys, age.alias("age")).agg(F.count(F.lit(1)).alias("n")))


def in_window(days: int, back: int = 0) -> Column:
    """Whether a cell lies in the ``days`` that end at the newest row (rows without a time too, as in ``split_windows``), or with
    ``back`` in the days before them."""
    n = max(days, 1)
    return F.col("age").isNull() | (F.col("age") <= n - 1) if not back else F.col("age").between(n, n - 1 + n)


def intent_shift(cells: DataFrame, days: int = 30) -> DataFrame:
    """Share of escalations among fault, help and escalation per L2, against the previous period; from ``period_cells`` by l2 and
    intent."""
    def rate(window: Column) -> Column:
        esc = F.sum(F.when(window & (F.col("intent") == "投诉升级"), F.col("n")).otherwise(0))
        base = F.sum(F.when(window & F.col("intent").isin("投诉升级", "报障", "求助"), F.col("n")).otherwise(0))
        return esc / F.greatest(base, F.lit(1))
    now, before = in_window(days), F.coalesce(in_window(days, 1), F.lit(False))
    j = (cells.filter(filled("l2") & (F.coalesce("intent", F.lit("")) != "") & (now | before)).groupBy("l2").agg(rate(now).alias("c"), rate(before).alias("p")))
    return j.select("l2", F.round("c", 4).alias("escalation_rate"), F.round("p", 4).alias("prev_rate"),
                    F.round((F.col("c") - F.col("p")) * 100, 1).alias("delta_pp")).orderBy(
        F.desc(F.abs("delta_pp")), F.desc("escalation_rate"), F.asc("l2"))


def expectation_unmet(rows: DataFrame) -> DataFrame:
    unmet = count_when((F.col("reflow_synced") < 1) | F.col("repeat_signal"))
    # Blank actions leave by their zero count: a filter on the derived key would be pushed into the
    # scan's projection and repeat the whole pattern chain.
    return (rows.groupBy(F.col("expected_action").alias("action"))
            .agg(count_when(filled("expected_action")).alias("count"), unmet.alias("_u")).filter(F.col("count") > 0)
            .select("action", "count", share(F.col("_u"), F.col("count")).alias("unmet_rate"))
            .orderBy(F.desc("unmet_rate"), F.desc("count"), F.asc("action")))


def concentration_lift(rows: DataFrame, dimensions: Mapping[str, str] | None = None, min_n: int = 5, min_share: float = 0.3, min_lift: float = 2.0,
                       top: int = 20) -> DataFrame:
    """L3 whose rows sit in one dimension value far above that value's share of all rows, the ``top`` of each dimension.
    ``dimensions`` maps a column to its name in the result. The rows are read once, for the cells of (l3, all dimensions); a
    dimension's cells are sums of these."""
    names = dict(dimensions or {"car_model_norm": "car_model", "country": "region"})
    all_cells = materialise(rows.groupBy(text("l3").alias("l3"), *names).agg(F.count(F.lit(1)).alias("n")))

    def lifts(column: str, name: str) -> DataFrame:
        cells = all_cells.filter(F.col(column) != "").groupBy("l3", F.col(column).alias("value")).agg(F.sum("n").alias("count"))
        overall = cells.groupBy("value").agg(F.sum("count").alias("v_n"))
        total = cells.agg(F.sum("count").alias("t")).scalar()
        named = cells.filter(F.col("l3") != "")
        sizes = named.groupBy("l3").agg(F.sum("count").alias("l3_n")).filter(F.col("l3_n") >= min_n)
        j = named.join(sizes, "l3").join(overall, "value").withColumns({"s": F.col("count") / F.col("l3_n"), "b": F.col("v_n") / total})
        hits = j.filter((F.col("s") / F.col("b") >= min_lift) & (F.col("s") >= min_share))
        return hits.select("l3", F.lit(name).alias("dimension"), "value", F.round("s", 4).alias("share"), F.round("b", 4).alias("baseline_share"),
                           F.round(F.col("s") / F.col("b"), 2).alias("lift"), "count", "l3_n").orderBy(
            F.desc("lift"), F.desc("count"), F.asc("l3"), F.asc("value")).limit(top)
    return reduce(DataFrame.unionByName, [lifts(c, n) for c, n in names.items()])


def fault_lifecycle(rows: DataFrame, period_days: int = 7, top: int = 50, weights=pk.SEVERITY_WEIGHT) -> DataFrame:
    """Trend state of every (L2, L3) over five periods back from the newest row."""
    newest = rows.agg(F.max("event_ts").alias("m")).scalar()
    age_days = F.floor((F.unix_micros(newest) - F.unix_micros("event_ts")) / F.lit(86_400_000_000))
    idx = F.floor(age_days / max(period_days, 1)).cast("int")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.coalesce(F.try_element_at(table, F.coalesce("severity", F.lit("低"))), F.lit(1))
    g = (rows.filter(filled("l2") & filled("l3")).withColumns({"_i": idx, "_w": w}).groupBy("l2", "l3")
         .agg(*[count_when(F.col("_i") == k).alias(f"c{k}") for k in range(5)], F.sum("_w").alias("severity_weighted"))
         .filter(F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4") > 0))
    c = [F.col(f"c{k}") for k in range(5)]
    g = g.withColumns({"avg": (c[1] + c[2] + c[3] + c[4]) / 4.0, "weeks_active": sum([F.when(x > 0, 1).otherwise(0) for x in c], F.lit(0))})
    avg = F.col("avg")
    near = lambda x: F.abs(x - avg) <= avg * 0.2 + F.lit(1e-12)
    low = F.greatest(avg, F.lit(1.0)) * 0.2
    dip = ((c[1] <= low) & (c[2] >= avg * 0.8)) | ((c[2] <= low) & (c[3] >= avg * 0.8)) | ((c[3] <= low) & (c[4] >= avg * 0.8))
    base = F.greatest(avg, F.lit(0.1))
    state = (F.when((avg == 0) & (c[0] >= 3), "新发").when((c[0] >= base * 1.5) & (c[1] > c[2]), "恶化")
             .when((F.col("weeks_active") >= 3) & (avg > 0) & near(c[0]) & near(c[1]) & near(c[2]), "高位平台")
             .when((c[1] < c[2]) & (c[0] <= base * 0.6) & (c[0] < c[1]), "收敛")
             .when((c[0] >= avg) & dip, "复发").when((c[0] < 3) & (avg < 1), F.lit(None)).otherwise("高位平台"))
    return (g.withColumn("trend_state", state).filter(F.col("trend_state").isNotNull())
            .select("l2", "l3", "trend_state", F.col("c0").alias("current"), F.round("avg", 2).alias("avg_4p"), "weeks_active",
                    "severity_weighted", F.concat_ws(",", *[x.cast("string") for x in c]).alias("series"))
            .orderBy(F.desc("severity_weighted"), F.desc("current"), F.asc("l2"), F.asc("l3")).limit(top))


def _whole_pct(c: Column) -> Column:
    return F.concat(F.round(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def insight_templates(resolution: DataFrame, entity_key: str, shift: DataFrame, expectations: DataFrame,
                      concentration: DataFrame, lifecycle: DataFrame, chain: DataFrame) -> DataFrame:
    """Sentences from the result tables that pass their thresholds."""
    cat = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    row = lambda df, tid, body, n: df.select(F.lit(tid).alias("template_id"), body.alias("text"), n.cast("bigint").alias("count"))
    s = lambda c: F.col(c).cast("string")
    zero = F.lit(0)
    out = [row(resolution.filter(F.col("repeat_rate") > 0.30), "I1",
               cat("窗口内同一实体二次反馈占比 ", _whole_pct(F.col("repeat_rate")), f" （实体键={entity_key}），首次处理未解决风险偏高"), F.col("repeat_entities"))]
    out.append(row(shift.orderBy(F.desc(F.abs("delta_pp")), F.desc("escalation_rate"), F.asc("l2")).limit(5).filter(F.col("delta_pp") >= 5), "I2",
                   cat(F.col("l2"), " 投诉升级占比从 ", _whole_pct(F.col("prev_rate")), " 升至 ", _whole_pct(F.col("escalation_rate")), "（+", s("delta_pp"), "pp）"), zero))
    out.append(row(concentration.orderBy(F.desc("lift"), F.desc("count"), F.asc("l3"), F.asc("value")).limit(5), "I3",
                   cat(F.col("l3"), " 有 ", _whole_pct(F.col("share")), " 来自 ", F.col("value"), "，而该维度仅占总量 ", _whole_pct(F.col("baseline_share")),
                       "（lift=", s("lift"), "）"), F.col("count")))
    state = F.col("trend_state")
    out.append(row(lifecycle.filter((state == "新发") & (F.col("severity_weighted") >= 6)), "I4",
                   cat("本期新发高危问题 ", F.col("l3"), "（", s("current"), " 条），过去 4 期均值 ", s("avg_4p")), F.col("current")))
    out.append(row(lifecycle.filter(state == "复发"), "I5", cat(F.col("l3"), " 呈复发态势（当期 ", s("current"), " / 均值 ", s("avg_4p"), "）"), F.col("current")))
    out.append(row(lifecycle.filter((state == "高位平台") & (F.col("weeks_active") >= 4)), "I8",
                   cat(F.col("l2"), "/", F.col("l3"), " 已连续 ", s("weeks_active"), " 期维持高位，属慢性问题"), F.col("current")))
    out.append(row(expectations.orderBy(F.desc("unmet_rate"), F.desc("count"), F.asc("action")).limit(1), "I6",
                   cat("用户最常要求 ", F.col("action"), "（", s("count"), " 条），未满足率 ", _whole_pct(F.col("unmet_rate")), "，是当前最大的期望落差"), F.col("count")))
    themes = chain.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = chain.orderBy(F.desc("count"), F.asc("theme_id")).limit(1).select("theme_name").scalar()
    worst = (lifecycle.groupBy("l3").agg(F.sum("severity_weighted").alias("w")).orderBy(F.desc("w"), F.asc("l3")).limit(1)
             .withColumn("_top", head).filter((themes >= 2) & ~F.col("_top").contains(F.col("l3"))))
    out.append(row(worst, "I9", cat("按严重度加权后头号问题倾向 ", F.col("l3"), "，而按条数头号主题是 ", F.col("_top"), "，建议调整资源投向"), zero))
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res


def field_distribution(rows: DataFrame) -> DataFrame:
    """Counts per insight field and value, in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"))
                      for k in ("intent", "expected_action", "severity", "urgency", "repeat_signal")])
    return (rows.select(F.explode(cells).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n")))


def theme_period_compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Theme counts against the previous window, with the change and a trend word."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return theme_members(df).groupBy("theme_id", "theme_name").agg(F.count(F.lit(1)).alias(name))
    cur = counts(current, "count")
    prev = counts(previous, "prev_count").drop("theme_name")
    j = cur.join(prev, "theme_id", "left").withColumn("prev_count", F.coalesce("prev_count", F.lit(0)))
    ratio = F.col("count") / F.col("prev_count")
    state = (F.when(F.col("prev_count") <= 0, F.when(F.col("count") >= 3, "新发").otherwise("—"))
             .when(ratio >= 1.2, "上升").when(ratio <= 0.8, "下降").otherwise("持平"))
    return j.withColumns({"wow_delta": F.col("count") - F.col("prev_count"), "trend_state": state})


def theme_opinions(rows: DataFrame, theme_id: str, page: int = 1, size: int = 20, reviewed_only: bool | None = None,
                   chars: int = 300) -> DataFrame:
    """One page of a theme's opinions with masked identifiers; the reviewed filter has three states."""
    page, size = max(1, page), max(1, min(size, 200))
    mine = theme_detail_rows(rows, theme_id, chars)
    if reviewed_only is not None:
        mine = mine.filter(F.col("reviewed") == reviewed_only)
    got, total = page_rows(mine, [By("id")], page, size)
    return got.withColumn("total", F.lit(total).cast("long"))


def theme_detail_rows(rows: DataFrame, theme_id: str | None = None, chars: int = 300) -> DataFrame:
    """Opinion rows behind each theme (or one), masked. Matches theme membership by row id."""
    src = rows.filter(F.col("theme_id") == theme_id) if theme_id else rows
    ids = theme_members(src).select("id")
    return src.join(ids, "id", "left_semi").select(
        "id", "theme_id", "theme_name", "opinion_id", "reviewed", "l1", "l2", "l3", "path", mask_vin("vin").alias("vin"),
        mask_phone("phone").alias("phone"), F.col("car_model_norm").alias("car_model"), "country", "intent", "expected_action",
        "severity", F.substring(F.coalesce("original_text", F.lit("")), 1, chars).alias("text"))


def theme_coverage(rows: DataFrame) -> DataFrame:
    """Row counts behind a theme report and a code that explains an empty one."""
    m3 = F.coalesce(F.nullif(text(json_get("v3_label_meta", "l3")), F.lit("")), text(json_get("v3_label_meta", "level3")))
    out = rows.agg(F.count(F.lit(1)).alias("current_n"), count_when(~filled("l1") | ~filled("l3")).alias("skipped_no_l3"),
                   count_when(filled("v3_l3") | filled("review_l3")).alias("col_l3_n"), count_when(m3 != "").alias("meta_l3_n"),
                   F.count_distinct(F.when(filled("l1") & filled("l3"), F.col("theme_id"))).alias("theme_n"))
    hint = (F.when(F.col("theme_n") > 0, "").when(F.col("current_n") <= 0, "no_rows")
            .when(F.col("skipped_no_l3") >= F.col("current_n"),
                  F.when((F.col("meta_l3_n") == 0) & (F.col("col_l3_n") == 0), "no_l3").otherwise("partial_l3")).otherwise("unmapped"))
    return out.withColumn("hint", hint)
