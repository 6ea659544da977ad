"""Intent, expected action, severity, urgency, repeat flag and a root-cause hint from text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaintide.functions.common import any_case, col, collapse, text
from plaintide.functions.meta import json_map
from plaintide.packs import insight as pk, labels as lp


def _expected_action(hit: dict[str, Column], intent: Column) -> Column:
    return (F.when(hit["refund"], "退款赔偿").when(hit["visit"], "上门").when(hit["repair"], "维修")
            .when(hit["feature"] | (intent == "建议"), "功能实现")
            .when(hit["explain"] | intent.isin("咨询", "告知"), "解释说明")
            .when(intent == "表扬", "无需动作")
            .otherwise("维修"))


def _severity(hit: dict[str, Column], intent: Column) -> Column:
    return (F.when(hit["severe"] | (intent == "投诉升级"), "高")
            .when(hit["moderate"] | intent.isin("报障", "求助"), "中").otherwise("低"))


def attach_insight(doc: Column | str, fields: dict[str, Column],
                   core=("l1", "l2", "l3", "confidence", "match_type")) -> Column:
    """JSON with the insight keys added; existing core keys are never replaced."""
    base = json_map(doc)
    names = [k for k in fields if k not in core]
    kept = F.map_filter(base, lambda k, v: ~k.isin(names))
    extra = F.create_map(*[x for k in names for x in (F.lit(k), fields[k].cast("string"))])
    return F.to_json(F.map_concat(kept, extra))


def with_insight_fields(df, body="original_text", l1="l1", l2="l2", l3="l3", rules=pk.DEFAULT):
    """Adds the six fields. Intent is computed once and the later fields read it as a column,
    so the patterns are not evaluated again inside every branch."""
    hits = {f"_h_{k}": any_case(F.coalesce(col(body), F.lit("")), v) for k, v in rules.items()}
    out = df.withColumns(hits)
    hit = {k: F.col(f"_h_{k}") for k in rules}
    l1t, l2t, l3t = text(l1), text(l2), text(l3)
    out = out.withColumn("intent", F.when(hit["praise"] & ~hit["fault"] & ~hit["escalate"], "表扬")
                         .when(hit["escalate"], "投诉升级").when(hit["help"], "求助")
                         .when(hit["suggest"] & ~hit["fault"], "建议").when(hit["fault"], "报障")
                         .when(hit["consult"], "咨询")
                         .when((l1t == lp.NON_ISSUE) & ~hit["inform"], "咨询")
                         .when(hit["inform"] | (l1t != lp.PRODUCT), "告知").otherwise("报障"))
    out = (out.withColumn("expected_action", _expected_action(hit, F.col("intent")))
           .withColumn("severity", _severity(hit, F.col("intent"))))
    hint = F.substring(F.when((l3t != "") & ~l3t.isin(*pk.GENERIC_L3), l3t).when(l2t != "", l2t)
                       .otherwise(collapse(F.coalesce(col(body), F.lit("")))), 1, 40)
    return (out.withColumn("urgency", F.when(hit["urgent"] | (F.col("severity") == "高"), "紧急").otherwise("一般"))
            .withColumn("repeat_signal", hit["repeat"]).withColumn("root_cause_hint", hint)
            .drop(*hits))
