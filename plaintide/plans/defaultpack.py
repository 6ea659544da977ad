"""Queries on the default pack. The given texts hold none of its words, so each begins with a sentence in them, chosen by its id;
every second text is the sentence alone, as short texts have stages of their own."""
from __future__ import annotations

from pyspark.sql import functions as F

from plaintide.operators import classify as C
from plaintide.packs import default_rules
from plaintide.packs.capture import BLOCKED, ELIGIBLE, SIGNALS, TERMS
from plaintide.plans import duck as q
from plaintide.plans.fixture import opinion
from plaintide.plans.registry import query

SENTENCES = [
    "积分只到账一半", "用户反馈积分被扣除要求核实", "车机黑屏死机了", "客服不专业", "充电桩跳枪了", "闪充站就在楼下", "试驾讲解少", "期待", "很好很好", "已知晓", "有意向下单",
    "用户反馈需要取送车", "被剐蹭了想要售后报价", "客户建议商城上新", "太好了是ota", "来源：意见反馈", "更换雨刮多少钱", "轮胎扎钉请协助", "驾驶乐趣有", "客户表示这一次的安排大体满意",
    "希望音乐优化一下", "变更手机号", "有空闲工位", "远程为其关下后尾门", "乐趣无穷，一路向北", "没有电了，打不开车门", "客户在线买车有多少积分", "灭火器需不需要更换",
    "试驾回访", "改约到周五", "闪充机器人来了", "推送活动资讯", "感谢门店", "咨询一下配置", "官宣", "顾问讲解", "闪充站安装", "这个车子停在路边",
    "爆胎之后门店来人，为门店售后点赞", "告知客户的阶梯奖励规则", "发生交通事故，需要协助", "不要太好看", "身体不舒服取消预约", "满意，不过有个情况", "五星，整体很好但是等待太久",
    "咨询保养费用", "把车开过来检修", "代客泊车无法使用", "斯皮尔伯格入镜", "商城买的支架晃动", "滚烫的心", "售后回访流程太长", "此邮件来自组织外部，上面的车有维修计划", "路特斯第二天，真的太对味",
    "SEO优化报告", "扎钉子了，需要拖车", "退货", "多次催促没有人理", "保养很好", "试驾回访五星，产品好感度:5星", "", "特别好看", "什么时候到货，家充", "希望尽快处理"]


def sentences(spark, d):
    o = opinion(spark, d).select("id", "opinion_id", "original_text", "v3_l1", "v3_l2", "source")
    said = F.get(F.array(*[F.lit(s) for s in SENTENCES]), F.pmod(F.floor(F.col("id") / 2), F.lit(len(SENTENCES))).cast("int"))
    return o.withColumn("original_text", F.concat(said, F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("\n"), "original_text"))))


def _re2(pattern: str) -> str:
    """The pattern without looking around, which is no part of RE2: what must not stand beside is a character of its own."""
    p = pattern.replace("(?<![滚])烫(?!金|印)", "(?:^|[^滚])烫(?:$|[^金印])").replace("(?<![特])别(?![人特])", "(?:^|[^特])别").replace(r"\u3000", "\u3000")
    return ("(?is)" + p[4:] if p.startswith("(?s)") else "(?i)" + p).replace("'", "''")


def term_sql(t) -> str:
    if isinstance(t, str):
        return f"s_{t}"
    if not t:
        return "true"
    if t[0] == "squeezed":
        return f"z_{t[1]}"
    if t[0] == "max":
        return f"(nn BETWEEN 1 AND {t[1]} AND {term_sql(t[2])})"
    if t[0] == "not":
        return f"(NOT {term_sql(t[1])})"
    return "(" + (" OR " if t[0] == "any" else " AND ").join(map(term_sql, t[1:])) + ")"


TEXT = f"concat(list_extract([{', '.join(repr(s) for s in SENTENCES)}], (id // 2) % {len(SENTENCES)} + 1), CASE WHEN id % 2 = 0 THEN '' ELSE concat(chr(10), original_text) END)"
CAPTURE = f"""tx AS (SELECT id, opinion_id, {q.s(TEXT)} AS t, {q.sq(TEXT)} AS z FROM opinion),
 sg AS (SELECT *, length(z) AS nn, {', '.join(f"regexp_matches(t, '{_re2(p)}') AS s_{n}" for n, p in SIGNALS.items())},
   {', '.join(f"regexp_matches(z, '{_re2(SIGNALS[n])}') AS z_{n}" for n in ('short_intent', 'short_benign'))} FROM tx),
 te AS (SELECT *, {', '.join(f"{term_sql(t)} AS s_{n}" for n, t in TERMS.items())} FROM sg),
 cd AS (SELECT id, opinion_id, CASE WHEN nn = 0 THEN 'empty_text' {' '.join(f"WHEN {term_sql(t)} THEN 'blocked:{n}'" for n, t in BLOCKED)}
   {' '.join(f"WHEN {term_sql(t)} THEN 'eligible:{n}'" for n, t in ELIGIBLE)} ELSE 'no_capture_pattern' END AS capture,
   {' OR '.join(f"({term_sql(t)}{' AND NOT s_v12_followup_negative' if n == 'testdrive_followup' else ''})" for n, t in ELIGIBLE)} AS fits FROM te)"""


@query("capture_default_pack", f"""
WITH {CAPTURE} SELECT opinion_id, capture, fits AND NOT starts_with(capture, 'blocked') AND capture <> 'empty_text' AS capture_ok FROM cd""")
def _(spark, d):
    return C.capture_code(sentences(spark, d), "original_text", default_rules.PACK).select("opinion_id", "capture", "capture_ok")


@query("capture_default_summary", f"WITH {CAPTURE} SELECT capture, count(*) AS n FROM cd GROUP BY 1")
def _(spark, d):
    return C.capture_summary(sentences(spark, d), "original_text", default_rules.PACK)
