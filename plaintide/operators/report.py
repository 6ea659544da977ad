"""Counts, trends and distributions for dashboards and monthly reports."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaintide.functions import labels
from plaintide.functions.common import count_when, filled, first_filled, pct, strip
from plaintide.functions.dates import iso_day, iso_event_day, report_event_day, stats_day
from plaintide.functions.meta import json_get
from plaintide.functions.text import phrases, scrub
from plaintide.operators.filters import report_window
from plaintide.packs import labels as lp


def _both_l1() -> Column:
    return labels.is_reviewed() & filled("review_l1") & filled("v3_l1")


def _raw_match() -> Column:
    return strip("review_l1") == strip("v3_l1")


def kpi_snapshot(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Totals, pending (NULL counts as pending), rows of the last week, raw L1 accuracy."""
    new = iso_day("create_time") >= F.lit(as_of - dt.timedelta(days=7))
    return df.agg(
        F.count(F.lit(1)).alias("total"), count_when(labels.is_reviewed()).alias("reviewed"),
        count_when(~labels.is_reviewed()).alias("pending"), count_when(new).alias("new_7d"),
        count_when(_both_l1() & _raw_match()).alias("l1_correct"), count_when(_both_l1()).alias("l1_total"),
    ).withColumn("l1_accuracy", F.round(F.col("l1_correct") / F.greatest("l1_total", F.lit(1)) * 100, 2))


def l2_anomalies(df: DataFrame, as_of: dt.date, days: int = 7, min_count: int = 5, factor: float = 1.5,
                 top: int = 5) -> DataFrame:
    """L2 whose newest period of N days runs at least ``factor`` times the mean of the four before.

    One pass: each row falls into period 0..4 by integer division of its age, so no per-period
    scan and no join against periods.
    """
    age = F.datediff(F.lit(as_of), iso_event_day())
    rows = (df.filter(labels.is_reviewed() & filled("review_l2"))
            .withColumns({"l2": strip("review_l2"), "period": F.floor(age / days).cast("int")})
            .filter((age >= 0) & F.col("period").between(0, 4)))
    counts = rows.groupBy("l2").agg(count_when(F.col("period") == 0).alias("current"),
                                    (count_when(F.col("period") > 0) / 4.0).alias("avg"))
    hot = (counts.filter((F.col("current") >= min_count) & (F.col("avg") > 0)
                         & (F.col("current") >= F.col("avg") * factor))
           .withColumn("pct_change", F.round((F.col("current") - F.col("avg")) / F.greatest("avg", F.lit(1.0)) * 100, 1))
           .orderBy(F.desc("pct_change"), F.desc("current"), F.asc("l2")).limit(top))
    kw = F.col("extracted_keywords") if "extracted_keywords" in df.columns else F.lit("")
    said = (rows.filter(F.col("period") == 0).select("l2", F.explode(phrases("v3_label_meta", kw)).alias("phrase"))
            .groupBy("l2", "phrase").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("l2").orderBy(F.desc("n"), F.asc("phrase"))
    best = (said.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 3)
            .groupBy("l2").agg(F.array_sort(F.collect_list(F.struct("rn", "phrase", "n"))).alias("p")))
    return (hot.join(best, "l2", "left").select(
        "l2", "current", F.round("avg", 1).alias("avg_4p"), "pct_change",
        F.concat_ws("|", F.transform("p", lambda x: F.concat_ws(":", x["phrase"], x["n"].cast("string")))).alias("phrases")))


def day_spine(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def month_spine(spark: SparkSession, day_from: str, day_to: str) -> DataFrame:
    """Every month of the window as YYYY-MM; one row per month, so always a tiny table."""
    first, last = (F.to_date(F.lit(x[:7] + "-01")) for x in (day_from, day_to))
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))).alias("month_key"))


def daily_accuracy_trend(df: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Accuracy and reviewed count per day over a dense axis."""
    days = max(1, days)
    first = as_of - dt.timedelta(days=days - 1)
    per_day = (df.filter(_both_l1()).withColumn("day", iso_event_day())
               .filter(F.col("day").between(F.lit(first), F.lit(as_of)))
               .groupBy("day").agg(F.count(F.lit(1)).alias("n"), count_when(_raw_match()).alias("ok")))
    return (day_spine(df.sparkSession, first, as_of).join(per_day, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("full_date"), F.date_format("day", "MM-dd").alias("date"),
        F.round(F.coalesce(F.col("ok"), F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) * 100, 2).alias("accuracy"),
        F.coalesce("n", F.lit(0)).alias("reviewed_count")))


def issue_status_by_l2(df: DataFrame, batch: str | None = None, top: int = 20) -> DataFrame:
    rows = df.filter(filled("review_l2"))
    if batch:
        rows = rows.filter(F.col("upload_batch") == batch)
    sync = F.coalesce("reflow_synced", F.lit(0))
    return (rows.groupBy(F.col("review_l2").alias("l2")).agg(
        F.count(F.lit(1)).alias("total"), count_when(sync >= 1).alias("resolved"),
        count_when((F.col("review_status") == 1) & (sync < 1)).alias("in_progress"),
        count_when(F.coalesce("review_status", F.lit(0)) != 1).alias("pending"))
        .orderBy(F.desc("total"), F.asc("l2")).limit(top))


def _judged(df: DataFrame, l1: Column, l2: Column) -> DataFrame:
    """Canonical human and model labels (h1, h2, m1, m2)."""
    base = df.withColumns({"_m1": l1, "_m2": l2})
    m1, m2 = labels.strip_non_issue("_m1", "_m2")
    h1, h2 = labels.strip_non_issue("review_l1", "review_l2")
    return base.withColumns({"h1": h1, "h2": h2, "m1": m1, "m2": m2}).drop("_m1", "_m2")


def classification_accuracy(df: DataFrame) -> DataFrame:
    """L1 accuracy over rows with both labels; L2 only inside an agreed business class."""
    r = _judged(df.filter(labels.is_reviewed() & filled("review_l1")), *labels.stored_model_labels())
    l1 = F.col("m1") != ""
    l2 = F.col("h1").isin(*lp.BUSINESS_L1) & (F.col("m1") == F.col("h1")) & (F.col("h2") != "") & (F.col("m2") != "")
    out = r.agg(count_when(l1).alias("l1_total"), count_when(l1 & (F.col("m1") == F.col("h1"))).alias("l1_correct"),
                count_when(l2).alias("l2_total"), count_when(l2 & (F.col("h2") == F.col("m2"))).alias("l2_correct"))
    return out.withColumns({"l1_accuracy": pct(F.col("l1_correct"), F.col("l1_total")),
                            "l2_accuracy": pct(F.col("l2_correct"), F.col("l2_total"))})


def dashboard_stats(df: DataFrame, as_of: dt.date) -> DataFrame:
    """All dashboard figures in one scan as (metric, item, value) rows.

    Every row yields its day, class and L2 cells; one GROUPING SETS aggregate counts them
    together with the totals, so the table is read and shuffled once.
    """
    conf = F.coalesce(F.col("v3_confidence"), F.col("match_score") if "match_score" in df.columns else F.lit(None),
                      json_get("v3_label_meta", "confidence").try_cast("double"))
    leap = as_of.month == 2 and as_of.day == 29
    cutoff = (dt.date(as_of.year - 2, 3, 1) if leap else as_of.replace(year=as_of.year - 2)).isoformat()
    r = _judged(df.filter(report_event_day("create_time") >= cutoff), *labels.stored_model_labels())
    shown1, shown2 = first_filled("h1", "m1"), first_filled("h2", "m2")
    st, day = F.col("review_status"), stats_day("create_time", "reviewed_at", "created_at")
    flat = r.select(
        shown1.alias("l1"), shown2.alias("l2"), day.alias("day"),
        labels.is_reviewed().cast("int").alias("rev"),
        (F.coalesce("reflow_synced", F.lit(0)) >= 2).cast("int").alias("arch"),
        F.coalesce((st == 2) | ((st != 1) & (conf < 0.52)), F.lit(False)).cast("int").alias("pend"),
        (labels.is_reviewed() & (F.col("h1") != "") & (F.col("m1") != "")).cast("int").alias("e1"),
        (labels.is_reviewed() & F.col("h1").isin(*lp.BUSINESS_L1) & (F.col("h1") == F.col("m1"))
         & (F.col("h2") != "") & (F.col("m2") != "")).cast("int").alias("e2"),
        (F.col("h1") == F.col("m1")).cast("int").alias("s1"), (F.col("h2") == F.col("m2")).cast("int").alias("s2"))
    first30 = (as_of - dt.timedelta(days=29)).isoformat()
    first7 = (as_of - dt.timedelta(days=6)).isoformat()
    prod = lambda a, b: F.sum(F.col(a) * F.col(b))
    cube = flat.groupingSets([[], ["l1"], ["l2"], ["day"]], "l1", "l2", "day").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("rev", "arch", "pend", "e1", "e2")],
        prod("e1", "s1").alias("ok1"), prod("e2", "s2").alias("ok2"))
    last = as_of.isoformat()
    total = cube.filter("g = 7").selectExpr(
        "stack(8, 'total', n, 'reviewed_count', rev, 'archived_count', arch, 'pending_review', pend, "
        "'l1_eval_count', e1, 'l2_eval_count', e2, 'l1_correct', ok1, 'l2_correct', ok2) as (item, value)")
    pie = cube.filter("g = 3 and l1 <> ''").select(F.lit("l1_pie").alias("metric"), F.col("l1").alias("item"), F.col("n").alias("value"))
    top5 = (cube.filter("g = 5 and l2 <> ''").orderBy(F.desc("n"), F.asc("l2")).limit(5)
            .select(F.lit("l2_top5").alias("metric"), F.col("l2").alias("item"), F.col("n").alias("value")))
    spine = day_spine(df.sparkSession, as_of - dt.timedelta(days=29), as_of).select(F.date_format("day", "yyyy-MM-dd").alias("item"))
    per_day = cube.filter(f"g = 6 and day between '{first30}' and '{last}'").select(F.col("day").alias("item"), F.col("n").alias("value"))
    trend = spine.join(per_day, "item", "left").select(F.lit("trend_30d").alias("metric"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    week = per_day.filter(F.col("item") >= first7).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit("total").alias("metric"), F.lit("new_7d").alias("item"), "value")
    return (total.select(F.lit("total").alias("metric"), "item", F.col("value").cast("bigint").alias("value"))
            .unionByName(pie).unionByName(top5).unionByName(trend).unionByName(week))


def class_share(df: DataFrame, label: Column | None = None) -> DataFrame:
    """Old-class counts and their share of all reviewed rows."""
    lab = label if label is not None else F.col("review_note")
    rev = df.filter(labels.is_reviewed())
    total = rev.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (rev.select(lab.alias("class_name")).filter(F.col("class_name").isin(*lp.LEGACY_CLASSES))
            .groupBy("class_name").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("percentage", pct(F.col("count"), total)))


def yearly_summary(df: DataFrame, year: str = "", month: str = "") -> DataFrame:
    r = df.filter(labels.is_reviewed()).withColumns({
        "year": F.substring("create_time", 1, 4), "year_month": F.substring("create_time", 1, 7)})
    if len(year) == 4:
        r = r.filter(F.col("year") == year)
    if len(month) == 7:
        r = r.filter(F.col("year_month") == month)
    note = F.coalesce(F.col("review_note"), F.lit("未填写")) if "review_note" in df.columns else F.lit("未填写")
    return r.groupBy("year", "year_month", "review_status", note.alias("review_note")).agg(
        F.count(F.lit(1)).alias("count"), F.max("create_time").alias("latest_time"))


def upload_batches(df: DataFrame) -> DataFrame:
    return (df.filter(filled("upload_batch")).groupBy("upload_batch")
            .agg(F.count(F.lit(1)).alias("count"), F.max("id").alias("sort_max_id"))
            .orderBy(F.desc("sort_max_id")))


def labelled_window(df: DataFrame, day_from: str, day_to: str, region: str = "all") -> DataFrame:
    """Report rows of a window with their effective labels."""
    l1, l2 = labels.report_labels()
    return report_window(df, day_from, day_to, region).withColumns({"l1": l1, "l2": l2})


def monthly_overview(df: DataFrame, day_from: str, day_to: str, region: str = "all",
                     classes=(lp.PRODUCT, lp.SERVICE)) -> DataFrame:
    """Rows per month for two classes over a dense month axis."""
    counts = labelled_window(df, day_from, day_to, region).groupBy("month_key").agg(
        *[count_when(F.col("l1") == c).alias(f"c{i}") for i, c in enumerate(classes)])
    return month_spine(df.sparkSession, day_from, day_to).join(counts, "month_key", "left").select(
        "month_key", *[F.coalesce(f"c{i}", F.lit(0)).alias(n) for i, n in enumerate(("product", "service"))])


def report_cube(df: DataFrame, day_from: str, day_to: str, region: str = "all") -> DataFrame:
    """The five count tables of the reports from one scan."""
    rows = labelled_window(df, day_from, day_to, region).select("month_key", "l1", "l2")
    sets = {1: ["month_key", "l1"], 0: ["month_key", "l1", "l2"], 4: ["l1", "l2"], 2: ["month_key", "l2"], 6: ["l2"]}
    names = {1: "month_l1", 0: "month_l1_l2", 4: "l1_l2", 2: "month_l2", 6: "l2"}
    cube = rows.groupingSets(list(sets.values()), "month_key", "l1", "l2").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    level = F.lit(None).cast("string")
    for g, name in names.items():
        level = F.when(F.col("g") == g, name).otherwise(level)
    named = lambda c: F.col(c).isNull() | (F.col(c) != "")
    return cube.filter(named("l1") & named("l2")).select(level.alias("level"), "month_key", "l1", "l2", "n")


def nth_subtag_trend(df: DataFrame, day_from: str, day_to: str, region: str = "all", k: int = 1,
                     classes=(lp.PRODUCT, lp.SERVICE), placeholder: str = "(无二级)") -> DataFrame:
    """Per class, the month counts of its k-th most frequent L2."""
    k = max(1, k)
    # Unwanted cells leave by a zero count; a filter on the derived labels would repeat them below.
    wanted = F.col("l1").isin(*classes) & (F.col("l2") != "")
    cells = (labelled_window(df, day_from, day_to, region).groupBy("l1", "l2", "month_key")
             .agg(count_when(wanted).alias("n")).filter(F.col("n") > 0))
    totals = cells.groupBy("l1", "l2").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("l1").orderBy(F.desc("total"), F.asc("l2"))
    ranked = totals.withColumn("rn", F.row_number().over(w)).filter(F.col("rn").isin(1, k))
    tag = ranked.groupBy("l1").agg(F.max_by("l2", "rn").alias("l2_tag"))
    spine = month_spine(df.sparkSession, day_from, day_to).select(
        "month_key", F.explode(F.array(*[F.lit(c) for c in classes])).alias("l1"))
    axis = spine.join(tag, "l1", "left")
    return (axis.join(cells.withColumnRenamed("l2", "l2_tag"), ["l1", "l2_tag", "month_key"], "left")
            .select("l1", F.coalesce("l2_tag", F.lit(placeholder)).alias("l2_tag"), "month_key",
                    F.coalesce("n", F.lit(0)).alias("n")))


def top_subtag_monthly(df: DataFrame, day_from: str, day_to: str, region: str = "all", top: int = 8) -> DataFrame:
    """Month counts of the overall most frequent L2."""
    top = max(1, top)
    cells = (labelled_window(df, day_from, day_to, region).groupBy("l2", "month_key")
             .agg(count_when(F.col("l2") != "").alias("n")).filter(F.col("n") > 0))
    best = cells.groupBy("l2").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), F.asc("l2")).limit(top)
    months = F.array_sort(F.collect_list("month_key"))
    spine = month_spine(df.sparkSession, day_from, day_to).agg(months.alias("m")).scalar()
    axis = best.withColumn("month_key", F.explode(spine))
    return axis.join(cells, ["l2", "month_key"], "left").select(
        "l2", "total", "month_key", F.coalesce("n", F.lit(0)).alias("n"))


def single_issue_trend(df: DataFrame, day_from: str, day_to: str, region: str = "all", l1: str = "", l2: str = "",
                       keyword: str = "") -> DataFrame:
    """Rows per month that match a class, an L2 and a keyword found in any of five columns."""
    rows = labelled_window(df, day_from, day_to, region)
    name = l1.strip()
    if name:
        canon = lp.SERVICE if name in ("销售服务类", "销售服务", "营销服务类") else labels.canonicalize_l1(F.lit(name))
        rows = rows.filter(F.col("l1") == canon)
    if l2.strip():
        rows = rows.filter(F.col("l2") == l2.strip())
    kw = keyword.strip().lower()
    if kw:
        cols = [c for c in ("original_text", "extracted_keywords", "review_note", "review_l3", "model_keyword")
                if c in df.columns]
        rows = rows.filter(F.lower(F.concat_ws(" ", *cols)).contains(kw))
    counts = rows.groupBy("month_key").agg(F.count(F.lit(1)).alias("n"))
    return month_spine(df.sparkSession, day_from, day_to).join(counts, "month_key", "left").select(
        "month_key", F.coalesce("n", F.lit(0)).alias("n"))


def summary_l1() -> Column:
    return first_filled(F.coalesce(F.nullif("review_l1", F.lit("")), F.col("model_class")))


def summary_l2() -> Column:
    return labels.first_keyword(F.coalesce(F.nullif("review_l2", F.lit("")), F.col("model_keyword")))


def volume_stats(current: DataFrame, previous: DataFrame, top: int = 10) -> DataFrame:
    """(metric, item, count, share) rows: totals, change against the previous period, L1, top L2."""
    base = current.select(summary_l1().alias("l1"), summary_l2().alias("l2"))
    total = current.agg(F.count(F.lit(1)).alias("n")).scalar()
    prev = previous.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = current.sparkSession.range(1).select(
        F.lit("total").alias("metric"), F.lit("total").alias("item"), total.alias("count"),
        F.when(prev > 0, F.round((total - prev) / F.greatest(prev, F.lit(1)) * 100, 1)).otherwise(0.0).alias("share"))

    def cells(c: str, metric: str) -> DataFrame:
        return base.filter(F.col(c) != "").groupBy(F.col(c).alias("item")).agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(metric).alias("metric"), "item", "count",
            F.round(F.col("count") / F.greatest(total, F.lit(1)) * 100, 1).alias("share"))
    best = cells("l2", "top_l2").orderBy(F.desc("count"), F.asc("item")).limit(top)
    return head.unionByName(cells("l1", "by_l1")).unionByName(best)


def l1_trends(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change per class against the previous period, over the union of the classes."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.select(summary_l1().alias("l1")).filter(F.col("l1") != "").groupBy("l1").agg(F.count(F.lit(1)).alias(name))
    j = counts(current, "cur").join(counts(previous, "prev"), "l1", "full").select(
        "l1", F.coalesce("cur", F.lit(0)).alias("cur"), F.coalesce("prev", F.lit(0)).alias("prev"))
    j = j.withColumn("change_pct", F.when(F.col("prev") > 0, F.round((F.col("cur") - F.col("prev")) / F.col("prev") * 100, 1))
                     .when(F.col("cur") > 0, 100.0).otherwise(0.0))
    return j.withColumn("direction", F.when(F.col("change_pct") > 5, "up").when(F.col("change_pct") < -5, "down").otherwise("flat"))


# Words that make a quote telling.
QUOTE_SIGNALS = ("不满", "投诉", "故障", "垃圾", "太差", "受不了", "无法", "希望", "建议", "要求", "再也不")


def representative_quotes(df: DataFrame, signals=QUOTE_SIGNALS, n_l2: int = 3, lo: int = 20, hi: int = 250) -> DataFrame:
    """Best quote of each of the most frequent L2: two points per signal word plus length/50 up to
    three, shorter first on a tie, scrubbed; a text is used for one L2 only.

    Candidates of each L2 shrink to its few best by a max aggregate over distinct scrubbed texts;
    a later L2 only ever has to skip the quotes of the L2 before it, so ``n_l2`` candidates suffice.
    """
    from plaintide.functions.common import top_rows

    base = df.select("id", summary_l2().alias("l2"), "source", summary_l1().alias("l1"), strip("original_text").alias("t")).filter(F.col("l2") != "")
    totals = base.groupBy("l2").agg(F.count(F.lit(1)).alias("count"))
    best = totals.orderBy(F.desc("count"), F.asc("l2")).limit(n_l2)
    cand = base.filter(F.length("t").between(lo, hi)).join(F.broadcast(best), "l2").withColumn("quote", scrub("t"))
    score = sum([F.when(F.col("quote").contains(w), 2).otherwise(0) for w in signals], F.lit(0)) + F.least(
        F.length("quote") / 50, F.lit(3.0))
    cand = cand.withColumns({"score": score, "len": F.length("t")})
    uniq = cand.groupBy("l2", "count", "quote").agg(
        F.max("score").alias("score"), F.min("len").alias("len"), F.min("id").alias("id"), F.min_by("l1", "id").alias("l1"), F.min_by("source", "id").alias("source"))
    few = top_rows(uniq, ["l2", "count"], [F.desc("score"), F.asc("len"), F.asc("id")], n_l2, salt_by=["quote"])
    # At most n_l2 * n_l2 rows remain; choose in order of L2 rank, skipping used texts.
    rows = few.groupBy("l2", "count").agg(F.array_sort(F.collect_list(F.struct("rn", "quote", "l1", "source"))).alias("c"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col("l2"), F.col("count"), F.col("c")))).alias("g"))
    empty = F.array().cast("array<struct<issue:string,count:bigint,quote:string,l1:string,source:string>>")

    def step(acc, g):
        used = F.transform(acc, lambda a: a["quote"])
        free = F.filter(g["c"], lambda x: ~F.array_contains(used, x["quote"]))
        pick = F.try_element_at(free, F.lit(1))
        row = F.struct(g["l2"].alias("issue"), g["count"].alias("count"), pick["quote"].alias("quote"),
                       pick["l1"].alias("l1"), pick["source"].alias("source"))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(row))).otherwise(acc)
    return ordered.select(F.explode(F.aggregate("g", empty, step)).alias("q")).select(
        "q.issue", "q.count", F.substring("q.quote", 1, 200).alias("quote"), "q.l1", "q.source")


def batch_status(df: DataFrame) -> DataFrame:
    """Completeness and raw L1 accuracy of every batch."""
    out = df.filter(filled("upload_batch")).groupBy("upload_batch").agg(
        F.count(F.lit(1)).alias("batch_total"), count_when(labels.is_reviewed()).alias("confirmed"),
        count_when(_both_l1()).alias("acc_total"), count_when(_both_l1() & _raw_match()).alias("acc_correct"))
    return out.withColumns({
        "unconfirmed": F.col("batch_total") - F.col("confirmed"),
        "is_complete": F.col("batch_total") == F.col("confirmed"),
        "accuracy_l1_pct": F.round(F.col("acc_correct") / F.greatest("acc_total", F.lit(1)) * 100, 2)})


def batch_readiness(df: DataFrame) -> DataFrame:
    from plaintide.operators.review import readiness
    return readiness(df).groupBy("upload_batch", "state").agg(F.count(F.lit(1)).alias("n"))


def reflow_health(df: DataFrame, as_of: dt.datetime, stale_hours: int = 24, queue: int = 0, failure_log: int = 0,
                  warn_failures: int = 0, warn_stale: int = 0, warn_queue: int = 50, warn_log: int = 20) -> DataFrame:
    """State counts and the list of issues over their limits."""
    cut = F.lit((as_of - dt.timedelta(hours=stale_hours)).strftime("%Y-%m-%d %H:%M:%S"))
    sync, rev = F.col("reflow_synced"), labels.is_reviewed()
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), count_when(rev).alias("reviewed"),
                 count_when((sync == 0) & rev).alias("not_reflowed"), count_when(sync == 1).alias("reflowed"),
                 count_when(sync == 2).alias("archived"), count_when(sync == -1).alias("failed"),
                 count_when((sync == 0) & rev & filled("reviewed_at") & (F.col("reviewed_at") < cut)).alias("stale"))
    issue = lambda name, value, limit: F.when(value > limit, F.lit(name))
    return out.withColumn("issues", F.concat_ws(",", issue("failed", F.col("failed"), warn_failures),
                                                issue("stale", F.col("stale"), warn_stale),
                                                issue("queue", F.lit(queue), warn_queue),
                                                issue("failure_log", F.lit(failure_log), warn_log)))


def daily_threshold_alerts(df: DataFrame, label: str, day: Column, as_of: dt.date, limit: int = 100) -> DataFrame:
    return (df.filter(day == F.lit(as_of)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= limit) & (F.col("label") != "")))


def archive_statistics(current: DataFrame, archive: DataFrame, classes=lp.LEGACY_CLASSES) -> DataFrame:
    """Totals and accuracy over current and archived rows; the manual label wins over the final one."""
    both = current.unionByName(archive, allowMissingColumns=True)
    manual = F.coalesce(F.col("manual_class").isin(*classes), F.lit(False))
    final = F.coalesce(F.col("final_class").isin(*classes), F.lit(False))
    ok = F.when(manual, F.col("model_class") == F.col("manual_class")).otherwise(final & (F.col("model_class") == F.col("final_class")))
    out = both.agg(F.count(F.lit(1)).alias("total"), count_when(F.col("review_status") == 1).alias("reviewed"),
                   count_when(F.coalesce(F.col("review_status"), F.lit(0)) != 1).alias("pending"),
                   count_when(F.col("confidence") < 0.52).alias("low_confidence"), count_when(ok).alias("correct"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.greatest("total", F.lit(1)) * 100, 2))


def time_class_counts(df: DataFrame, label: str, day: Column, grain: str) -> DataFrame:
    from plaintide.functions.dates import time_bucket
    return (df.select(time_bucket(day, grain).alias("bucket"), F.col(label).alias("label"))
            .filter(F.col("bucket").isNotNull() & (F.coalesce("label", F.lit("")) != ""))
            .groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")))
