"""Review-desk filters, time windows, sampling and paging."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import all_of, filled
from plaintide.functions.dates import event_time, region_bucket, report_event_day
from plaintide.functions.text import preview
from plaintide.operators.paging import By, page_rows
from plaintide.schema import LOW_CONFIDENCE_BELOW


def pending_condition(confidence: Column | None = None) -> Column:
    """Low-confidence rows, or unreviewed rows under the threshold."""
    c = confidence if confidence is not None else labels.effective_confidence()
    return (F.col("review_status") == 2) | ((F.col("review_status") != 1) & (c < LOW_CONFIDENCE_BELOW))


def mismatch_condition(kind: str) -> Column:
    status = F.col("review_status")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    if kind == "l1_disagree":
        return status.isin(0, 2) & has("model_class") & has("v3_l1") & (F.col("v3_l1") != F.col("model_class"))
    if kind == "l2_disagree":
        return (status.isin(0, 2) & has("v3_l1") & has("model_keyword")
                & (F.col("v3_l2") != labels.first_keyword("model_keyword")))
    if kind in ("human_fixed_l1", "human_fixed_l2"):
        lv = kind[-2:]
        return (status == 1) & has(f"review_{lv}") & has(f"v3_{lv}") & (F.col(f"v3_{lv}") != F.col(f"review_{lv}"))
    raise ValueError(f"unknown mismatch filter {kind!r}")


def review_conditions(search: str = "", status: int | None = None, batch: str | None = None,
                      source: str = "", year: str = "", day_from: str = "", day_to: str = "",
                      l1: str = "", l2: str = "", l3: str = "", conf_min: float | None = None,
                      conf_max: float | None = None, family: str = "", pending_only: bool = False,
                      mismatch: str = "", confidence: Column | None = None) -> list[Column]:
    conf = confidence if confidence is not None else labels.effective_confidence()
    day = report_event_day("create_time")
    out: list[Column] = []
    if search:
        out.append(F.coalesce(F.col("original_text").ilike(f"%{search}%") | F.col("source").ilike(f"%{search}%")
                              | F.col("model_keyword").ilike(f"%{search}%")
                              | F.col("opinion_id").ilike(f"%{search}%"), F.lit(False)))
    if status is not None:
        out.append(F.col("review_status") == status)
    if batch:
        out.append(F.col("upload_batch") == batch)
    if source:
        out.append(F.col("source").ilike(f"%{source}%"))
    if len(year) == 4:
        out.append(F.substring("create_time", 1, 4) == year)
    if day_from:
        out.append(day >= day_from)
    if day_to:
        out.append((day != "") & (day <= day_to))
    if l1.strip():
        names = labels.l1_filter_variants(l1)
        out.append(F.coalesce(F.col("review_l1").isin(names), F.lit(False))
                   | F.coalesce(F.col("v3_l1").isin(names), F.lit(False)))
    if l2.strip():
        out.append(F.coalesce(F.col("review_l2") == l2.strip(), F.lit(False))
                   | F.coalesce(F.col("v3_l2") == l2.strip(), F.lit(False)))
    if l3:
        out.append(F.coalesce(F.col("v3_l3"), F.lit("")).ilike(f"%{l3}%"))
    if conf_min is not None:
        out.append(conf >= conf_min)
    if conf_max is not None:
        out.append(conf <= conf_max)
    if family:
        out.append(labels.match_family() == family)
    if pending_only:
        out.append(pending_condition(conf))
    if mismatch:
        out.append(mismatch_condition(mismatch))
    return out


def review_rows(df: DataFrame, ids: DataFrame | None = None, **conditions) -> DataFrame:
    out = df.filter(all_of(review_conditions(**conditions)))
    return out.join(ids.select("opinion_id").distinct(), "opinion_id", "left_semi") if ids is not None else out


def review_list(df: DataFrame, page: int = 1, size: int = 20, preview_chars: int = 420,
                ids: DataFrame | None = None, **conditions) -> DataFrame:
    """One page, newest first, with the total over all pages on each row. Rows are counted by ranges of their time, and only
    the page's own range is sorted (see ``page_rows``)."""
    rows = review_rows(df, ids, **conditions)
    short, cut = preview("original_text", preview_chars)
    order = [By("create_time", True, (4, 7, 10, 13, 16, 19)), By("opinion_id", True), By("id", True)]
    got, total = page_rows(rows, order, max(1, page), max(1, size))
    return (got.select("opinion_id", "source", "create_time", "upload_batch", "review_status", "review_l1", "review_l2",
                    "v3_l1", "v3_l2", short.alias("original_text"), cut.alias("original_text_truncated"),
                    labels.list_canonical_l1().alias("canonical_l1"), F.lit(total).cast("long").alias("total")))


def report_window(df: DataFrame, day_from: str, day_to: str, region: str = "all") -> DataFrame:
    """Rows whose report day lies in the window, with ``day`` and ``month_key`` added."""
    out = df.withColumn("day", report_event_day()).filter(
        (F.col("day") != "") & F.col("day").between(day_from[:10], day_to[:10]))
    if region in ("cn", "rest"):
        out = out.filter(region_bucket() == region)
    return out.withColumn("month_key", F.substring("day", 1, 7))


def since_days(df: DataFrame, days: int, as_of: dt.date) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; rows without a time drop out."""
    cut = F.lit(dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days))
    return df.filter(event_time() >= cut)


def since_days_counts(df: DataFrame, days: int, as_of: dt.date) -> DataFrame:
    cut = F.lit(dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days))
    t = event_time()
    return df.agg(F.count_if(t >= cut).alias("kept"), F.count_if(t < cut).alias("too_old"),
                  F.count_if(t.isNull()).alias("skipped_no_time"))


def split_windows(df: DataFrame, days: int, time: str = "event_ts") -> DataFrame:
    """``window`` is ``current`` (the N days that end at the newest row, its time of day kept, and
    rows without a time), ``previous`` (the N days before), or NULL."""
    newest = df.agg(F.max(time).alias("m")).scalar()
    t, n = F.col(time), max(days, 1)
    cut = newest - F.make_dt_interval(F.lit(n - 1))
    return df.withColumn("window", F.when(t.isNull() | (t >= cut), "current")
                         .when(t >= cut - F.make_dt_interval(F.lit(n)), "previous"))


def sample_priority_rows(df: DataFrame, n: int = 3000) -> DataFrame:
    """Newest rows, those with an L3 first, then those whose JSON names one."""
    meta = F.coalesce(F.col("v3_label_meta"), F.lit(""))
    named = meta.contains('"l3":') & ~meta.contains('"l3": ""') & ~meta.contains('"l3":""')
    rank = F.when(filled("v3_l3") | filled("review_l3"), 0).when(named, 1).otherwise(2)
    return df.filter(filled("original_text")).withColumn("sample_rank", rank).orderBy(
        "sample_rank", F.desc("id")).limit(n)


def drop_batch_duplicates(df: DataFrame, batch: str) -> DataFrame:
    """Keeps the lowest row id per opinion of a batch, if the whole batch is reviewed; else the
    table is returned unchanged. The guard is a scalar subquery, so nothing runs eagerly."""
    mine = F.coalesce(F.col("upload_batch") == batch, F.lit(False))
    open_rows = df.filter(mine & (F.col("review_status") != 1)).agg(F.count(F.lit(1)).alias("n")).scalar()
    firsts = df.filter(mine).groupBy("opinion_id").agg(F.min("id").alias("id"))
    keep = firsts.select("id", F.lit(True).alias("_keep"))
    return (df.join(keep, "id", "left")
            .filter(~mine | F.col("_keep").isNotNull() | (open_rows > 0)).drop("_keep"))
