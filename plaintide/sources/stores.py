"""Archives, exports and keyed stores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import blank, filled, strip, text
from plaintide.functions.dates import parse_time
from plaintide.functions.meta import json_get, json_text
from plaintide.operators.keyed import pick_per_key
from plaintide.schema import ARCHIVE_COLUMNS, EXPORT_COLUMNS


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def yearly_archive(df: DataFrame, batch: str | None = None) -> DataFrame:
    """Archive projection of reviewed rows."""
    rows = df.filter(labels.is_reviewed())
    if batch:
        rows = rows.filter(F.col("upload_batch") == batch)
    kw = F.coalesce(F.col("model_keyword"), F.lit(""))
    rest = F.when(kw.contains(","), strip(F.regexp_replace(kw, "^[^,]*,", ""))).otherwise("")
    values = (
        F.col("opinion_id"), F.col("original_text"), F.col("source"), F.col("create_time"),
        F.coalesce(F.nullif(F.col("review_l1"), F.lit("")), F.col("model_class")),
        F.coalesce(F.nullif(F.col("review_l2"), F.lit("")), labels.first_keyword("model_keyword")),
        F.coalesce(F.nullif(_optional(df, "extracted_keywords"), F.lit("")), rest),
        F.coalesce(_optional(df, "country"), F.lit("")), F.coalesce(_optional(df, "phone"), F.lit("")),
        F.coalesce(_optional(df, "vin"), F.lit("")), F.coalesce(_optional(df, "car_model"), F.lit("")),
        F.coalesce(F.col("v3_confidence"), _optional(df, "match_score", "double")), F.lit("已复核"),
        F.coalesce(_optional(df, "review_note"), F.lit("未填写")), F.substring("create_time", 1, 4),
        F.substring("create_time", 1, 7), F.coalesce(_optional(df, "reviewer"), F.lit("")),
        F.coalesce(F.col("reviewed_at"), F.lit("")))
    return rows.select(*[v.alias(n) for n, v in zip(ARCHIVE_COLUMNS, values)])


def write_yearly_archive(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Rewrites whole year partitions: with a batch, every year that batch touches is rebuilt
    from all reviewed rows, so a year never shrinks to one batch."""
    full = yearly_archive(df).filter(F.col("年度").rlike(r"^\d{4}$"))
    if batch:
        years = yearly_archive(df, batch).select("年度").distinct()
        full = full.join(years, "年度", "left_semi")
    (full.repartition("年度", F.pmod(F.xxhash64("舆情编号"), F.lit(32))).sortWithinPartitions("舆情时间", "舆情编号")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("年度").parquet(path))


def filtered_export(df: DataFrame, batch: str | None = None, status: int | None = None) -> DataFrame:
    rows = df
    if batch:
        rows = rows.filter(F.col("upload_batch") == batch)
    if status is not None:
        rows = rows.filter(F.col("review_status") == status)
    kinds = {"match_score": "double"}
    return rows.select(*[_optional(df, c, kinds.get(c, "string")).alias(c) for c in EXPORT_COLUMNS]).orderBy(
        F.desc("create_time"), F.desc("opinion_id"))


def clean_rows(df: DataFrame, reviewer: str, stamp: str) -> DataFrame:
    """Reviewed rows in the clean-library shape, with the reason text of the change."""
    l1, l2 = json_text("v3_label_meta", "l1"), json_text("v3_label_meta", "l2")
    conf = F.coalesce(json_get("v3_label_meta", "confidence"), F.lit("0"))
    kws = F.coalesce(_optional(df, "extracted_keywords"), F.lit(""))
    reason = F.concat(F.lit("VOC回流|L1:"), l1, F.lit("→"), text("review_l1"), F.lit(";L2:"), l2, F.lit("→"),
                      text("review_l2"), F.lit(";三级关键词:"), kws, F.lit(f"|复核人:{reviewer or '—'}|{stamp}"))
    return df.select(
        text("opinion_id").alias("舆情编号"), text("original_text").alias("原文"),
        F.coalesce(F.col("create_time"), F.lit("")).alias("日期"), l1.alias("模型分类结果"), conf.alias("置信度"),
        F.coalesce(F.col("model_class"), F.lit("")).alias("人工分类"), F.lit("VOC复核").alias("筛选原因"),
        text("review_l1").alias("人工复核结果"), reason.alias("修正原因"))


def clean_library_rejects(df: DataFrame) -> DataFrame:
    """Rows that may not enter the clean library, with the reason."""
    return df.filter(blank("opinion_id") | blank("review_l1")).select(
        "opinion_id", F.when(blank("opinion_id"), "缺少舆情编号").otherwise("缺少人工一级").alias("error"))


def clean_library_upsert(library: DataFrame, df: DataFrame, reviewer: str, stamp: str,
                         order: str = "id") -> DataFrame:
    """New library snapshot: the same id is overwritten, a new id appended. ``action`` is
    ``insert``, ``overwrite`` or ``keep``. Repeats of an id inside one run: the last one wins."""
    ok = df.filter(filled("opinion_id") & filled("review_l1"))
    last = pick_per_key(ok.withColumn("opinion_id", text("opinion_id")), ["opinion_id"], [F.col(order)])
    fresh = clean_rows(last, reviewer, stamp)
    key = "舆情编号"
    known = library.select(key).distinct().withColumn("_known", F.lit(True))
    merged = fresh.join(known, key, "left").withColumn(
        "action", F.when(F.col("_known"), "overwrite").otherwise("insert")).drop("_known")
    kept = library.join(fresh.select(key), key, "left_anti").withColumn("action", F.lit("keep"))
    return kept.unionByName(merged.select(*library.columns, "action"))


def audit_rows(df: DataFrame, library: DataFrame, reviewer: str, trigger: str, stamp: str) -> DataFrame:
    """Before/after label rows of one reflow run."""
    known = library.select(F.col("舆情编号").alias("opinion_id")).distinct().withColumn("_k", F.lit(True))
    m = "v3_label_meta"
    return (df.filter(filled("opinion_id") & filled("review_l1")).join(known, "opinion_id", "left").select(
        "opinion_id", F.lit(reviewer).alias("reviewer"),
        F.struct(json_text(m, "l1").alias("l1"), json_text(m, "l2").alias("l2"), json_text(m, "l3").alias("l3")).alias("before"),
        F.struct(text("review_l1").alias("l1"), text("review_l2").alias("l2")).alias("after"),
        "upload_batch", F.when(F.col("_k"), "overwrite").otherwise("insert").alias("action"),
        F.lit(trigger).alias("trigger"), F.lit(stamp).alias("ts")))


def append_audit_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_route_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def route_metrics_tail(df: DataFrame, n: int = 500, order: str = "timestamp") -> DataFrame:
    """The ``n`` newest rows, newest first."""
    return df.orderBy(F.desc(order)).limit(n)


def monthly_archive_merge(archive: DataFrame, new: DataFrame, time: str = "create_time",
                          content: str = "original_text") -> DataFrame:
    """Archive with the new rows merged in; the key is (time, content), the newest wins, rows
    whose time does not parse are left out."""
    both = archive.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    ts = parse_time(time)
    timed = both.withColumn("_ts", ts).filter(F.col("_ts").isNotNull()).withColumn("_key", F.md5(content))
    # Generation first, then the feed's line, then the ids, so that no tie is left to chance.
    order = [F.col(c) for c in ("_gen", "_line", "opinion_id", "id") if c in both.columns]
    return (pick_per_key(timed, ["_ts", "_key"], order)
            .withColumn("year", F.year("_ts")).withColumn("month", F.month("_ts"))
            .drop("_gen", "_ts", "_key"))


def write_monthly_archive(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month").parquet(path))


def json_quoted(c: Column | str) -> Column:
    """A string as a JSON literal."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def training_rows(df: DataFrame, instruction: str = "", max_chars: int | None = None) -> DataFrame:
    """Prompt and completion; the completion is JSON with the two human labels. ``max_chars`` shortens the text."""
    body = text("original_text") if max_chars is None else F.substring(text("original_text"), 1, max_chars)
    return df.filter(labels.is_reviewed() & filled("review_l1") & filled("original_text")).select(
        "opinion_id", F.concat(F.lit(instruction), body).alias("prompt"),
        F.concat(F.lit('{"l1": '), json_quoted(text("review_l1")), F.lit(', "l2": '), json_quoted(text("review_l2")),
                 F.lit("}")).alias("completion"))


def write_training_rows(df: DataFrame, path: str) -> None:
    df.select("prompt", "completion").write.mode("overwrite").json(path)


def upsert_vectors(store: DataFrame, new: DataFrame, key: str = "opinion_id") -> DataFrame:
    """One vector per id, the newest update wins."""
    both = store.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return pick_per_key(both, [key], [F.col("_gen"), F.col("updated_at")]).drop("_gen")


def read_vectors(store: DataFrame, model: str | None = None, ids: DataFrame | None = None,
                 key: str = "opinion_id") -> DataFrame:
    out = store.filter(F.col("model") == model) if model else store
    return out.join(ids.select(key), key, "left_semi") if ids is not None else out


def week_label(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "")


def keep_weekly_reports(reports: DataFrame, keep: int = 12) -> DataFrame:
    """One report per cleaned week label, the newest ``keep`` of them."""
    clean = reports.withColumn("week", week_label(F.col("week"))).filter(F.col("week") != "")
    return pick_per_key(clean, ["week"], [F.col("saved_at")]).orderBy(F.desc("saved_at"), F.desc("week")).limit(keep)


def write_weekly_reports(reports: DataFrame, path: str, keep: int = 12) -> None:
    """Snapshot of the kept weeks, one partition per week."""
    keep_weekly_reports(reports, keep).write.mode("overwrite").partitionBy("week").json(path)


def list_weekly_reports(reports: DataFrame, keep: int = 12) -> DataFrame:
    total = F.coalesce(json_get("body", "total"), F.get_json_object("body", "$.volume.total"), F.lit("?"))
    return (keep_weekly_reports(reports, keep)
            .select("week", total.alias("total"),
                    F.substring(F.coalesce(json_get("body", "summary"), F.lit("")), 1, 100).alias("summary"), "saved_at")
            .orderBy(F.desc("saved_at")))
