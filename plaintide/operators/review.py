"""Review decisions and the reflow state that follows from them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import filled, first_filled, strip, text
from plaintide.functions.meta import json_text
from plaintide.operators.keywords import keyword_text
from plaintide.packs import labels as lp

_NEW = "_d_"


def _incoming(decisions: DataFrame, cols: tuple[str, ...], marker: str = "_hit") -> DataFrame:
    picked = [F.col(c).alias(_NEW + c) if c in decisions.columns else F.lit(None).cast("string").alias(_NEW + c)
              for c in cols]
    return decisions.select("opinion_id", *picked, F.lit(True).alias(marker))


def apply_reviews(table: DataFrame, decisions: DataFrame, reviewer: str, stamp: str,
                  draft: bool = False) -> DataFrame:
    """Merges review decisions (one row per id).

    L1 comes from the decision, the stored human label or the model, in this order; without any
    the row is left alone. ``applied`` marks written rows, ``to_reflow`` those whose labels
    changed. The draft form skips rows that are reviewed already and also reads the stored model
    columns.
    """
    cols = ("review_l1", "review_l2", "review_note")
    j = table.join(_incoming(decisions, cols), "opinion_id", "left")
    model = (lambda k: F.coalesce(F.nullif(strip(f"v3_{k}"), F.lit("")), json_text("v3_label_meta", k))) if draft \
        else (lambda k: json_text("v3_label_meta", k))
    j = j.withColumns({"_r1": first_filled(_NEW + "review_l1", "review_l1", model("l1")),
                       "_r2": first_filled(_NEW + "review_l2", "review_l2", model("l2"))})
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("_r1") != "")
    if draft:
        hit = hit & ~labels.is_reviewed()
    j = j.withColumns({"applied": hit, "_n1": labels.canonical_or_blank("_r1")})
    j = j.withColumn("_n2", F.when(F.col("_n1") == lp.NON_ISSUE, "").otherwise(F.col("_r2")))
    changed = (F.col("_n1") != text("review_l1")) | (F.col("_n2") != text("review_l2"))
    marked = j.withColumn("to_reflow", F.col("applied") & changed)
    # Only touched rows have their keywords computed again.
    words = keyword_text(marked.filter("applied").select("id", "original_text"), "id", "original_text")
    marked = marked.join(words.withColumnRenamed("extracted_keywords", "_kw"), "id", "left")

    def put(value: Column, old: str) -> Column:
        current = F.col(old) if old in table.columns else F.lit(None).cast("string")
        return F.when(F.col("applied"), value).otherwise(current)
    sync = F.when(F.col("to_reflow"), F.lit(0)).otherwise(F.coalesce("reflow_synced", F.lit(0)))
    note = F.coalesce(_NEW + "review_note", F.col("review_note") if "review_note" in table.columns else F.lit(None))
    new = {"review_status": put(F.lit(1), "review_status"), "review_l1": put(F.col("_n1"), "review_l1"),
           "review_l2": put(F.col("_n2"), "review_l2"), "review_l3": put(F.lit(""), "review_l3"),
           "review_note": put(note, "review_note"),
           "extracted_keywords": put(F.coalesce("_kw", F.lit("")), "extracted_keywords"),
           "reviewer": put(F.lit(reviewer or None).cast("string"), "reviewer"), "reviewed_at": put(F.lit(stamp), "reviewed_at"),
           "reflow_synced": put(sync, "reflow_synced")}
    keep = [c for c in table.columns if c not in new]
    return marked.select(*keep, *[c.alias(k) for k, c in new.items()], "applied", "to_reflow")


def batch_save_reviews(table: DataFrame, reviews: DataFrame) -> DataFrame:
    """Plain overwrite of the review columns; rows that lack an id or a status are ignored."""
    cols = ("review_status", "review_result", "review_note", "review_l1", "review_l2", "review_l3",
            "reviewer", "reviewed_at")
    ok = reviews.filter(filled("opinion_id") & F.col("review_status").isNotNull())
    j = table.join(_incoming(ok, cols, "_hit"), "opinion_id", "left")
    n1, n2 = labels.strip_non_issue(_NEW + "review_l1", _NEW + "review_l2")
    has = filled(_NEW + "review_l1")
    value = {c: F.col(_NEW + c) for c in cols}
    value["review_l1"] = F.when(has, n1).otherwise(value["review_l1"])
    value["review_l2"] = F.when(has, n2).otherwise(value["review_l2"])
    old = lambda c: F.col(c) if c in table.columns else F.lit(None)
    keep = [c for c in table.columns if c not in cols]
    return j.select(*keep, *[F.when(F.col("_hit"), value[c]).otherwise(old(c)).alias(c) for c in cols])


def readiness(df: DataFrame) -> DataFrame:
    """Per row: ``confirmed``, ``confirmable`` or a blocking reason; rows without an id drop out."""
    l1, l2 = labels.review_labels()
    r = df.filter(filled("opinion_id")).withColumns({"_l1": l1, "_l2": l2})
    state = (F.when(labels.is_reviewed(), "confirmed").when(F.col("_l1") == "", "no_l1")
             .when((labels.canonicalize_l1("_l1") != lp.NON_ISSUE) & (F.col("_l2") == ""), "missing_l2")
             .otherwise("confirmable"))
    n1, n2 = labels.strip_non_issue("_l1", "_l2")
    return r.withColumns({"state": state, "effective_l1": n1, "effective_l2": n2}).drop("_l1", "_l2")


def confirm_batch(df: DataFrame, batch: str, reviewer: str, stamp: str) -> DataFrame:
    """Confirms every confirmable row of a batch, unless some row is blocked."""
    ready = readiness(df.filter(F.col("upload_batch") == batch))
    blocked = ready.filter(F.col("state").isin("no_l1", "missing_l2")).agg(F.count(F.lit(1)).alias("n")).scalar()
    decisions = (ready.filter((F.col("state") == "confirmable") & (blocked == 0))
                 .groupBy("opinion_id").agg(F.first("effective_l1").alias("review_l1"),
                                            F.first("effective_l2").alias("review_l2")))
    return apply_reviews(df, decisions, reviewer, stamp)


def open_batches(df: DataFrame) -> DataFrame:
    """Batches with at least one row that is not reviewed."""
    return df.filter(filled("upload_batch") & (F.col("review_status") != 1)).select("upload_batch").distinct()


def reflow_candidates(df: DataFrame) -> DataFrame:
    """Reviewed rows not yet synced, with an L1, whose batch (if any) is fully reviewed."""
    due = df.filter(labels.is_reviewed() & (F.coalesce("reflow_synced", F.lit(0)) < 1) & filled("review_l1"))
    return due.join(open_batches(df), "upload_batch", "left_anti")


def archive_batch(df: DataFrame, batch: str) -> DataFrame:
    """All rows of a fully reviewed batch get the archived state; otherwise nothing changes.
    ``feedback`` marks rows whose labels still have to feed keywords and gold."""
    mine = F.coalesce(F.col("upload_batch") == batch, F.lit(False))
    still_open = df.filter(mine & (F.col("review_status") != 1)).agg(F.count(F.lit(1)).alias("n")).scalar()
    hit = mine & labels.is_reviewed() & (still_open == 0)
    old = F.coalesce("reflow_synced", F.lit(0))
    return df.withColumns({"feedback": hit & (old < 1),
                           "archive_action": F.when(hit & (old == 2), "already").when(hit, "new"),
                           "reflow_synced": F.when(hit, F.lit(2)).otherwise(F.col("reflow_synced"))})


def mark_reflow_failures(df: DataFrame, failures: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Failed ids get the failed state and a reason, shortened to ``max_chars`` if given."""
    why = F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown"))
    f = failures.groupBy("opinion_id").agg(F.max(why if max_chars is None else F.substring(why, 1, max_chars)).alias("_why"))
    j = df.join(f, "opinion_id", "left")
    hit = F.col("_why").isNotNull()
    old = F.col("reflow_sync_reason") if "reflow_sync_reason" in df.columns else F.lit(None).cast("string")
    return j.withColumns({"reflow_sync_reason": F.when(hit, F.col("_why")).otherwise(old),
                          "reflow_synced": F.when(hit, F.lit(-1)).otherwise(F.col("reflow_synced"))}).drop("_why")


def correction_log(df: DataFrame, reviews: DataFrame, keep: int | None = None) -> DataFrame:
    """Original class against the corrected one; with ``keep`` only the newest so many, newest first."""
    r = reviews.select("opinion_id", F.coalesce("review_note", F.lit("")).alias("corrected_class"),
                       F.col("review_status").alias("_st"), F.col("reviewed_at").alias("timestamp"))
    j = r.join(df.select("opinion_id", F.coalesce("model_class", F.lit("")).alias("original_class")), "opinion_id")
    out = j.withColumn("is_corrected", (F.col("original_class") != F.col("corrected_class")) & (F.col("_st") == 1)).drop("_st")
    return out if keep is None else out.orderBy(F.desc("timestamp"), F.desc("opinion_id")).limit(keep)


def confirm_as_correct(df: DataFrame, model_l1: Column, model_l2: Column) -> DataFrame:
    """Fills blank human labels from the model; ``error`` is empty when the row may be confirmed."""
    l1 = F.coalesce(F.nullif(strip("review_l1"), F.lit("")), F.nullif(strip(model_l1), F.lit("")), F.lit(""))
    j = df.withColumn("new_l1", l1)
    l2 = (F.when(F.col("new_l1") == lp.NON_ISSUE, "")
          .otherwise(first_filled("review_l2", model_l2)))
    j = j.withColumn("new_l2", l2)
    error = (F.when(F.col("new_l1") == "", "no_l1")
             .when((F.col("new_l1") != lp.NON_ISSUE) & (F.col("new_l2") == ""), "missing_l2").otherwise(""))
    return j.withColumn("error", error).withColumn(
        "new_status", F.when(F.col("error") == "", F.lit(1)).otherwise(F.col("review_status")))
