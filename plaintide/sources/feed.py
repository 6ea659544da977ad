"""The feed: CSV scan, header aliases, de-duplication, batch numbering, merge into the table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plaintide.functions import text as tx
from plaintide.functions.common import blank, filled, first_filled, text
from plaintide.operators.keyed import pick_per_key
from plaintide.packs import words as wp
from plaintide.schema import FEED_FIELDS, FEED_ID


def file_line() -> Column:
    """Place of a row in a feed of several files: file time, path, split and row. Sorts as the feed was written,
    however the files and splits were dealt to tasks."""
    m = F.col("_metadata")
    return F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("path"), m["file_block_start"].alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def scan_csv(spark: SparkSession, path: str, id_column: str = FEED_ID, multi_line: bool = False) -> DataFrame:
    """All columns as strings, NULL as empty, one sortable ``_line`` per row.

    The header is read from the first line only, without a pass over the data; a file whose header differs from it is
    an error, not a misread. Files are split over tasks unless ``multi_line`` says that quoted fields hold line ends.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError("empty feed")
    header = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
              .csv(path).columns if '"' in first[0][0] else first[0][0].split(","))
    names = [h.lstrip("﻿").strip() for h in header]
    if id_column not in names:
        raise ValueError(f"feed lacks the id column {id_column!r}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
          .option("escape", '"').option("enforceSchema", first[0][0].startswith("\ufeff")).csv(path))
    return df.select("*", file_line().alias("_line")).na.fill("", names)


def resolve_headers(df: DataFrame) -> DataFrame:
    """Identifier fields from the first non-empty of their header aliases, else from the text."""
    cols = df.columns
    body = F.col("original_text") if "original_text" in cols else F.lit("")
    return df.withColumns({
        "vin": first_filled(tx.header_value(cols, wp.VIN_HEADERS), tx.extract_vin(body)),
        "car_model": first_filled(tx.header_value(cols, wp.MODEL_HEADERS), tx.extract_model(body)),
        "phone": tx.header_value(cols, wp.PHONE_HEADERS),
        "country": tx.header_value(cols, wp.COUNTRY_HEADERS),
    })


def shape_feed(raw: DataFrame, id_column: str = FEED_ID) -> DataFrame:
    """Raw feed lines to table columns."""
    def opt(name: str) -> Column:
        return text(F.col(f"`{name}`")) if name in raw.columns else F.lit("")

    shaped = raw.withColumns({"opinion_id": text(F.col(f"`{id_column}`")), "original_text": opt("舆情中文")})
    meta = opt("v3_label_meta") if "v3_label_meta" in raw.columns else opt("标签体系JSON")
    keyword = F.trim(F.concat_ws(",", opt("二级标签"), opt("三级标签")), F.lit(","))
    out = resolve_headers(shaped).withColumns({
        "source": opt("渠道"), "create_time": opt("舆情时间"), "model_class": opt("一级标签"),
        "model_keyword": keyword, "match_score": F.lit(0.0), "extracted_keywords": F.lit(""),
        "v3_label_meta": meta, "original_text_md5": tx.dedupe_key("original_text"),
        "email_like": tx.is_email_like("original_text", opt("渠道"), raw.columns)})
    keep = ["opinion_id", *[f for f in FEED_FIELDS if f != "upload_batch"], "email_like"]
    return out.select(*keep, *[c for c in ("_line",) if c in raw.columns])


def dedupe_last(df: DataFrame, id_column: str = "opinion_id", line: str = "_line") -> DataFrame:
    """Drops blank ids; the last line of each id wins."""
    return pick_per_key(df.filter(filled(id_column)), [id_column], [F.col(line)])


def blank_ids(df: DataFrame, id_column: str = "opinion_id") -> DataFrame:
    return df.agg(F.count_if(blank(id_column)).alias("skipped_invalid_id"))


def next_batch_seq(table: DataFrame, day: str) -> Column:
    """One more than the largest sequence number used on ``day`` (yyyymmdd)."""
    seq = F.split_part("upload_batch", F.lit("_"), F.lit(2)).try_cast("int")
    return (table.filter(F.col("upload_batch").startswith(day + "_"))
            .agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("seq")).scalar())


def assign_batch(feed: DataFrame, table: DataFrame, day: str) -> DataFrame:
    """Stamps the feed with ``day_seq_n`` where n is its own row count."""
    n = feed.agg(F.count(F.lit(1)).alias("n")).scalar()
    return feed.withColumn("upload_batch", F.concat_ws("_", F.lit(day), next_batch_seq(table, day).cast("string"),
                                                       n.cast("string")))


def upsert(table: DataFrame, feed: DataFrame) -> DataFrame:
    """Merge by id: known ids take the feed's own columns and keep every review column; unknown
    ids enter as pending. ``merge_action`` tells which.

    The id is not unique in the table, so each of its rows is updated. The feed has one row per
    id, so the left join can be split by AQE when an id is hot; the insert side compares ids only.
    """
    fields = [f for f in FEED_FIELDS if f in table.columns and f in feed.columns]
    src = feed.select("opinion_id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    updated = (table.join(src, "opinion_id", "left")
               .select(*[(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in fields
                          else F.col(c)) for c in table.columns],
                       F.when(F.col("_hit"), "update").otherwise("keep").alias("merge_action")))
    fresh = feed.join(table.select("opinion_id").distinct(), "opinion_id", "left_anti")
    blanks = {"review_status": F.lit(0), "reflow_synced": F.lit(0)}
    inserted = fresh.select(*[
        (F.col(c) if c in fields or c == "opinion_id" else blanks.get(c, F.lit(None)))
        .cast(table.schema[c].dataType).alias(c) for c in table.columns], F.lit("insert").alias("merge_action"))
    return updated.unionByName(inserted)


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("merge_action") == "insert").alias("inserted"),
        F.count_distinct(F.when(F.col("merge_action") == "update", F.col("opinion_id"))).alias("updated"))


def existing_ids(table: DataFrame, ids: DataFrame, key: str = "opinion_id") -> DataFrame:
    """The given ids that the table holds."""
    return ids.select(key).distinct().join(table.select(key), key, "left_semi")


def next_batch_path(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"
