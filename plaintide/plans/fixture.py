"""The ``opinion`` table derived from the given documents and labels; one text for both engines."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2024, 6, 30)
AS_OF_SQL = "DATE '2024-06-30'"

OPINION_SQL = """
WITH b AS (
  SELECT d.doc_id AS k, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         date '2024-01-01' + cast((d.doc_id * 37) % 180 AS int) AS cday,
         CASE d.lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS c1
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), m AS (
  SELECT *, CASE WHEN k % 9 = 0 THEN (c1 + 1) % 4 ELSE c1 END AS p1,
         (k * 7) % 5 AS c2,
         CASE WHEN k % 11 = 0 THEN ((k * 7) + 1) % 5 ELSE (k * 7) % 5 END AS p2,
         k % 3 AS c3, quality IS NOT NULL AS rev
  FROM b
), t AS (
  SELECT *,
    CASE c1 WHEN 0 THEN '产品质量类' WHEN 1 THEN '服务类' WHEN 2 THEN '体验需求类' ELSE '非问题' END AS hl1,
    CASE p1 WHEN 0 THEN '产品质量类' WHEN 1 THEN '服务类' WHEN 2 THEN '体验需求类' ELSE '非问题' END AS ml1,
    CASE p1 WHEN 0 THEN '质量问题' WHEN 1 THEN '营销服务' WHEN 2 THEN '体验需求' ELSE '咨询' END AS alias1
  FROM m
)
SELECT
  k AS id,
  concat('OP', lpad(cast(k AS string), 8, '0')) AS opinion_id,
  source,
  text AS original_text,
  CASE k % 4 WHEN 0 THEN concat(cast(cday AS string), ' 08:30:00')
             WHEN 1 THEN replace(cast(cday AS string), '-', '/')
             WHEN 2 THEN replace(cast(cday AS string), '-', '.')
             ELSE CASE WHEN k % 20 = 3 THEN '' ELSE cast(cday AS string) END END AS create_time,
  concat(cast(cday + 1 AS string), ' 00:00:00') AS created_at,
  CASE WHEN rev THEN concat(cast(cday + cast(k % 5 AS int) AS string), ' 12:00:00') ELSE NULL END AS reviewed_at,
  CASE WHEN rev THEN 1 WHEN k % 7 = 0 THEN 2 ELSE 0 END AS review_status,
  CASE WHEN rev THEN hl1 ELSE NULL END AS review_l1,
  CASE WHEN rev AND c1 < 3 THEN concat('L2-', cast(c2 AS string)) ELSE '' END AS review_l2,
  CASE WHEN rev AND c1 < 3 THEN concat('L3-', cast(c3 AS string)) ELSE '' END AS review_l3,
  CASE WHEN k % 13 = 0 THEN '' ELSE ml1 END AS v3_l1,
  CASE WHEN k % 13 = 0 OR p1 = 3 THEN '' ELSE concat('L2-', cast(p2 AS string)) END AS v3_l2,
  CASE WHEN k % 13 = 0 OR k % 5 = 0 THEN '' ELSE concat('L3-', cast(c3 AS string)) END AS v3_l3,
  cast((k * 13) % 100 AS double) / 100.0 AS v3_confidence,
  CASE k % 4 WHEN 0 THEN 'gold_review' WHEN 1 THEN 'rule' WHEN 2 THEN 'llm_l3' ELSE 'clean_l1' END AS v3_match_type,
  CASE WHEN k % 23 = 0 THEN concat('{"l1": "', ml1)
       WHEN k % 17 = 0 THEN ''
       ELSE concat('{"l1": "', ml1, '", "l2": "L2-', cast(p2 AS string), '", "l3": "L3-', cast(c3 AS string),
                   '", "confidence": 0.', cast(10 + (k * 13) % 90 AS string),
                   ', "l3_phrases": "ph', cast(k % 6 AS string), ',ph', cast(k % 4 AS string), '"}') END AS v3_label_meta,
  alias1 AS model_class,
  concat('L2-', cast(p2 AS string), ',L3-', cast(c3 AS string)) AS model_keyword,
  concat('LJU', lpad(cast(k % 150 AS string), 14, '0')) AS vin,
  CASE WHEN k % 6 = 0 THEN '' ELSE concat('138', lpad(cast(k % 150 AS string), 8, '0')) END AS phone,
  CASE k % 5 WHEN 0 THEN 'ELETRE' WHEN 1 THEN 'emeya, Eletre' WHEN 2 THEN 'Emira' WHEN 3 THEN '' ELSE 'Model  X' END AS car_model,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'CN' WHEN 2 THEN '中国大陆' WHEN 3 THEN 'Germany' ELSE 'France' END AS country,
  concat('20240', cast(1 + k % 6 AS string), '01_1_', cast(k % 3 AS string)) AS upload_batch,
  cast(k % 4 AS int) - 1 AS reflow_synced
FROM t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed eagerly against the two inputs, so unused columns are pruned to the scan."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    table(spark, sf_dir, "labels").createOrReplaceTempView("labels")
    return spark.sql(OPINION_SQL)
