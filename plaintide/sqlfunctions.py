"""SQL names for the scalar helpers, so that they can be used from ``spark.sql`` as well.

They are SQL functions built from Spark's own expressions, which the optimizer inlines.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from plaintide.functions.common import WS
from plaintide.packs import labels as lp


def register(spark: SparkSession) -> None:
    """Temporary functions ``canonical_l1(text)``, ``voc_json_extract(doc, path)`` and
    ``text_fingerprint(text)``."""
    from plaintide.functions.labels import _containment_pattern

    def quote(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pattern, replacement, table = _containment_pattern(lp.L1_CONTAINMENT)
    alias = "map(" + ", ".join(quote(x) for kv in lp.L1_ALIASES.items() for x in kv) + ")"
    marks = "map(" + ", ".join(quote(x) for kv in table.items() for x in kv) + ")"
    t = f"regexp_replace(coalesce(s, ''), {quote(WS + '+')}, '')"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canonical_l1(s STRING) RETURNS STRING RETURN "
              f"coalesce(try_element_at({alias}, {t}), try_element_at({marks}, regexp_replace({t}, {quote(pattern)}, {quote(replacement)})), {quote(lp.SERVICE)})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION voc_json_extract(doc STRING, path STRING) RETURNS STRING RETURN "
              r"CASE WHEN path RLIKE '^\\$\\.[^.]+$' THEN get_json_object(trim(doc), path) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_fingerprint(s STRING) RETURNS STRING RETURN "
              f"md5(regexp_replace(coalesce(s, ''), {quote(WS + '+')}, ''))")
