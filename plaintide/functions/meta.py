"""Tolerant access to the JSON label column: a broken document never fails a row."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaintide.functions.common import col, strip, text


def _wrapped(doc: Column | str) -> Column:
    """The document as the only element of an array. The parser stops after a first complete value,
    so text that trails an object would go unseen; inside brackets it is a syntax error."""
    return F.concat(F.lit("["), strip(doc), F.lit("]"))


def json_get(doc: Column | str, key: str) -> Column:
    """One top-level key as text. NULL for broken text, a non-object, a missing key or a dotted path."""
    if not key or "." in key:
        return F.lit(None).cast("string")
    return F.get_json_object(_wrapped(doc), f"$[0]['{key}']")


def is_json_object(doc: Column | str) -> Column:
    return F.coalesce(strip(doc).startswith("{") & F.try_parse_json(_wrapped(doc)).isNotNull(), F.lit(False))


def json_map(doc: Column | str) -> Column:
    """Top-level keys as text; an empty map for anything but an object."""
    return F.coalesce(F.from_json(F.when(is_json_object(doc), col(doc)), "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_text(doc: Column | str, key: str) -> Column:
    """Trimmed text of a key, empty when absent. JSON false, zero and empty nests count as absent."""
    return F.regexp_replace(text(json_get(doc, key)), r"^(?:false|0|0\.0|\[\]|\{\})$", "")


def materialized(doc: Column | str) -> dict[str, Column]:
    """The five stored columns derived from the JSON."""
    from plaintide.functions.labels import canonical_or_blank

    return {
        "v3_l1": canonical_or_blank(json_text(doc, "l1")),
        "v3_l2": json_text(doc, "l2"),
        "v3_l3": json_text(doc, "l3"),
        "v3_confidence": F.coalesce(json_get(doc, "confidence").try_cast("double"), F.lit(0.0)),
        "v3_match_type": json_text(doc, "match_type"),
    }
