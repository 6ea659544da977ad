"""Small tables and brute-force versions for the operators' tests."""
from __future__ import annotations

import re
import zlib

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
# Names that operators use inside.
CLASHING = ["id", "mark", "body", "fp", "h", "rank", "size", "score", "slice", "bucket", "_keep_id", "_copy", "runs", "lang_pred"]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rest(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


LINE = "the quick brown fox jumps over the lazy dog and then walks home by the river bank"
EDGE_TEXTS = [None, "", " \n\t ", "one", "two words", "ab", "ÄÖÜ straße 你好 ß", "123 456 $$$", "aaaa " * 300, "a" * 3000,
              LINE, LINE, LINE.upper(), LINE + "\n" + LINE + "\n" + LINE, "x\x00y z", "<|endoftext|> text", "tail space ", "  two  spaces", "tab\there"]


def edge_documents(spark, extra: bool = False):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "ß"][i % 4], len(t) if t is not None else None) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[10], rows[10], (None, LINE, "en", "s1", 3), (None, None, None, None, None)]  # repeated rows, NULL ids
    df = spark.createDataFrame(rows, DOC)
    if extra:
        for i, c in enumerate(CLASHING):
            df = df.selectExpr("*", f"{i} AS `{c}`")
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOC)
