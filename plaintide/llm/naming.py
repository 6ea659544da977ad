"""Exact duplicates by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of a fixed size. The distinct blocks of all texts are sorted and get integer names;
then adjacent names are paired, the distinct pairs sorted and named, and so on until each document is left with one name.
Within one byte length the trees have one shape, so (byte length, last name) is equal for two texts if and only if all
their bytes are.

Bytes are shuffled once, to find the distinct blocks. An occurrence of a block travels as a 16-byte tag. A tag is not trusted:
the named blocks are all the blocks there are, so once their tags are counted and found to be all different, a tag is as
good as its block. Otherwise tags are made anew with another salt. Pairs are integers and travel as they are.

Only DataFrame functions are used. A round's names come from an aggregate with a map-side combine, frequent names reach their
occurrences by a broadcast of bounded size (see ``look_up``), and each round's result is checkpointed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintide.llm.common import look_up, table
from plaintide.session import materialise

BLOCK_BYTES = 1024


def _cut(body: Column, size: int) -> Column:
    """Blocks of ``size`` bytes, the last one shorter; the empty text is one empty block."""
    count = F.greatest(F.ceil(F.octet_length(body) / F.lit(float(size))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def _tag(block: Column, salt: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(salt.to_bytes(4, "big") if salt else b""), block)))


def _names(things: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, weight, name), one row per distinct thing in sorted order within its partition, and the number of things."""
    distinct = things.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight")).sortWithinPartitions(*keys)
    named = materialise(distinct.withColumn("name", F.monotonically_increasing_id()))
    return named, named.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]


def _first_names(bodies: DataFrame, size: int) -> tuple[DataFrame, int, int]:
    """Names of the distinct blocks by their tags: (tag, weight, name), the number of blocks, the salt of the tags."""
    salt = 0
    while True:
        blocks = bodies.select(F.explode(_cut(F.col("body"), size)).alias("block"))
        distinct = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("weight")).sortWithinPartitions("block")
        named = materialise(distinct.select(_tag(F.col("block"), salt).alias("tag"), "weight", F.monotonically_increasing_id().alias("name")))
        shared = named.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if shared.isEmpty():
            return named, named.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0], salt
        salt += 1


def _regroup(named: DataFrame) -> DataFrame:
    """(row, names): each document's names in their order. No longer than the text they stand for."""
    listed = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("p"))
    return listed.select("row", F.col("p.name").alias("names"))


def document_names(rows: DataFrame, names: DataFrame, total: int) -> DataFrame:
    """(row, name): one integer for each row of ``rows`` (row, tags); equal for documents of one byte length if and only if
    their texts are equal. ``names`` and ``total`` are those of the blocks."""
    occurrences = rows.select("row", F.posexplode("tags").alias("pos", "tag"))
    now = materialise(_regroup(look_up(occurrences, names, ["tag"], "weight", total).select("row", "pos", "name")))
    done = []
    while True:
        done.append(now.filter(F.size("names") == 1).select("row", F.col("names")[0].alias("name")))
        open_ = now.filter(F.size("names") > 1)
        if open_.isEmpty():
            break
        half = F.ceil(F.size("names") / F.lit(2.0)).cast("int")
        two = F.transform(F.sequence(F.lit(0), half - 1),
                          lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")))
        pairs = open_.select("row", F.posexplode(two).alias("pos", "two")).select("row", "pos", "two.a", "two.b")
        names, total = _names(pairs, ["a", "b"])
        now = materialise(_regroup(look_up(pairs, names, ["a", "b"], "weight", total).select("row", "pos", "name")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(documents: DataFrame, key: str = "doc_id", body: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) per row. Of equal texts the row with the largest key stays.

    NULL texts count as empty, and empty texts equal each other. Of rows that share the largest key of their group one stays;
    a NULL key is smaller than any other, so it stays only where its group has no other. Texts of any length are read whole.
    Other columns are ignored; an empty table gives an empty one.
    """
    source = documents.select(F.col(key).alias("id"), F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("body"))
    names, blocks, salt = _first_names(source.select("body"), block_bytes)
    tags = F.transform(_cut(F.col("body"), block_bytes), lambda b: _tag(b, salt))
    # One pass numbers the rows and keeps all that is needed of them; from here on no text is read.
    rows = materialise(source.select(F.monotonically_increasing_id().alias("row"), "id", F.octet_length("body").alias("bytes"),
                                     F.sha2("body", 256).alias("text_sha256"), tags.alias("tags")))
    named = document_names(rows.select("row", "tags"), names, blocks)
    members = materialise(rows.drop("tags").join(named, "row"))
    best = F.max(F.struct("id", "row")).alias("best")
    groups = materialise(members.groupBy("bytes", "name").agg(F.count(F.lit(1)).alias("group_size"), best).withColumn("weight", F.col("group_size")))
    total = groups.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return look_up(members, groups, ["bytes", "name"], "weight", total).select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""


def op13_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group."""
    return exact_groups(table(spark, sf_dir, "documents"))
