"""A Merkle manifest of a dataset with incremental witnesses.

Each row is a leaf. The leaves of a tree (one per source) are appended in order to a stream of open subtrees with sixteen
places each. An append gives its subtree a partial witness, the siblings that stand before it; every later sibling that
completes extends the witnesses of all that came before it in the same run. A subtree whose run is full closes into its
parent, where it is an append again. So one pass over the leaves gives each its path of siblings.

Spark deals the leaves of a tree in aligned blocks of 16^3. A task streams one block; it hands on the block's root, and the
roots of all blocks are further appends to the tree above, dealt in blocks again until one node is left. The roots of the
trees are the leaves of the dataset's tree. Paths then come down: what a block's root got as its path is appended to the path of
every node of the block. A block has 4,096 nodes at most, whatever the size of a source, and no path is shuffled below its block.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaintide.llm.common import look_up, shuffle_parts, table
from plaintide.session import materialise

FAN = 16
BLOCK_LEVELS = 3
NODE = ["tree", "pos", "digest", "nodes"]
PATH = "array<struct<at:int,others:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """An open run of at most ``fan`` completed children, with the witnesses of the leaves below each child.

    ``marks[c]`` are the paths of the leaves below child c up to c itself. The siblings before c are c's partial witness on
    arrival; those after it are known as they complete, and are written into the paths when the run closes.
    """

    def __init__(self, fan: int):
        self.fan, self.digests, self.marks = fan, [], []

    def append(self, digest: str, paths: list[list]) -> None:
        for before, extended in enumerate(self.marks):
            extended[1].append(digest)  # a later sibling completes: one extension for all leaves below that child
        self.marks.append(("".join(self.digests), [], paths))
        self.digests.append(digest)

    def full(self) -> bool:
        return len(self.digests) == self.fan

    def close(self) -> tuple[str, list[list]]:
        below = []
        for at, (before, after, paths) in enumerate(self.marks):
            step = (at, before + "".join(after))
            for p in paths:
                p.append(step)
            below += paths
        digest = h("".join(self.digests))
        self.digests, self.marks = [], []
        return digest, below


class Appender:
    """A tree under streaming appends, as the list of its open subtrees, lowest first."""

    def __init__(self, fan: int = FAN):
        self.fan, self.open = fan, []

    def append(self, digest: str, path: list) -> None:
        """``path`` is filled as the leaf's siblings complete."""
        self._enter(0, digest, [path])

    def _enter(self, level: int, digest: str, paths: list[list]) -> None:
        if level == len(self.open):
            self.open.append(Subtree(self.fan))
        run = self.open[level]
        run.append(digest, paths)
        if run.full():
            self._enter(level + 1, *run.close())

    def finish(self, levels: int) -> str:
        """Closes what is open, short runs too, up to the given height; the root."""
        for level in range(levels):
            if level < len(self.open) and self.open[level].digests:
                self._enter(level + 1, *self.open[level].close())
        return self.open[levels].digests[0]


def height(nodes: int, levels: int, fan: int = FAN) -> int:
    """Levels that a block of a tree with so many nodes has: all if the tree has more blocks, else until one node is left."""
    k = 0
    while k < levels and nodes > 1:
        nodes, k = -(-nodes // fan), k + 1
    return k


def _nested(paths: list[list[tuple[int, str]]]) -> pa.Array:
    ends, at, others = [0], [], []
    for p in paths:
        for a, o in p:
            at.append(a)
            others.append(o)
        ends.append(len(at))
    steps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(others, pa.string())], ["at", "others"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)


def _stream(nodes: pa.Table, levels: int) -> tuple[str, list[list], pa.Table]:
    nodes = nodes.sort_by("pos")
    tree, paths = Appender(), []
    for d in nodes.column("digest").to_pylist():
        paths.append([])
        tree.append(d, paths[-1])
    return tree.finish(height(nodes.column("nodes")[0].as_py(), levels)), paths, nodes


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, digest, nodes) one level of blocks up, for the same columns one level down."""
    def run(t: pa.Table) -> pa.Table:
        one = t.slice(0, 1).to_pylist()[0]
        up = {"tree": one["tree"], "pos": one["block"], "digest": _stream(t, levels)[0], "nodes": -(-one["nodes"] // FAN ** levels)}
        return pa.Table.from_pylist([up])
    return _dealt(nodes, levels).applyInArrow(run, "tree long, pos long, digest string, nodes long")


def _dealt(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN ** levels)).cast("long")).groupBy("tree", "block")


def block_paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with a column ``path``: the node's path within its block, followed by the path of the block's root, which
    ``above`` has as (tree, pos, path) of one level of blocks up. Paths never travel below their own block."""
    keep = nodes.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        _, paths, t = _stream(t, levels)
        rest = [(s["at"], s["others"]) for s in up.column("path")[0].as_py()]
        return t.select(keep).append_column("path", _nested([p + rest for p in paths]))
    uppers = above.select("tree", F.col("pos").alias("block"), "path")
    return _dealt(nodes, levels).cogroup(uppers.groupBy("tree", "block")).applyInArrow(run, f"{schema}, path {PATH}")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (tree, pos, digest, nodes) and above them the block roots, level by level until each tree is one node."""
    rows = [nodes]
    while not rows[-1].filter("nodes > 1").isEmpty():
        rows.append(materialise(block_roots(rows[-1], levels)))
    return rows


def descend(rows: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, path) of the lowest of these levels, for the paths ``above`` that the roots of the trees have."""
    for nodes in reversed(rows[:-1]):
        above = materialise(block_paths(nodes, above, levels).select("tree", "pos", "path"))
    return above


def placed(leaves: DataFrame) -> DataFrame:
    """(tree, pos, nodes, all columns): ``leaves`` (source, id, leaf, ...) numbered within its source in the order of id and
    leaf. A source's tree number is the place of its first leaf among all leaves, so the trees are in the order of sources.

    Leaves are cut into ranges of (source, id, leaf), so a source of any share is spread, and numbered within their range.
    """
    order = ["source", "id", "leaf"]
    n = shuffle_parts(leaves.sparkSession)
    cut = materialise(leaves.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    part, local = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row for each shuffle partition.
    ranked = cut.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + local)
    # A NULL source and an empty one differ by the first character.
    ranked = ranked.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("_part", "_n", "_before")
    firsts = materialise(ranked.groupBy("_key").agg(F.min("_rank").alias("tree"), F.count(F.lit(1)).alias("nodes")).withColumn("_weight", F.col("nodes")))
    total = firsts.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    return look_up(ranked, firsts, ["_key"], "_weight", total).withColumn("pos", F.col("_rank") - F.col("tree")).drop("_rank", "_key")


def prove(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(digest, subroot, root, path, and the columns of ``leaves`` but source) for leaves (source, id, leaf, ...).

    ``path`` has a step per level from the leaf to the root: the digests of the run's other nodes as hex text without
    separators, and the place where the path's own node stands among them. A lone leaf of a lone source has steps of no
    siblings only. Equal leaves under one id are leaves of their own; a NULL id comes first. No rows give no rows.
    """
    base = materialise(placed(leaves).withColumnRenamed("leaf", "digest"))
    rows = climb(base.select(*NODE), levels)
    roots = rows[-1].select(F.lit("").alias("source"), F.col("tree").alias("id"), F.col("digest").alias("leaf"))
    # The dataset's tree: its leaves are the roots of the sources, numbered in the order of sources.
    top = materialise(placed(roots).select("tree", "pos", F.col("leaf").alias("digest"), "nodes", F.col("id").alias("below")))
    tops = climb(top.select(*NODE), levels)
    root = tops[-1].select("digest")
    ends = tops[-1].select("tree", "pos", F.array().cast(PATH).alias("path"))
    proven = materialise(block_paths(top, descend(tops[1:], ends, levels), levels) if len(tops) > 1 else top.withColumn("path", F.array().cast(PATH)))
    # One row per source.
    above = proven.select(F.col("below").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    weight = base.filter("pos = 0").select("tree", F.col("nodes").alias("_weight"))
    subroots = materialise(proven.select(F.col("below").alias("tree"), F.col("digest").alias("subroot")).join(weight, "tree"))
    total = base.agg(F.count(F.lit(1))).first()[0]
    lowest = look_up(base.drop("source"), subroots, ["tree"], "_weight", total)
    # A tree of one leaf has a block of its own as any other, of no height.
    out = block_paths(lowest, descend(rows[1:], above, levels), levels) if len(rows) > 1 else lowest.join(above.drop("pos"), "tree")
    return out.drop("tree", "pos", "nodes").withColumn("root", root.scalar())


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    def step(d: Column, s: Column) -> Column:
        others, cut = s["others"], s["at"] * 64
        return F.sha2(F.concat(F.substring(others, F.lit(1), cut), d, F.substring(others, cut + 1, F.length(others))).cast("binary"), 256)
    return F.aggregate(path, digest, step)


def field(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` for NULL, else its UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(documents: DataFrame, key: str = "doc_id", source: str = "source", body: str = "text", fields: list[str] | None = None,
             tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, path, given): the rows' leaves over ``fields`` with their paths, in one tree per source.

    ``given`` is the leaf of the row as it is presented for verification: where ``tampered`` holds, that of the row with the
    text's A to Z in lower case. Rows are verified against the root by ``fold(given, path) = root``.
    """
    fields = fields or FIELDS
    own = leaf(*[F.col(c) for c in fields])
    changed = leaf(*[F.translate(F.col(c), UPPER, UPPER.lower()) if c == body else F.col(c) for c in fields])
    given = F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(F.lit(None)) if tampered is not None else F.lit(None).cast("string")
    rows = documents.select(F.col(source).cast("string").alias("source"), F.col(key).alias("id"), own.alias("leaf"), given.alias("_given"))
    out = prove(rows, levels)
    return out.select(F.col("id").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("_given", "digest").alias("given"))


def op11_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof's digest, and whether it verifies; a fifth of the documents is tampered with."""
    fifth = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    m = manifest(table(spark, sf_dir, "documents"), tampered=fifth)
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("path", lambda s: s["others"]), "").cast("binary"), 256).alias("proof_sha256"),
                 fold(F.col("given"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_levels(p: str, last: int) -> str:
    """CTEs over p0 (tree, pos, digest): the levels, their runs' siblings, and documents (p_d0) climbing them."""
    out = []
    for k in range(last):
        out += [f"{p}n{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {p}{k})",
                f"{p}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {p}n{k} GROUP BY 1, 2)",
                f"""{p}s{k} AS (SELECT a.tree, a.pos, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {p}n{k} a JOIN {p}n{k} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 GROUP BY 1, 2, 3)""",
                f"""{p}d{k + 1} AS (SELECT d.* EXCLUDE (pos, proof, folded), d.pos // 16 AS pos, CASE WHEN n = 1 THEN proof ELSE concat(proof, l, r) END AS proof, CASE WHEN n = 1 THEN folded ELSE sha256(concat(l, folded, r)) END AS folded
  FROM {p}d{k} d JOIN {p}s{k} s ON d.tree = s.tree AND d.pos = s.pos)"""]
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in values) + "))"


# Six levels hold 16^6 rows of a source, three 4,096 sources. DuckDB has no crc32, so the digits of the id go through it bit by bit.
OP11_SQL = f"""
WITH doc AS (SELECT *, (dense_rank() OVER (ORDER BY source NULLS FIRST) - 1)::BIGINT AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, {_sql_leaf('text')} AS digest, {_sql_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS changed,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0] for i in range(1, length(doc_id::VARCHAR) + 1)])),
   lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) AS crc FROM documents),
w0 AS (SELECT tree, pos, digest FROM doc), wd0 AS (SELECT doc_id, tree, pos, digest AS leaf, '' AS proof, CASE WHEN crc % 5 = 0 THEN changed ELSE digest END AS folded FROM doc),
{_sql_levels('w', 6)},
t0 AS (SELECT 0 AS tree, tree AS pos, digest FROM w6), td0 AS (SELECT doc_id, leaf, 0 AS tree, d.tree AS pos, digest AS subroot, proof, folded FROM wd6 d JOIN w6 USING (tree)),
{_sql_levels('t', 3)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM td3 JOIN t3 USING (tree)"""
