"""Training-set preparation. Splits use a hash order over (id, seed): stable, repeatable and
independent of how the table is partitioned."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import filled, global_rank, rank_within, strip, text
from plaintide.packs import labels as lp


def hash_key(seed: int, key: str = "opinion_id") -> Column:
    return F.md5(F.concat(F.col(key), F.lit(f"|{seed}")))


def training_collect(df: DataFrame) -> DataFrame:
    """Reviewed rows with id, text and human L1, with the canonical labels of both sides."""
    m1, m2 = labels.model_labels()
    return df.filter(labels.is_reviewed() & filled("review_l1") & filled("opinion_id") & filled("original_text")).select(
        "id", "opinion_id", strip("original_text").alias("original_text"), text("review_l1").alias("review_l1"),
        text("review_l2").alias("review_l2"), labels.canonicalize_l1("review_l1").alias("human_l1"),
        labels.canonical_or_blank(m1).alias("model_l1"), m2.alias("model_l2"))


def holdout_split(rows: DataFrame, seed: int = 42, ratio: float = 0.10, stored: DataFrame | None = None,
                  key: str = "opinion_id") -> DataFrame:
    """``split`` is holdout or train. A stored id set is reused (ids no longer present fall out);
    otherwise the first share of the hash order, at least one row of two or more."""
    if stored is not None:
        ids = stored.select(key).distinct().withColumn("_h", F.lit(True))
        return (rows.join(ids, key, "left").withColumn("split", F.when(F.col("_h"), "holdout").otherwise("train"))
                .drop("_h").select(*rows.columns, "split"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.when(n <= 1, 0).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(ratio), 0).cast("bigint")))
    ranked = global_rank(rows.withColumn("_k", hash_key(seed, key)), [F.col("_k"), F.col(key)], "_r")
    return ranked.withColumn("split", F.when(F.col("_r") <= k, "holdout").otherwise("train")).drop("_k", "_r")


def hard_negative() -> Column:
    return (F.col("human_l1") != "") & (F.col("model_l1") != "") & (F.col("human_l1") != F.col("model_l1"))


def hard_negative_order(rows: DataFrame) -> DataFrame:
    """``position``: rows whose model label is wrong first, each side in row order."""
    return global_rank(rows.withColumn("hard", hard_negative()), [F.desc("hard"), F.col("id")], "position")


def stratified_first(rows: DataFrame, min_ratio: float = 0.15, order: str = "id") -> DataFrame:
    """``position``: the first ceil(ratio n) rows of each class lead, class by class, then the
    rest in row order; no row is dropped."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = F.greatest(F.lit(1), F.floor(n * F.lit(min_ratio) + F.lit(0.9999)))
    r = rank_within(rows, "human_l1", [F.col(order)], "_rn")
    slot = F.array_position(F.array(*[F.lit(c) for c in lp.L1_ORDER]), F.col("human_l1"))
    r = r.withColumn("lead", (F.col("_rn") <= per) & (slot > 0))
    r = r.withColumn("_slot", F.when(F.col("lead"), slot).otherwise(F.lit(99)))
    return global_rank(r, [F.col("_slot"), F.col(order)], "position").drop("_slot", "_rn")


def class_balance(rows: DataFrame, label: str = "human_l1", demand: str = lp.EXPERIENCE,
                  cap_share: float = 0.30, seed: int = 42, key: str = "opinion_id") -> DataFrame:
    """Demand rows are cycled up to the size of the largest business class; the non-issue class is
    cut to a share of the input by hash order, which is a sampling step by definition.
    ``copy`` numbers the repeats from 0."""
    counts = rows.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("_l") == c, F.col("n"))), F.lit(0))
    sizes = counts.agg(pick(demand).alias("d"), pick(lp.NON_ISSUE).alias("x"),
                       F.greatest(*[pick(c) for c in lp.BUSINESS_L1]).alias("target"),
                       F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    target, have, total = (sizes.select(c).scalar() for c in ("target", "d", "total"))
    cap = F.greatest(F.lit(1), F.floor(total * F.lit(cap_share)))
    keyed = rows.withColumns({"_c": F.col(label), "_k": hash_key(seed, key)})
    ranked = rank_within(keyed, "_c", [F.col("_k"), F.col(key)], "_rn").drop("_k")
    # Row r of the demand class appears once per full cycle, plus once if the last cycle reaches it.
    times = F.when(F.col(label) == demand, F.floor((target - F.col("_rn")) / have) + 1).otherwise(1)
    kept = ranked.filter((F.col(label) != lp.NON_ISSUE) | (F.col("_rn") <= cap))
    return (kept.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.greatest(times, F.lit(1)) - 1).cast("int"))))
            .drop("_c", "_rn"))


def train_valid_test(rows: DataFrame, seed: int = 42, train: float = 0.90, valid: float = 0.05,
                     key: str = "opinion_id") -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(valid))
    r = global_rank(rows.withColumn("_k", hash_key(seed, key)), [F.col("_k"), F.col(key)], "_r")
    return r.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "valid").otherwise("test")).drop("_k", "_r")


def shard_groups(rows: DataFrame, groups: int, done: DataFrame | None = None, order: str = "id") -> DataFrame:
    """Round-robin groups in id order; finished groups are left out on resume."""
    r = global_rank(rows, [F.col(order)], "_r").withColumn("shard", F.pmod(F.col("_r") - 1, F.lit(groups)).cast("int")).drop("_r")
    return r.join(done.select("shard").distinct(), "shard", "left_anti") if done is not None else r


def training_summary(split: DataFrame) -> DataFrame:
    """(metric, item, n) rows of a split: sizes, hard negatives and class mix of the training part."""
    train = F.col("split") == "train"
    head = split.agg(F.count(F.lit(1)).alias("collected"), F.count_if(~train).alias("holdout"), F.count_if(train).alias("train"),
                     F.count_if(train & hard_negative()).alias("hard_negative"))
    flat = head.selectExpr("stack(4, 'collected', collected, 'holdout', holdout, 'train', train, 'hard_negative', hard_negative) as (item, n)")
    mix = split.filter(train).groupBy(F.col("human_l1").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return flat.select(F.lit("size").alias("metric"), "item", "n").unionByName(mix.select(F.lit("class").alias("metric"), "item", "n"))
