"""Building, repairing and checking the label taxonomy."""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions import labels
from plaintide.functions.common import collapse, global_rank, strip, text, top_rows
from plaintide.functions.meta import json_text
from plaintide.packs import labels as lp
from plaintide.session import checkpoint_dir


def taxonomy_scan(raw: DataFrame, doc: str = "doc") -> DataFrame:
    """(l1, l2, l3, freq, pos) rows from nested taxonomy JSON; keys that begin with ``_`` are skipped, as are documents that are not
    JSON. Documents are read as variants and opened a level at a time, and the blocks of a large one are spread over tasks
    before their labels are. A column ``first``, if there is one, says at which position a document's label lists begin."""
    spark = raw.sparkSession
    first = F.col("first") if "first" in raw.columns else F.lit(0)

    def opened(df: DataFrame, value: str, key: str, inner: str) -> DataFrame:
        return df.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()).toDF("_at", key, inner)).drop("_at", value)
    top = opened(raw.select(first.cast("int").alias("_first"), F.try_parse_json(F.col(doc)).alias("_v")), "_v", "l1", "_a").filter(~F.col("l1").startswith("_"))
    mid = opened(top, "_a", "l2", "_b").filter(~F.col("l2").startswith("_")).repartition("l1", "l2", "_first")
    x = mid.select("l1", "l2", "_first", F.try_variant_get("_b", "$['标签列表']", "array<string>").alias("_l"), F.try_variant_get("_b", "$['详情']", "map<string,int>").alias("_d"))
    return x.select("l1", "l2", "_first", "_d", F.posexplode("_l").alias("_at", "l3")).select(
        "l1", "l2", "l3", F.coalesce(F.try_element_at("_d", F.col("l3")), F.lit(1)).alias("freq"), (F.col("_first") + F.col("_at")).alias("pos"))


def label_triple_frequency(df: DataFrame, l1: str, l2: str, l3: str) -> DataFrame:
    """Cleaned triples with their count; blank levels drop out."""
    c = df.select(*[collapse(text(x)).alias(n) for x, n in ((l1, "l1"), (l2, "l2"), (l3, "l3"))])
    return c.filter((F.col("l1") != "") & (F.col("l2") != "") & (F.col("l3") != "")).groupBy("l1", "l2", "l3").agg(F.count(F.lit(1)).alias("freq"))


def taxonomy_build(triples: DataFrame) -> DataFrame:
    """Per (l1, l2): L3 names by frequency, the total and the detail map. Works on distinct triples."""
    t = triples.groupBy("l1", "l2", "l3").agg(F.sum("freq").alias("freq"))
    item = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("k"), "l3")))
    g = t.groupBy("l1", "l2").agg(item.alias("i"), F.sum("freq").alias("total"))
    return g.select("l1", "l2", F.transform("i", lambda x: x["l3"]).alias("labels"), "total",
                    F.map_from_entries(F.transform("i", lambda x: F.struct(x["l3"], -x["k"]))).alias("detail"))


def taxonomy_json(triples: DataFrame, most: int = 10_000) -> DataFrame:
    """(first, doc): the taxonomy of (l1, l2, l3, freq) as nested JSON documents, one for every ``most`` labels of an (l1, l2) in
    the order of frequency and name. ``first`` is the position of a document's first label; no row holds more."""
    path = F.struct("l1", "l2")
    ranked = global_rank(triples.select("l1", "l2", "l3", "freq"), [F.asc("l1"), F.asc("l2"), F.desc("freq"), F.asc("l3")], "_rank")
    starts = ranked.groupBy("l1", "l2").agg(F.min("_rank").alias("_start"), F.sum("freq").alias("_total"))
    ranked = ranked.join(starts, ["l1", "l2"]).withColumn("first", (F.floor((F.col("_rank") - F.col("_start")) / F.lit(most)) * most).cast("int"))
    item = F.struct("_rank", "l3", "freq")
    parts = ranked.groupBy("l1", "l2", "first").agg(F.array_sort(F.collect_list(item)).alias("i"), F.first("_total").alias("_total"))
    block = F.struct(F.transform("i", lambda x: x["l3"]).alias("标签列表"), F.col("_total").alias("频次"),
                     F.map_from_entries(F.transform("i", lambda x: F.struct(x["l3"], x["freq"]))).alias("详情"))
    return parts.select("first", F.to_json(F.create_map(path["l1"], F.create_map(path["l2"], block))).alias("doc"))


def standardise_name(c: Column, renames: Sequence[tuple[str, str]], empty: str = "通用") -> Column:
    out = F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(empty))
    for old, new in renames:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def taxonomy_optimise(triples: DataFrame, renames: Sequence[tuple[str, str]], moves: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Triples renamed by substring, then moved to the class whose words the name holds (in order),
    with the frequencies summed again."""
    t = optimise_log(triples, renames, moves)
    return t.groupBy(F.col("new_l1").alias("l1"), "l2", F.col("new_l3").alias("l3")).agg(F.sum("freq").alias("freq"))


def optimise_log(triples: DataFrame, renames: Sequence[tuple[str, str]], moves: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Every triple with its new place and whether it was renamed or moved."""
    t = triples.withColumn("new_l3", standardise_name(F.col("l3"), renames))
    target = F.col("l1")
    for cls, words in reversed(moves):
        hit = F.col("new_l3").rlike("|".join(words)) & (F.col("l1") != cls)
        target = F.when(hit, cls).otherwise(target)
    return t.withColumn("new_l1", target).withColumns({"renamed": F.col("new_l3") != F.col("l3"), "moved": F.col("new_l1") != F.col("l1")})


def taxonomy_sample_check(rows: DataFrame, taxonomy: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """A seeded sample of triples with the reason of a miss (empty when it is in the taxonomy)."""
    key = F.md5(F.concat_ws("|", "l1", "l2", "l3", F.lit(str(seed))))
    s = rows.withColumn("_k", key).orderBy("_k", "l1", "l2", "l3").limit(n).drop("_k")
    a = taxonomy.select("l1").distinct().withColumn("_1", F.lit(True))
    b = taxonomy.select("l1", "l2").distinct().withColumn("_2", F.lit(True))
    c = taxonomy.select("l1", "l2", "l3").distinct().withColumn("_3", F.lit(True))
    j = s.join(a, "l1", "left").join(b, ["l1", "l2"], "left").join(c, ["l1", "l2", "l3"], "left")
    reason = F.when(F.col("_1").isNull(), "no_l1").when(F.col("_2").isNull(), "no_l2").when(F.col("_3").isNull(), "no_l3").otherwise("")
    return j.withColumn("reason", reason).drop("_1", "_2", "_3")


def match_rate(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "").alias("matched")).withColumn(
        "match_rate", F.round(F.col("matched") / F.greatest("n", F.lit(1)) * 100, 2))


def _chars(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def l2_alignment(names: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Free (l1, l2) names with the best hierarchy key: character Jaccard, containment lifts to 0.45,
    floor 0.12, the earlier key on a tie. Names are distinct labels, the keys an array per class."""
    keys = hierarchy.groupBy("l1").agg(F.array_sort(F.collect_list(F.struct("pos", "l2"))).alias("keys"))
    d = names.select("l1", collapse(text("l2")).alias("raw_l2")).filter(F.col("raw_l2") != "").distinct().join(keys, "l1")
    def score(k: Column) -> Column:
        s = F.col("raw_l2")
        j = F.size(F.array_intersect(_chars(s), _chars(k))) / F.greatest(F.lit(1), F.size(F.array_union(_chars(s), _chars(k))))
        return F.when(F.contains(s, k) | F.contains(k, s), F.greatest(j, F.lit(0.45))).otherwise(j)
    best = F.array_max(F.transform("keys", lambda k: F.struct(score(k["l2"]).alias("s"), (-k["pos"]).alias("p"), k["l2"].alias("l2"))))
    return d.withColumn("_b", best).select("l1", "raw_l2", F.when(F.col("_b.s") >= 0.12, F.col("_b.l2")).alias("l2"), F.round("_b.s", 4).alias("score"))


def _char_key(c: Column) -> Column:
    """The character set of a label as sorted text: labels with one set are alike in every respect
    that the Jaccard measure sees."""
    return F.array_join(F.array_sort(_chars(c)), "")


MOST_KEYS = 32  # signatures of one label for one partner size, unless single characters already make more


def _choices(cs: Column, k: int) -> Column:
    """All ordered selections of ``k`` (1 to 3) elements of an array, as arrays."""
    if k == 1:
        return F.transform(cs, lambda x: F.array(x))
    rest = lambda i: F.slice(cs, i + 2, F.greatest(F.size(cs) - i - 1, F.lit(0)))
    if k == 2:
        return F.flatten(F.transform(cs, lambda x, i: F.transform(rest(i), lambda y: F.array(x, y))))
    return F.flatten(F.transform(cs, lambda x, i: F.transform(_choices(rest(i), 2), lambda p: F.concat(F.array(x), p))))


def set_signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(l1, l2, chars, n, o, small, large, width, prefix, sig) for sets (l1, l2, chars, o) with elements ``o`` in the order of rarity.

    A set of n elements meets partners of each size m within the factor t under keys of their own. Two sets of sizes n and m that
    reach the threshold share at least ``s = ceil(t (n + m) / (1 + t))`` elements, hence at least ``k`` of the first ``n - s + k`` and
    ``m - s + k`` ones. A key is a selection of k of these; k is the largest up to three that makes at most ``MOST_KEYS`` of them.
    """
    t, near = float(threshold), 1e-9
    n = F.size("o")
    x = sets.withColumn("n", n).withColumn("m", F.explode(F.sequence(F.ceil(n * t - near).cast("int"), F.floor(n / t + near).cast("int"))))
    x = x.withColumns({"small": F.least("n", "m"), "large": F.greatest("n", "m"), "shared": F.ceil((F.col("n") + F.col("m")) * (t / (1 + t)) - near).cast("int")})
    spare = F.col("large") - F.col("shared")
    fits = {3: (spare + 3) * (spare + 2) * (spare + 1) / 6 <= MOST_KEYS, 2: (spare + 2) * (spare + 1) / 2 <= MOST_KEYS}
    width = F.when((F.col("shared") >= 3) & fits[3], 3).when((F.col("shared") >= 2) & fits[2], 2).otherwise(1)
    x = x.withColumn("width", width).withColumn("prefix", F.slice("o", F.lit(1), F.least(F.col("n"), F.col("n") - F.col("shared") + F.col("width"))))
    sigs = F.when(F.col("width") == 3, _choices(F.col("prefix"), 3)).when(F.col("width") == 2, _choices(F.col("prefix"), 2)).otherwise(_choices(F.col("prefix"), 1))
    return x.withColumn("sig", F.explode(sigs)).drop("m", "shared")


def similar_sets(labels_df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(l1, l2, chars, other): pairs of distinct character sets that reach the Jaccard threshold,
    each way. Labels with equal sets are folded first, so no group of likes is paired out.

    An exact join on the signatures of ``set_signatures``: composite keys of the rarest characters, apart for each pair of
    sizes. A pair is judged once, at the first key that both have.
    """
    d = labels_df.select("l1", "l2", _char_key(F.col("label")).alias("chars")).distinct()
    ch = d.select("l1", "l2", "chars", F.explode(_chars(F.col("chars"))).alias("ch"))
    freq = ch.groupBy("ch").agg(F.count(F.lit(1)).alias("f"))
    sets = ch.join(freq, "ch").groupBy("l1", "l2", "chars").agg(F.array_sort(F.collect_list(F.struct("f", "ch"))).alias("o"))
    sets = sets.withColumn("o", F.transform("o", lambda x: x["ch"]))
    keys = ["l1", "l2", "small", "large", "sig"]
    p = set_signatures(sets, threshold)
    a = p.select(*keys, "width", *[F.col(c).alias(f"{c}1") for c in ("chars", "n", "o", "prefix")])
    b = p.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("chars", "n", "o", "prefix")])
    # Of two sizes the smaller set stands left; of one size the set that is first by name.
    j = a.join(b, keys).filter((F.col("n1") == F.col("small")) & (F.col("n2") == F.col("large")) & ((F.col("n1") < F.col("n2")) | (F.col("chars1") < F.col("chars2"))))
    j = j.filter(F.slice(F.array_intersect("prefix1", "prefix2"), F.lit(1), F.col("width")) == F.col("sig"))
    inter = F.size(F.array_intersect("o1", "o2"))
    ok = j.filter(inter / (F.col("n1") + F.col("n2") - inter) >= threshold).select("l1", "l2", F.col("chars1").alias("chars"), F.col("chars2").alias("other"))
    return ok.unionByName(ok.select("l1", "l2", F.col("other").alias("chars"), F.col("chars").alias("other")))


def _first_names(rows: DataFrame, order: list[Column], sort: list[Column], name: str, most: int | None, alias: str) -> DataFrame:
    """The names of each canonical label in order, as an array. With ``most`` only the first so many are gathered."""
    group = ["l1", "l2", "canonical"]
    if most is not None:
        rows = top_rows(rows, group, order, most, salt_by=[name])
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort)], F.col(name).alias("name"))
    return rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["name"]).alias(alias))


def label_cluster_merge(freqs: DataFrame, threshold: float = 0.5, max_syn: int | None = None, max_kw: int | None = None) -> DataFrame:
    """Greedy merge of labels (l1, l2, label, n) by frequency: the most frequent unused label is a
    seed and absorbs every unused similar label.

    That is the first maximal independent set in frequency order, which is found in parallel rounds:
    a label becomes a seed once no earlier label that could still absorb it is left, and a label next
    to an earlier seed is absorbed by the earliest one, until none is open. No group is handled by a single task.
    ``max_syn`` and ``max_kw`` keep the first so many synonyms and keywords of each label; all by default.
    """
    checkpoint_dir(freqs.sparkSession)
    f = freqs.filter(F.length("label") >= 2).groupBy("l1", "l2", "label").agg(F.sum("n").alias("n"))
    f = f.withColumn("chars", _char_key(F.col("label"))).checkpoint(eager=True)
    # A set takes the rank of its most frequent label: that label decides for all of them.
    lead = F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("r")
    nodes = f.groupBy("l1", "l2", "chars").agg(lead)
    e = similar_sets(f, threshold)
    e = e.join(nodes, ["l1", "l2", "chars"]).join(nodes.select("l1", "l2", F.col("chars").alias("other"), F.col("r").alias("ro")), ["l1", "l2", "other"])
    earlier = e.filter(F.col("ro") < F.col("r")).select("l1", "l2", "chars", "other", "ro").checkpoint(eager=True)
    state = nodes.withColumn("seed", F.lit(None).cast("boolean"))
    while True:
        st = state.select("l1", "l2", F.col("chars").alias("other"), F.col("seed").alias("so"))
        near = earlier.join(st, ["l1", "l2", "other"]).groupBy("l1", "l2", "chars").agg(
            F.max(F.coalesce("so", F.lit(False))).alias("has_seed"), F.max(F.col("so").isNull()).alias("has_open"))
        j = state.join(near, ["l1", "l2", "chars"], "left")
        decided = (F.when(F.col("has_seed"), F.lit(False)).when(F.col("has_open"), F.lit(None).cast("boolean")).otherwise(F.lit(True)))
        state = j.select("l1", "l2", "chars", "r", F.coalesce("seed", decided).alias("seed")).checkpoint(eager=True)
        if state.filter(F.col("seed").isNull()).limit(1).count() == 0:
            break
    seeds = state.filter("seed").select("l1", "l2", F.col("chars").alias("other"))
    owner = earlier.join(seeds, ["l1", "l2", "other"], "left_semi").groupBy("l1", "l2", "chars").agg(F.min("ro").alias("ro"))
    canon = nodes.join(owner, ["l1", "l2", "chars"], "left").select("l1", "l2", "chars", F.coalesce("ro.label", "r.label").alias("canonical"))
    member = f.join(canon, ["l1", "l2", "chars"]).drop("chars")
    sums = member.groupBy("l1", "l2", "canonical").agg(F.sum("n").alias("count"))
    syn = _first_names(member.filter("label <> canonical"), [F.desc("n"), F.asc("label")], [-F.col("n"), F.col("label")], "label", max_syn, "synonyms")

    def grams(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("label") - (size - 1), F.lit(1)))
        return F.when(F.length("label") >= size, F.transform(starts, lambda i: F.substr("label", i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    kw = member.select("l1", "l2", "canonical", F.explode(F.concat(grams(4), grams(3), grams(2))).alias("w")).distinct()
    kw = kw.join(f.select("l1", "l2", F.col("label").alias("w"), "n"), ["l1", "l2", "w"], "left").withColumn("len", F.length("w"))
    seen = F.coalesce("n", F.lit(0))
    kw = _first_names(kw, [F.desc("len"), F.desc(seen), F.asc("w")], [-F.col("len"), -seen, F.col("w")], "w", max_kw, "keywords")
    empty = F.array().cast("array<string>")
    return (sums.join(syn, ["l1", "l2", "canonical"], "left").join(kw, ["l1", "l2", "canonical"], "left")
            .withColumns({"synonyms": F.coalesce("synonyms", empty), "keywords": F.coalesce("keywords", empty)}))


def taxonomy_feedback(whitelist: DataFrame, taxonomy: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Taxonomy counts after folding in reviewed triples: new pairs and labels enter, known labels
    gain their count. ``kind`` tells known, counted or new."""
    r = reviewed.select(labels.canonicalize_l1("l1").alias("l1"), text("l2").alias("l2"), text("l3").alias("l3")).filter((F.col("l2") != "") & (F.col("l3") != ""))
    add = r.groupBy("l1", "l2", "l3").agg(F.count(F.lit(1)).alias("add"))
    j = taxonomy.select("l1", "l2", "l3", "freq").join(add, ["l1", "l2", "l3"], "full")
    return j.select("l1", "l2", "l3", (F.coalesce("freq", F.lit(0)) + F.coalesce("add", F.lit(0))).cast("bigint").alias("freq"),
                    F.when(F.col("freq").isNull(), "new").when(F.col("add").isNull(), "known").otherwise("counted").alias("kind"))


def whitelist_feedback(whitelist: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The whitelist with the pairs that reviews added (after the listed ones, by name)."""
    new = reviewed.select(labels.canonicalize_l1("l1").alias("l1"), text("l2").alias("l2")).filter(F.col("l2") != "").distinct()
    fresh = new.join(whitelist.select("l1", "l2"), ["l1", "l2"], "left_anti").withColumn("listed", F.lit(False))
    return whitelist.select("l1", "l2", F.lit(True).alias("listed")).unionByName(fresh)


def historical_l2(df: DataFrame) -> DataFrame:
    """Distinct L2 seen per class in human, feed and JSON labels: one scan, three cells per row."""
    cell = lambda a, b: F.struct(labels.canonicalize_l1(a).alias("l1"), b.alias("l2"))
    cells = F.array(cell("review_l1", text("review_l2")), cell("model_class", labels.first_keyword("model_keyword")),
                    cell(json_text("v3_label_meta", "l1"), json_text("v3_label_meta", "l2")))
    return df.select(F.explode(cells).alias("c")).select("c.l1", "c.l2").filter(F.col("l2") != "").distinct()


def merged_l2_options(whitelist: DataFrame, hierarchy: DataFrame, history: DataFrame) -> DataFrame:
    """(l1, l2, position): whitelist order first, the rest by name. A class with nothing at all gets
    every hierarchy name."""
    u = whitelist.select("l1", "l2", F.col("pos").alias("p")).unionByName(hierarchy.select("l1", "l2", F.lit(None).cast("int").alias("p"))).unionByName(
        history.select("l1", "l2", F.lit(None).cast("int").alias("p")))
    o = u.groupBy("l1", "l2").agg(F.min("p").alias("p"))
    known = o.select("l1").distinct()
    classes = whitelist.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in lp.L1_ORDER])).alias("l1"))
    everything = hierarchy.agg(F.collect_set("l2").alias("a")).scalar()
    spare = classes.join(known, "l1", "left_anti").withColumn("_a", everything).select("l1", F.explode("_a").alias("l2"), F.lit(None).cast("int").alias("p"))
    from pyspark.sql import Window
    w = Window.partitionBy("l1").orderBy(F.asc_nulls_last("p"), F.asc("l2"))
    return o.unionByName(spare).withColumn("position", F.row_number().over(w)).drop("p")


def taxonomy_counts(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.groupBy("l1").agg(F.count_distinct("l2").alias("l2_count"), F.count_distinct("l2", "l3").alias("l3_count"))


def standard_validate(standard: DataFrame, whitelist: DataFrame, aliases: Mapping[str, str], expected: Mapping[str, int]) -> DataFrame:
    """(check, item, n) findings plus a closing ok row: repeats, a name under several parents, empty
    names, L2 neither listed nor aliased, and counts per class."""
    dup = standard.groupBy("l1", "l2", "l3").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate").alias("check"), F.concat_ws("/", "l1", "l2", "l3").alias("item"), "n")
    multi = standard.groupBy("l3").agg(F.count_distinct("l1", "l2").alias("n")).filter("n > 1").select(F.lit("multi_parent").alias("check"), F.col("l3").alias("item"), "n")
    empty = standard.filter(text("l3") == "").groupBy(F.concat_ws("/", "l1", "l2").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("empty_l3").alias("check"), "item", "n")
    lost = standard.select("l2").distinct().join(whitelist.select("l2"), "l2", "left_anti").filter(~F.col("l2").isin(*aliases) if aliases else F.lit(True)).select(
        F.lit("unmapped_l2").alias("check"), F.col("l2").alias("item"), F.lit(1).cast("bigint").alias("n"))
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    off = standard.groupBy("l1").agg(F.count(F.lit(1)).alias("n")).filter(F.coalesce(F.try_element_at(want, F.col("l1")), F.lit(-1)) != F.col("n")).select(
        F.lit("count").alias("check"), F.col("l1").alias("item"), "n")
    found = dup.unionByName(multi).unionByName(empty).unionByName(lost).unionByName(off)
    ok = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("check"), (F.col("n") == 0).cast("string").alias("item"), "n")
    return found.unionByName(ok)


def theme_map_validate(standard: DataFrame, theme_map: DataFrame, themes: DataFrame, lo: int = 30, hi: int = 45, fallback: str = "T99") -> DataFrame:
    """Coverage of the standard paths by the theme map and every reason why it would be refused."""
    paths = standard.select(F.concat_ws("/", "l1", "l2", "l3").alias("path")).distinct()
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n")).scalar()
    missing, invalid = paths.join(theme_map, "path", "left_anti"), theme_map.select("path").join(paths, "path", "left_anti")
    unknown = theme_map.join(themes, "theme_id", "left_anti")
    twice = theme_map.filter(F.array_contains("secondary", F.col("theme_id")))
    out = standard.sparkSession.range(1).select(n(paths).alias("path_count"), n(missing).alias("missing"), n(invalid).alias("invalid"), n(unknown).alias("unknown_theme"),
                                                n(twice).alias("primary_also_secondary"), n(themes.filter(F.col("theme_id") != fallback)).alias("formal_themes"),
                                                n(themes.filter(F.col("theme_id") == fallback)).alias("fallback_present"))
    cov = F.round((F.col("path_count") - F.col("missing")) / F.greatest("path_count", F.lit(1)), 4)
    bad = F.col("missing") + F.col("invalid") + F.col("unknown_theme") + F.col("primary_also_secondary")
    return out.withColumn("coverage", cov).withColumn("ok", (bad == 0) & F.col("formal_themes").between(lo, hi) & (F.col("fallback_present") > 0))
