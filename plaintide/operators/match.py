"""Matching texts to gold rows and to the label taxonomy.

The taxonomy and its companions are dimensions of a few hundred labels. They are folded into one
row per (l1, l2) or per l1 with the labels as an array, so that a text meets its candidates in one
hash join, is scored inside its own row, and never fans out.
"""
from __future__ import annotations

from typing import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.functions import labels
from plaintide.functions.common import bound, collapse, hint_small, filled, strip, text, top_rows
from plaintide.functions.text import gold_key
from plaintide.operators import classify as C, rules as R
from plaintide.operators.automaton import Trie, find
from plaintide.operators.keyed import pick_per_key
from plaintide.packs import labels as lp

GENERIC = "通用"
PENDING_L3 = "其他-待归类"


def _grams(c: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
        pieces = F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, pieces).otherwise(F.array().cast("array<string>"))
    per = [of_size(n) for n in sizes]
    return F.array_distinct(F.concat(*per))


def label_dim(taxonomy: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key with ``labels``: array of (pos, l2, l3, grams, short, aliases, base)."""
    t = taxonomy if "aliases" in taxonomy.columns else taxonomy.withColumn("aliases", F.array().cast("array<string>"))
    base = F.least(F.lit(8.0), F.ln(F.lit(1.0) + F.greatest("freq", F.lit(1))))
    item = F.struct("pos", "l2", "l3", F.transform(_grams(F.col("l3"), (3, 4, 5, 6)), lambda g: F.lower(g)).alias("grams"),
                    F.when(F.length("l3") == 2, F.col("l3")).alias("short"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
                    base.alias("base"))
    return t.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("labels"))


def _label_score(t: Column, low: Column, x: Column, boost: float) -> Column:
    l3 = x["l3"]
    exact = F.when((l3 != "") & (F.contains(t, l3) | F.contains(low, F.lower(l3))), 120.0).otherwise(0.0)
    alias = F.size(F.filter(x["aliases"], lambda a: (F.length(strip(a)) >= 2) & (F.contains(low, F.lower(strip(a))) | F.contains(t, a)))) * 45.0
    grams = F.size(F.filter(x["grams"], lambda g: F.contains(low, g))) * 15.0
    short = F.when(x["short"].isNotNull() & F.contains(t, x["short"]), 5.0).otherwise(0.0)
    return exact + alias + grams + short + x["base"] + F.when(F.contains(t, x["l2"]), boost).otherwise(0.0)


def _best_label(t: Column, low: Column, labels_col: Column, boost: float) -> Column:
    """(score, -pos, l2, l3) of the best label. The lower-case text is made once, not for each fragment, and only where there are labels."""
    of = lambda b: F.array_max(F.transform(labels_col, lambda x: F.struct(
        _label_score(b["t"], b["low"], x, boost).alias("s"), (-x["pos"]).alias("p"), x["l2"].alias("l2"), x["l3"].alias("l3"))))
    return F.when(labels_col.isNotNull(), bound(F.struct(t.alias("t"), low.alias("low")), of))


def l3_score(df: DataFrame, taxonomy: DataFrame, body: str = "body", l1: str = "l1", l2: str = "l2",
             out: str = "routed", floor: float = 9.0, low: Column | None = None) -> DataFrame:
    """Best L3 inside (l1, l2) as a triple in ``out``; NULL under the floor. ``low``: the text in lower case, if it is at hand."""
    dims = label_dim(taxonomy, ["l1", "l2"]).select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), "labels")
    d = df.join(dims, (F.col(l1) == F.col("_a")) & (F.col(l2) == F.col("_b")), "left")
    d = d.withColumn("_best", _best_label(F.col(body), F.lower(F.col(body)) if low is None else low, F.col("labels"), 22.0))
    conf = F.least(F.lit(0.92), F.lit(0.52) + F.col("_best.s") / 200.0)
    hit = F.when(F.col("_best.s") >= floor, R.triple(F.col(l1), F.col("_best.l2"), F.col("_best.l3"), conf, "routed"))
    return d.withColumn(out, hit).drop("_a", "_b", "labels", "_best")


def l3_score_in_l1(df: DataFrame, taxonomy: DataFrame, body: str = "body", l1: str = "l1", out: str = "scored",
                   floor: float = 11.0, only: Column | None = None, low: Column | None = None) -> DataFrame:
    """Best L3 of the whole class as a triple; ``only`` limits the work to residual rows."""
    dims = label_dim(taxonomy, ["l1"]).select(F.col("l1").alias("_a"), "labels")
    cond = F.col(l1) == F.col("_a")
    d = df.join(dims, cond & only if only is not None else cond, "left")
    d = d.withColumn("_best", _best_label(F.col(body), F.lower(F.col(body)) if low is None else low, F.col("labels"), 28.0))
    conf = F.least(F.lit(0.92), F.lit(0.55) + F.col("_best.s") / 200.0)
    hit = F.when(F.col("_best.s") >= floor, R.triple(F.col(l1), F.col("_best.l2"), F.col("_best.l3"), conf, "scored"))
    return d.withColumn(out, hit).drop("_a", "labels", "_best")


def cluster_dim(clusters: DataFrame) -> DataFrame:
    item = F.struct("pos", "canonical", "keywords", "synonyms")
    return clusters.groupBy("l1", "l2").agg(F.array_sort(F.collect_list(item)).alias("clusters"))


def cluster_l3(df: DataFrame, clusters: DataFrame, body: str = "body", l1: str = "l1", l2: str = "l2", out: str = "clustered") -> DataFrame:
    """First cluster that shows in the text by its name, a keyword or a synonym."""
    dims = cluster_dim(clusters).select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), "clusters")
    d = df.join(dims, (F.col(l1) == F.col("_a")) & (F.col(l2) == F.col("_b")), "left")
    t = F.col(body)
    seen = lambda w: (F.length(w) >= 3) & F.contains(t, w)
    conf = lambda c: (F.when(seen(c["canonical"]), 0.66).when(F.exists(c["keywords"], seen), 0.63)
                      .when(F.exists(c["synonyms"], seen), 0.62).otherwise(0.0))
    scored = F.transform("clusters", lambda c: F.struct(c["canonical"].alias("l3"), conf(c).alias("c")))
    d = d.withColumn("_hit", F.get(F.filter(scored, lambda x: (x["l3"] != "") & (x["c"] > 0)), F.lit(0)))
    return d.withColumn(out, F.when(F.col("_hit").isNotNull(), R.triple(F.col(l1), F.col(l2), F.col("_hit.l3"), F.col("_hit.c"), "cluster_l3"))).drop(
        "_a", "_b", "clusters", "_hit")


def generic_dim(taxonomy: DataFrame) -> DataFrame:
    """Per (l1, l2): the generic label (exact name, else a name that says so, else the first one)."""
    rank = F.when(F.col("l3") == GENERIC, 0).when(F.col("l3").contains("无明确") | F.col("l3").contains(GENERIC), 1).otherwise(2)
    g = taxonomy.groupBy("l1", "l2").agg(F.min(F.struct(rank.alias("r"), "pos", "l3")).alias("m"))
    return g.select("l1", "l2", F.col("m.l3").alias("generic_l3"), F.when(F.col("m.r") <= 1, 0.48).otherwise(0.42).alias("generic_conf"))


def generic_l3(df: DataFrame, taxonomy: DataFrame, l1: str = "l1", l2: str = "l2", out: str = "generic") -> DataFrame:
    dims = generic_dim(taxonomy).select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), "generic_l3", "generic_conf")
    d = df.join(dims, (F.col(l1) == F.col("_a")) & (F.col(l2) == F.col("_b")), "left")
    return d.withColumn(out, F.when(F.col("generic_l3").isNotNull(), R.triple(F.col(l1), F.col(l2), F.col("generic_l3"), F.col("generic_conf"), "generic_l3"))).drop(
        "_a", "_b", "generic_l3", "generic_conf")


MAX_SYMBOLS = 4_000_000  # pattern symbols in one automaton, which travels to every task; some 24 bytes each
EXACT, LOWER, FRAGMENT = range(3)


def _label_tries(taxonomy: DataFrame, max_symbols: int) -> list[tuple[Trie, list]]:
    """Automata over whole labels, their lower-case forms and their fragments, each with the labels it names. A taxonomy of
    more symbols than one may hold is dealt to several by the label's hash; the driver sees one deal at a time."""
    t = taxonomy.filter(F.length("l3") > 0).select("pos", "l1", "l2", "l3", F.lower("l3").alias("low"))
    n = F.length("l3")
    own = F.when(F.col("low") == F.col("l3"), n).otherwise(n * 2)
    symbols = t.agg(F.coalesce(F.sum(own + F.greatest(n - 2, F.lit(0)) * 6), F.lit(0))).first()[0]
    deals, out = max(1, -(-symbols // max_symbols)), []
    for i in range(deals):
        rows = sorted(t.filter(F.pmod(F.xxhash64("l3"), F.lit(deals)) == i).collect(), key=lambda r: (r["pos"], r["l1"], r["l2"], r["l3"]))
        patterns, kinds, values = [], [], []
        for k, r in enumerate(rows):
            name = r["l3"]
            some = [(EXACT, name), (LOWER, r["low"])] if len(name) >= 2 else []
            some += [(FRAGMENT, name[at:at + size]) for size in (3, 4, 5, 6) for at in range(len(name) - size + 1)]
            for kind, word in some:
                patterns.append(word)
                kinds.append(kind)
                values.append(k)
        out.append((Trie.build(patterns, np.array(kinds, np.int64), np.array(values, np.int64), 3), [(r["pos"], r["l1"], r["l2"], r["l3"]) for r in rows]))
    return out


def exact_fuzzy_label(df: DataFrame, taxonomy: DataFrame, body: str = "body", out: str = "fuzzy", only: Column | None = None,
                      max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """A label found in the text (0.88, first in taxonomy order); else the longest, then leftmost
    label fragment of six to three characters (0.68).

    A text is read once, by an automaton over all labels and fragments; a taxonomy above ``max_symbols`` is dealt to several,
    and the best of their finds counts.
    """
    label = "struct<pos:int,l1:string,l2:string,l3:string>"

    def finder(shared) -> Callable:
        @F.pandas_udf(f"exact {label}, rank int, at int, part {label}")
        def run(raw: pd.Series, low: pd.Series) -> pd.DataFrame:
            trie, names = shared.value
            some = raw.notna().to_numpy()
            texts, lows = raw[some].tolist(), low[some].tolist()
            whole = np.minimum(find(trie, texts, EXACT)[0], find(trie, lows, LOWER)[0])
            part, length, at = find(trie, lows, FRAGMENT, longest=True)
            part[whole != Trie.NONE] = Trie.NONE
            rows = [(None, None, None, None)] * len(raw)
            for i, w, p, size, place in zip(np.flatnonzero(some).tolist(), whole.tolist(), part.tolist(), length.tolist(), at.tolist()):
                if w != Trie.NONE:
                    rows[i] = (_named(names[w]), None, None, None)
                elif p != Trie.NONE:
                    rows[i] = (None, -size, place, _named(names[p]))
            return pd.DataFrame(rows, columns=["exact", "rank", "at", "part"]).astype({"rank": "Int32", "at": "Int32"})
        return run
    # Each is at most MAX_SYMBOLS symbols.
    shared = [df.sparkSession.sparkContext.broadcast(x) for x in _label_tries(taxonomy, max_symbols)]
    t = F.col(body) if only is None else F.when(only, F.col(body))
    found = [f"_found{i}" for i in range(len(shared))]
    d = df.withColumns({c: finder(s)(t, F.lower(t)) for c, s in zip(found, shared)})
    least = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
    exact = least([F.when(F.col(f"{c}.exact").isNotNull(), F.col(f"{c}.exact")) for c in found])
    part = least([F.when(F.col(f"{c}.part").isNotNull(), F.struct(f"{c}.rank", f"{c}.at", f"{c}.part")) for c in found])
    d = d.withColumns({"_e": exact, "_z": part["part"]}).drop(*found)
    hit = (F.when(F.col("_e").isNotNull(), R.triple(F.col("_e.l1"), F.col("_e.l2"), F.col("_e.l3"), 0.88, "exact"))
           .when(F.col("_z").isNotNull(), R.triple(F.col("_z.l1"), F.col("_z.l2"), F.col("_z.l3"), 0.68, "fuzzy")))
    return d.withColumn(out, hit).drop("_e", "_z")


def _named(row: tuple) -> dict:
    return dict(zip(("pos", "l1", "l2", "l3"), row))


def gold_rows(reviewed: DataFrame) -> DataFrame:
    """One gold row per normalised text, the later row wins. Exact copies of one text, however many,
    collapse in the map-side part of the aggregate."""
    g = reviewed.filter(labels.is_reviewed() & filled("original_text") & filled("review_l1")).select(
        gold_key("original_text").alias("gold_key"), "id", labels.canonicalize_l1("review_l1").alias("gold_l1"),
        text("review_l2").alias("gold_l2"), text("review_l3").alias("gold_l3"))
    return pick_per_key(g, ["gold_key"], [F.col("id")]).drop("id")


def gold_lookup(df: DataFrame, gold: DataFrame, taxonomy: DataFrame, clusters: DataFrame, body: str = "original_text",
                out: str = "gold") -> DataFrame:
    """Triple of the gold row with the same text. Missing L2 takes the most frequent of the class,
    missing L3 the first cluster or the generic name."""
    return _gold_triple(df.withColumn("gold_key", gold_key(body)).join(gold, "gold_key", "left").drop("gold_key"), taxonomy, clusters, out)


def _gold_triple(d: DataFrame, taxonomy: DataFrame, clusters: DataFrame, out: str) -> DataFrame:
    freq = taxonomy.groupBy("l1", "l2").agg(F.sum("freq").alias("f"), F.min("pos").alias("p"))
    top = freq.groupBy("l1").agg(F.max(F.struct("f", (-F.col("p")).alias("p"), "l2")).alias("m")).select(F.col("l1").alias("_tl1"), F.col("m.l2").alias("_top_l2"))
    first = clusters.groupBy("l1", "l2").agg(F.min(F.struct("pos", "canonical")).alias("m")).select(
        F.col("l1").alias("_cl1"), F.col("l2").alias("_cl2"), F.col("m.canonical").alias("_first"))
    d = d.join(top, F.col("gold_l1") == F.col("_tl1"), "left")
    d = d.withColumn("_g2", F.coalesce(F.nullif("gold_l2", F.lit("")), "_top_l2", F.lit("")))
    d = d.join(first, (F.col("gold_l1") == F.col("_cl1")) & (F.col("_g2") == F.col("_cl2")), "left")
    l3 = F.coalesce(F.nullif("gold_l3", F.lit("")), "_first", F.lit(GENERIC))
    hit = F.when(F.col("gold_l1").isNotNull(), R.triple(F.col("gold_l1"), F.col("_g2"), l3, 0.99, "gold_review"))
    return d.withColumn(out, hit).drop("gold_l1", "gold_l2", "gold_l3", "_tl1", "_top_l2", "_g2", "_cl1", "_cl2", "_first")


def clean_hints(library: DataFrame, body: str = "原文", label: str = "人工复核结果", order: str = "舆情编号") -> DataFrame:
    """Normalised text to class, from clean-library rows whose class is recognised."""
    h = library.select(gold_key(body).alias("gold_key"), labels.try_canonicalize_l1(label).alias("hint_l1"), F.col(order).alias("_o")).filter(
        F.col("hint_l1").isNotNull())
    return h.groupBy("gold_key").agg(F.max_by("hint_l1", "_o").alias("hint_l1"))


def clean_hint(df: DataFrame, hints: DataFrame, body: str = "original_text") -> DataFrame:
    return df.withColumn("gold_key", gold_key(body)).join(hints, "gold_key", "left").drop("gold_key")


def nearest_in(candidate: Column, options: Column) -> Column:
    """The candidate if listed, else the option with the largest character-set Jaccard, first on a tie."""
    c = text(candidate)
    chars = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda y: y != ""))
    score = lambda o: F.size(F.array_intersect(chars(c), chars(o))) / F.greatest(F.lit(1), F.size(F.array_union(chars(c), chars(o))))
    best = F.array_max(F.transform(options, lambda o, i: F.struct(score(o).alias("s"), (-i).alias("p"), o.alias("o"))))["o"]
    return F.when(F.array_contains(options, c), c).otherwise(F.coalesce(best, c))


def nearest_for_import(candidate: Column, options: Column, aliases: Mapping[str, str]) -> Column:
    """Listed name, alias, unique prefix or unique containment; NULL otherwise."""
    c = text(candidate)
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    alias = F.try_element_at(table, c)
    one = lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))
    pref = F.filter(options, lambda o: F.startswith(o, c) | F.startswith(c, o))
    cont = F.filter(options, lambda o: F.contains(o, c) | F.contains(c, o))
    return (F.when(c == "", F.lit(None)).when(F.array_contains(options, c), c)
            .when(F.array_contains(options, alias), alias).otherwise(F.coalesce(one(pref), one(cont))))


def options_dim(whitelist: DataFrame) -> DataFrame:
    """(l1, options) with the whitelist order kept."""
    o = whitelist.groupBy("l1").agg(F.array_sort(F.collect_list(F.struct("pos", "l2"))).alias("o"))
    return o.select("l1", F.transform("o", lambda x: x["l2"]).alias("options"))


def nearest_label(df: DataFrame, whitelist: DataFrame, l1: str = "l1", l2: str = "l2", out: str = "nearest_l2") -> DataFrame:
    w = options_dim(whitelist).select(F.col("l1").alias("_a"), "options")
    return df.join(w, F.col(l1) == F.col("_a"), "left").withColumn(out, nearest_in(F.col(l2), F.col("options"))).drop("_a", "options")


def validate_triple(df: DataFrame, taxonomy: DataFrame, whitelist: DataFrame, clusters: DataFrame,
                    l1: str = "l1", l2: str = "l2", l3: str = "l3") -> DataFrame:
    """Adds v_l1, v_l2, v_l3: class canonical, L2 listed (nearest otherwise), L3 in the L2's list
    (generic or first otherwise)."""
    d = nearest_label(df.withColumn("v_l1", labels.canonicalize_l1(l1)), whitelist, "v_l1", l2, "v_l2")
    tags = taxonomy.groupBy("l1", "l2").agg(F.collect_set("l3").alias("tags")).select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), "tags")
    d = d.join(tags, (F.col("v_l1") == F.col("_a")) & (F.col("v_l2") == F.col("_b")), "left").drop("_a", "_b")
    g = generic_dim(taxonomy).select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), "generic_l3")
    d = d.join(g, (F.col("v_l1") == F.col("_a")) & (F.col("v_l2") == F.col("_b")), "left").drop("_a", "_b")
    first = clusters.groupBy("l1", "l2").agg(F.min(F.struct("pos", "canonical")).alias("m")).select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), F.col("m.canonical").alias("_first"))
    d = d.join(first, (F.col("v_l1") == F.col("_a")) & (F.col("v_l2") == F.col("_b")), "left").drop("_a", "_b")
    l3v = (F.when(F.col("tags").isNull(), F.coalesce(F.nullif(text(l3), F.lit("")), "_first", F.lit(GENERIC)))
           .when(F.array_contains("tags", F.col(l3)), F.col(l3)).otherwise(F.col("generic_l3")))
    return d.withColumn("v_l3", l3v).drop("tags", "generic_l3", "_first")


def standard_dim(standard: DataFrame, aliases: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per (l1, l2): candidates with bigrams and exclusion mark, and alias phrases with targets."""
    big = lambda c: F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    ex = excluded.select("l1", "l2", "l3", F.lit(True).alias("x")).distinct()
    s = standard.join(ex, ["l1", "l2", "l3"], "left").select("l1", "l2", F.struct(F.col("l3").alias("w"), F.col("l3").alias("target"), big(F.col("l3")).alias("b"), F.coalesce("x", F.lit(False)).alias("x")).alias("c"))
    al = aliases.join(ex, ["l1", "l2", "l3"], "left").join(standard.select("l1", "l2", F.col("l3").alias("target_l3")), ["l1", "l2", "target_l3"], "left_semi")
    exm = ex.select("l1", "l2", F.col("l3").alias("target_l3"), F.col("x").alias("tx"))
    al = al.join(exm, ["l1", "l2", "target_l3"], "left")
    a = al.select("l1", "l2", F.struct(F.col("l3").alias("w"), F.col("target_l3").alias("target"), big(F.col("l3")).alias("b"),
                                       (F.coalesce("x", F.lit(False)) | F.coalesce("tx", F.lit(False))).alias("x")).alias("c"))
    sa = s.groupBy("l1", "l2").agg(F.collect_list("c").alias("cands"))
    aa = a.groupBy("l1", "l2").agg(F.collect_list("c").alias("phrases"))
    return hint_small(sa.join(aa, ["l1", "l2"], "left"), standard, aliases)


def _best_standard(t: Column, items: Column) -> Column:
    """Longest contained name; else the most shared bigrams, then the longer, then text order."""
    sub = F.array_min(F.transform(F.filter(items, lambda c: (F.length(c["w"]) >= 2) & F.contains(t, c["w"])),
                                  lambda c: F.struct((-F.length(c["w"])).alias("a"), F.lit(0).alias("b"), c["w"].alias("w"), c["target"].alias("t"), c["x"].alias("x"))))
    n = lambda c: F.size(F.filter(c["b"], lambda g: F.contains(t, g)))
    need = lambda c: F.when(F.length(c["w"]) >= 4, 2).otherwise(F.greatest(F.lit(1), F.length(c["w"]) - 1))
    fz = F.array_min(F.transform(F.filter(items, lambda c: (F.length(c["w"]) >= 2) & (n(c) >= need(c))),
                                 lambda c: F.struct((-n(c)).alias("a"), (-F.length(c["w"])).alias("b"), c["w"].alias("w"), c["target"].alias("t"), c["x"].alias("x"))))
    return F.coalesce(sub, fz)


def l3_standard_resolve(df: DataFrame, dims: DataFrame, in_scope: Sequence[str], hot_l2: Sequence[str], body: str = "body",
                        l1: str = "l1", l2: str = "l2", out: str = "standard") -> DataFrame:
    """Standard L3 for in-scope classes: a candidate, else an alias target, never an excluded one;
    0.58 when found, else pending with 0.40; NULL outside the scope."""
    d = df.join(dims.select(F.col("l1").alias("_a"), F.col("l2").alias("_b"), "cands", "phrases"),
                (F.col(l1) == F.col("_a")) & (F.col(l2) == F.col("_b")), "left").drop("_a", "_b")
    t = F.coalesce(F.col(body), F.lit(""))
    d = d.withColumns({"_s": _best_standard(t, F.col("cands")), "_p": _best_standard(t, F.col("phrases"))})
    pick = F.coalesce(F.when(F.col("_s").isNotNull() & ~F.col("_s.x"), F.col("_s.w")), F.when(F.col("_p").isNotNull() & ~F.col("_p.x"), F.col("_p.t")))
    scope = F.col(l1).isin(*in_scope) & (F.col("cands").isNotNull() | F.col(l2).isin(*hot_l2))
    d = d.withColumn("_l3", pick)
    hit = F.when(scope, F.when(F.col("_l3").isNotNull(), R.triple(F.col(l1), F.col(l2), F.col("_l3"), 0.58, "standard_l3"))
                 .otherwise(R.triple(F.col(l1), F.col(l2), PENDING_L3, 0.40, "l3_pending")))
    return d.withColumn(out, hit).drop("cands", "phrases", "_s", "_p", "_l3")


def l3_resolution_report(df: DataFrame, dims: DataFrame, in_scope: Sequence[str], hot_l2: Sequence[str], body: str = "body") -> DataFrame:
    """Rows with a generic L3 and what the standard layer would make of them, with the gate."""
    generic = text("l3").isin("", GENERIC, PENDING_L3)
    r = l3_standard_resolve(df.withColumn("_gen", generic), dims, in_scope, hot_l2, body)
    mt = F.col("standard.match_type")
    out = r.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("_gen")).alias("generic_before"),
                count_if(F.col("_gen") & (mt == "standard_l3")).alias("fixed"), count_if(F.col("_gen") & (mt == "l3_pending")).alias("pending"),
                count_if(F.col("_gen") & mt.isNull()).alias("unchanged"))
    still = (F.col("generic_before") - F.col("fixed") - F.col("pending")) / F.greatest("rows", F.lit(1))
    return out.withColumns({"generic_rate": F.round(still, 4), "gate_ok": still <= 0.12})


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def match_cascade(df: DataFrame, pack: Mapping, taxonomy: DataFrame, clusters: DataFrame, gold: DataFrame | None = None,
                  hints: DataFrame | None = None, body: str = "original_text") -> DataFrame:
    """Label triple of each text in ``hit`` (NULL when nothing applies).

    Gold first; then pattern rules; then the class from a hint or the word score, its L2 route, the
    scored, clustered or generic L3 of that L2; then the best L3 of the class; then label
    fragments; then symptom defaults. The costly later stages join their dimension only for rows
    that no earlier stage settled. Gold and hints meet first, so that a text travels once; it is cleaned and lower-cased once, and
    its words are counted only where neither decides.
    """
    d = df.withColumn("body", collapse(F.coalesce(F.col(body), F.lit(""))))
    if gold is not None or hints is not None:
        met = gold.join(hints, "gold_key", "full") if gold is not None and hints is not None else hints if gold is None else gold
        d = d.withColumn("gold_key", F.md5("body")).join(met, "gold_key", "left").drop("gold_key")
    d = _gold_triple(d, taxonomy, clusters, "gold") if gold is not None else d.withColumn("gold", R.no_triple())
    d = d if hints is not None else d.withColumn("hint_l1", F.lit(None).cast("string"))
    d = d.withColumn("_low", F.when(F.col("gold").isNull(), F.lower("body")))
    low = F.col("_low")
    d = d.withColumn("_rule", F.when(F.col("gold").isNull(), C.priority_rules(F.col("body"), pack["priority"], low)))
    open1 = F.col("gold").isNull() & F.col("_rule").isNull() & (F.col("body") != "")
    d = d.withColumn("_ask", F.when(open1 & F.col("hint_l1").isNull(), F.col("body")))
    d = C.l1_keyword_score(d, "_ask", pack, "_scored_l1", F.when(F.col("_ask").isNotNull(), low)).drop("s_product", "s_service", "s_experience", "s_none", "_ask")
    d = d.withColumn("_l1", F.when(open1, F.coalesce("hint_l1", "_scored_l1")))
    d = d.withColumn("_l2", C.l2_route(F.col("body"), F.col("_l1"), pack, low))
    d = l3_score(d, taxonomy, "body", "_l1", "_l2", "_routed", 9.0, low=low)
    d = cluster_l3(d, clusters, "body", "_l1", "_l2", "_clustered")
    d = generic_l3(d, taxonomy, "_l1", "_l2", "_generic")
    # A route only counts when the taxonomy knows it, which is when the generic label exists.
    known = F.col("_generic").isNotNull()
    d = d.withColumn("_stage1", F.when(known, F.coalesce("_routed", "_clustered", "_generic")))
    d = l3_score_in_l1(d, taxonomy, "body", "_l1", "_inl1", 11.0, only=F.col("_stage1").isNull(), low=low).drop("_low")
    open2 = F.col("_l1").isNotNull() & F.col("_stage1").isNull() & F.col("_inl1").isNull()
    d = exact_fuzzy_label(d, taxonomy, "body", "_fuzzy", only=open2)
    rest = F.when(F.col("_l1").isNotNull(), F.coalesce(C.generic_fallback(F.col("body"), F.col("_l1"), pack), C.weak_fallback(F.col("body"), F.col("_l1"), pack)))
    d = d.withColumn("_m", F.coalesce("_rule", "_stage1", "_inl1", "_fuzzy", rest))
    named = F.when(F.col("_m").isNotNull() & F.col("hint_l1").isNotNull(), R.triple(F.col("_m.l1"), F.col("_m.l2"), F.col("_m.l3"), F.col("_m.confidence"), "clean_l1")).otherwise(F.col("_m"))
    return d.withColumn("hit", F.coalesce("gold", named)).drop(
        "body", "gold", "hint_l1", "_rule", "_scored_l1", "_l1", "_l2", "_routed", "_clustered", "_generic", "_stage1", "_inl1", "_fuzzy", "_m")


def batch_classify(df: DataFrame, pack: Mapping, taxonomy: DataFrame, clusters: DataFrame, whitelist: DataFrame,
                   gold: DataFrame | None = None, hints: DataFrame | None = None, insight_rules=None) -> DataFrame:
    """The whole rule path on a batch: cascade, whitelist guard, conflict check, insight fields,
    stored columns, review routing. The columns that ``evaluate.route_metrics`` reads are kept."""
    from plaintide.functions.insight import attach_insight, with_insight_fields
    from plaintide.functions.meta import materialized
    from plaintide.packs import insight as pk

    d = match_cascade(df, pack, taxonomy, clusters, gold, hints)
    d = d.withColumns({"empty_text": strip(F.coalesce("original_text", F.lit(""))) == "", "match_type": F.coalesce("hit.match_type", F.lit("none")),
                       "l1": F.coalesce("hit.l1", F.lit("")), "l2": F.coalesce("hit.l2", F.lit("")), "l3": F.coalesce("hit.l3", F.lit("")),
                       "confidence": F.coalesce("hit.confidence", F.lit(0.0)), "needs_review": F.lit(False)}).drop("hit")
    d = d.withColumn("_gold", F.struct("l1", "l2", "confidence"))
    d = C.l2_whitelist_guard(d, options_dim(whitelist), pack)
    is_gold = F.col("match_type") == "gold_review"
    d = d.withColumns({"l1": F.when(is_gold, F.col("_gold.l1")).otherwise(F.col("l1")), "l2": F.when(is_gold, F.col("_gold.l2")).otherwise(F.col("l2")),
                       "confidence": F.when(is_gold, F.col("_gold.confidence")).otherwise(F.col("confidence")),
                       "needs_review": F.col("needs_review") & ~is_gold,
                       "guard": (F.col("positive_capture") | F.col("l2_whitelist_reject") | F.col("l2_consult_guard")) & ~is_gold}).drop(
        "_gold", "positive_capture", "l2_whitelist_reject", "l2_consult_guard")
    may = ~F.col("match_type").isin("gold_review", "classify_error", "none") & ~F.col("needs_review")
    d = d.withColumn("conflict_kind", F.when(may, C.rule_conflict(F.col("l1"), F.coalesce("original_text", F.lit("")), pack["conflicts"], pack["conflict_groups"])).otherwise(""))
    d = d.withColumn("was_conflict", F.col("conflict_kind") != "")
    hitc = F.col("was_conflict")
    d = d.withColumns({"confidence": F.when(hitc, F.least("confidence", F.lit(0.40))).otherwise(F.col("confidence")), "needs_review": F.col("needs_review") | hitc})
    d = with_insight_fields(d, rules=insight_rules or pk.DEFAULT)
    keys = ("intent", "expected_action", "severity", "urgency", "repeat_signal", "root_cause_hint")
    core = F.to_json(F.struct("l1", "l2", "l3", F.col("confidence").cast("string").alias("confidence"), "match_type"))
    d = d.withColumn("v3_label_meta", attach_insight(core, {k: F.col(k) for k in keys}))
    d = d.withColumns(materialized("v3_label_meta"))
    status = F.col("review_status") if "review_status" in df.columns else F.lit(0)
    return d.withColumn("review_status", F.when(F.col("empty_text"), status).otherwise(C.review_routing(status, F.col("needs_review"), F.col("confidence"))))


def fewshot_examples(queries: DataFrame, reviewed: DataFrame, key: str = "qid", body: str = "text", newest: int = 24, top: int = 4,
                     fallback: int = 20, n_salt: int | None = None, n_words: int | None = 6, word_chars: int | None = None, shared_chars: int | None = None,
                     shown_chars: int | None = None) -> DataFrame:
    """For each text: the reviewed rows that contain any of its first ``n_words`` different words, the ``newest`` of
    them, the ``top`` that share the most characters; the newest ``fallback`` rows if none contains any. Words and
    characters are taken from whole texts, or from their first ``word_chars`` and ``shared_chars``.

    No text meets a text. Words of the reviewed rows are reduced to a vocabulary with the newest 24
    rows of each word; a query word is found inside vocabulary words through its rarest two-letter
    piece and then verified. Keeping 24 rows per word loses nothing, because only the newest 24 rows
    of the union are asked for.
    """
    lo = lambda c: F.lower(c)
    runs = lambda c: F.array_distinct(F.regexp_extract_all(lo(c), F.lit("([\\u4e00-\\u9fff]{2,}|[a-z]{2,})"), F.lit(1)))
    first = lambda c, n: c if n is None else F.substring(c, 1, n)
    q = queries.select(key, F.col(body).alias("_q"))
    # Words are told apart as they are written, then lower-cased.
    written = F.array_distinct(F.regexp_extract_all(first(F.col("_q"), word_chars), F.lit("([\\u4e00-\\u9fff]{2,}|[A-Za-z]{2,})"), F.lit(1)))
    qt = q.select(key, F.explode(F.array_distinct(F.transform(written if n_words is None else F.slice(written, 1, n_words), lo))).alias("tok"))
    when = F.coalesce(F.nullif("reviewed_at", F.lit("")), F.col("create_time"), F.lit(""))
    rev = reviewed.filter(labels.is_reviewed() & filled("review_l1") & filled("review_l2")).select(
        "id", when.alias("ts"), F.col("original_text").alias("sample"), labels.canonicalize_l1("review_l1").alias("l1"), text("review_l2").alias("l2"))
    words = rev.select("id", "ts", F.explode(runs(F.col("sample"))).alias("word"))
    post = top_rows(words, ["word"], [F.desc("ts"), F.desc("id")], newest, salt_by=["id"], n_salt=n_salt).drop("rn")
    vocab = post.select("word").distinct()
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))
    inv = vocab.select("word", F.explode(pieces(F.col("word"))).alias("piece"))
    df_piece = inv.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    toks = qt.select("tok").distinct()
    rare = (toks.select("tok", F.explode(pieces(F.col("tok"))).alias("piece")).join(df_piece, "piece", "left")
            .groupBy("tok").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece")))
    inside = rare.join(inv, "piece").filter(F.contains("word", F.col("tok"))).select("tok", "word")
    rows = inside.join(post, "word").select("tok", "id", "ts").distinct()
    per_tok = top_rows(rows, ["tok"], [F.desc("ts"), F.desc("id")], newest, salt_by=["id"], n_salt=n_salt).drop("rn")
    cand = qt.join(per_tok, "tok").select(key, "id", "ts").distinct()
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id"))
    cand = cand.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest)
    newest_rows = rev.select("id", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(fallback)
    listed = newest_rows.agg(F.collect_list(F.struct("ts", "id")).alias("a")).scalar()
    lone = q.select(key).join(cand.select(key).distinct(), key, "left_anti").withColumn("_r", F.explode(listed))
    lone = lone.select(key, F.col("_r.id").alias("id"), F.col("_r.ts").alias("ts"))
    allc = cand.select(key, "id", "ts").unionByName(lone)
    chars = lambda c: F.array_distinct(F.split(first(c, shared_chars), ""))
    full = allc.join(rev.drop("ts"), "id").join(q, key)
    full = full.withColumn("shared", F.size(F.filter(F.array_intersect(chars(F.col("_q")), chars(F.col("sample"))), lambda x: x != "")))
    w2 = Window.partitionBy(key).orderBy(F.desc("shared"), F.desc("ts"), F.desc("id"))
    return (full.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= top)
            .select(key, "rank", "id", "shared", first(F.col("sample"), shown_chars).alias("text"), "l1", "l2"))


def label_audit_import(sheet: DataFrame, table: DataFrame, whitelist: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Audit rows (opinion_id, new_l1, new_l2) checked and compared with the stored labels.
    ``outcome``: empty, invalid:<why>, unknown_id, same or change."""
    s = sheet.select(text("opinion_id").alias("opinion_id"), text("new_l1").alias("_l1"), text("new_l2").alias("_l2")).filter(F.col("opinion_id") != "")
    s = s.withColumn("new_l1", labels.canonical_or_blank("_l1"))
    s = s.join(options_dim(whitelist).select(F.col("l1").alias("_a"), "options"), F.col("new_l1") == F.col("_a"), "left").drop("_a")
    table_map = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    named = F.coalesce(F.try_element_at(table_map, F.col("_l2")), F.col("_l2"))
    fixed = F.when(F.col("options").isNull() | F.array_contains("options", named), named).otherwise(nearest_for_import(named, F.col("options"), aliases))
    s = s.withColumn("new_l2", F.when(F.col("_l2") == "", "").otherwise(fixed))
    why = (F.when((F.col("_l1") == "") & (F.col("_l2") == ""), "empty").when(F.col("_l1") == "", "invalid:no_l1")
           .when((F.col("_l2") == "") & (F.col("new_l1") != lp.NON_ISSUE), "invalid:no_l2").when(F.col("new_l2").isNull(), "invalid:not_listed"))
    old = table.groupBy("opinion_id").agg(F.max_by(F.struct(text("review_l1").alias("old_l1"), text("review_l2").alias("old_l2")), "id").alias("o"))
    j = s.withColumn("_why", why).join(old, "opinion_id", "left")
    same = (F.col("o.old_l1") == F.col("new_l1")) & (F.col("o.old_l2") == F.col("new_l2"))
    return j.select("opinion_id", "new_l1", "new_l2", F.col("o.old_l1").alias("old_l1"), F.col("o.old_l2").alias("old_l2"),
                    F.coalesce("_why", F.when(F.col("o").isNull(), "unknown_id").when(same, "same").otherwise("change")).alias("outcome"))
