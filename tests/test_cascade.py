"""The cascade reads a text once: it is cleaned, lower-cased and sent once, and plain words are found without patterns."""
import re

from pyspark.sql import functions as F

from plaintide.functions.common import WS, WS_RUN, swapped
from plaintide.operators import match as M, rules as R
from plaintide.packs.prose import PACK
from plaintide.plans import labelling as L


def _cascade(spark, rows, gold, hints):
    d = spark.createDataFrame(rows, "id int, original_text string")
    g = spark.createDataFrame(gold, "t string, gold_l1 string, gold_l2 string, gold_l3 string").select(
        F.md5("t").alias("gold_key"), "gold_l1", "gold_l2", "gold_l3") if gold else None
    h = spark.createDataFrame(hints, "t string, hint_l1 string").select(F.md5("t").alias("gold_key"), "hint_l1") if hints else None
    return M.match_cascade(d, PACK, L.taxonomy(spark), L.clusters(spark), g, h)


ROWS = [(1, "known  text"), (2, " known\ttext"), (3, "heard before"), (4, "Both\n of them"), (5, ""), (6, None), (7, "zZzQ eauré"), (8, "Tionou ment"), (9, "chſch ſchSch")]
GOLD = [("known text", "服务类", "L2-1", ""), ("Both of them", "服务类", "L2-3", "x")]
HINTS = [("heard before", "体验需求类"), ("Both of them", "非问题"), ("zZzQ eauré", "服务类")]


def _found(df):
    return {r["id"]: r["hit"] and (r["hit"]["l1"], r["hit"]["l3"], r["hit"]["match_type"]) for r in df.collect()}


def test_gold_and_hints_meet_first_and_decide_as_before(spark):
    both = _found(_cascade(spark, ROWS, GOLD, HINTS))
    assert both[1] == both[2] == ("服务类", "lichsch", "gold_review") and both[4] == ("服务类", "x", "gold_review")
    assert both[3][2] == both[7][2] == "clean_l1" and both[7][1] == "rare" and both[5] is None and both[6] is None
    assert both[8] == ("产品质量类", "menter", "routed") and both[9] == ("非问题", "rare", "rule")  # the long s is an s
    one, other, none = (_found(_cascade(spark, ROWS, g, h)) for g, h in ((GOLD, None), (None, HINTS), (None, None)))
    open_ = {5, 6, 8, 9}
    for got, gold, hint in ((one, True, False), (other, False, True), (none, False, False)):
        assert {i: got[i] for i in open_} == {i: both[i] for i in open_}
        assert (got[1] == both[1]) == gold and (got[3] == both[3]) == hint
    assert other[4][2] == "clean_l1" and one[7] == ("非问题", "rare", "rule")


def test_a_text_travels_once_and_is_lowered_outside_of_loops(spark, sf):
    import __spark_entry__ as e
    plan = e.queries()["match_cascade"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join LeftOuter, \(gold_key", plan)) == 1
    assert "Contains(lower(body" not in plan


def test_runs_of_white_space_are_those_of_the_full_class(spark):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = [("a".join(points[i:i + 4096]),) for i in range(0, len(points), 4096)] + [(" 　\t\x85a \n",)]
    d = spark.createDataFrame(rows, "t string")
    assert d.filter(F.regexp_replace("t", WS + "+", "-") != F.regexp_replace("t", WS_RUN, "-")).count() == 0


def test_plain_words_are_found_as_their_patterns_are(spark):
    rules = [{"parts": (f"q{c}q|q{c}{c}q",), "l1": "a", "l2": "b", "l3": c, "confidence": 0.5, "deny": f"{c}z"} for c in "abcdefghijklmnopqrstuvwxyz"]
    rules += [{"parts": ("k.s", "end"), "l1": "a", "l2": "b", "l3": "pattern", "confidence": 0.5, "deny": ""}]
    rows = [(f"q{chr(i)}q",) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + [("QſſQ",), ("qſq ſZ",), ("K-ſ END",), (None,), ("",)]
    d = spark.createDataFrame(rows, "t string").select("t", R.first_rule(F.lower("t"), rules)["l3"].alias("a"), R.first_rule_lower(F.lower("t"), rules)["l3"].alias("b"))
    assert d.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    assert d.filter("b is not null").count() > 52
    s = spark.createDataFrame([("aİbıc\x0b",), ("abc",), (None,)], "t string").select(swapped(F.col("t"), "İı\x0b", "�" * 3)).collect()
    assert [r[0] for r in s] == ["a�b�c�", "abc", None]
