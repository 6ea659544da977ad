"""Many patterns at once against each pattern alone; the default pack's decision list."""
import random
import re

import pytest

from plaintide.operators import signals as sg
from plaintide.packs import default_rules, prose
from plaintide.packs.capture import BLOCKED, CAPTURE, ELIGIBLE, SIGNALS
from plaintide.plans.defaultpack import SENTENCES


@pytest.mark.parametrize("pattern,match,want", [
    (r"ab+cde", "abbcde", {"cde"}), (r"(ab|cd)e", "cde", {"ab", "cd"}), (r"x?yy(?:z|w)", "yyw", {"yy"}), (r"a.{0,3}bcd", "a..bcd", {"bcd"}), (r"[款订]退", "订退", {"退"}),
    (r"(?<!k)ABC(?!d)", "abc", {"abc"}), (r"a*", "", None), (r"(a|b*)", "a", None), (r"^[\s]*(很好|好)+$", "好很好", {"很好", "好"})])
def test_literals_of_a_pattern(pattern, match, want):
    got = sg.literals(pattern)
    assert got == want and re.search(pattern, match, re.I) and (got is None or any(x in match.lower() for x in got))


def test_every_signal_equals_its_pattern_alone():
    rnd = random.Random(4)
    pool = [s for s in SENTENCES if s] + ["OTA", "SEO优化", "Lotus的审美和底盘调教", "repair  plan", "ſeo优化", " ", "\n", "。", "！"]
    texts = ["".join(rnd.choice(pool)[:rnd.randint(1, 30)] for _ in range(rnd.randint(0, 6))) for _ in range(700)] + SENTENCES
    found = sg.Signals(SIGNALS).found(texts)
    for name, pattern in SIGNALS.items():
        alone = [re.search(pattern, t, re.I) is not None for t in texts]
        assert found[name].tolist() == alone, name
    assert sum(f.any() for f in found.values()) > 0.6 * len(SIGNALS)


def test_each_code_is_reached():
    """Two codes stand behind an earlier one that holds whenever they do."""
    code, eligible = sg.decide(CAPTURE, SENTENCES + ["没有 车 的 旁边"])
    reached = {"blocked:" + n for n, _ in BLOCKED} | {"eligible:" + n for n, _ in ELIGIBLE} - {"eligible:aftersale_praise", "eligible:biz_boundary_praise"}
    assert reached <= set(code) and {"empty_text", "no_capture_pattern"} <= set(code)
    assert all(c.startswith("eligible") for c, e in zip(code, eligible) if e)


@pytest.mark.parametrize("text,code", [
    ("期待", "eligible:short_intent"), ("期待 。", "eligible:short_intent"), ("好", "eligible:short_benign"), ("", "empty_text"), ("　\n", "empty_text"),
    ("很烫", "blocked:hard_negative"), ("因你们而滚烫", "no_capture_pattern"), ("不专业", "blocked:negation"), ("特别好", "no_capture_pattern"),
    ("有空闲工位吗", "eligible:v98_no_capture"),
    ("知晓了" + "一" * 40, "no_capture_pattern"), ("试驾回访", "eligible:testdrive_followup")])
def test_codes(text, code):
    assert sg.decide(CAPTURE, [text.strip()])[0][0] == code


def test_named_but_not_eligible():
    term = {"signals": {"a": "aa", "b": "bb"}, "terms": {}, "blocked": [], "eligible": [("one", "a"), ("two", "b")], "named_only": {"one": "b"}}
    code, ok = sg.decide(term, ["aa", "aabb", "bb", "c"])
    assert list(code) == ["eligible:one", "eligible:one", "eligible:two", "no_capture_pattern"] and ok.tolist() == [True, True, True, False]
    term["eligible"] = [("one", "a")]
    assert sg.decide(term, ["aabb"])[1].tolist() == [False]


def test_packs_have_one_form(spark):
    df = spark.createDataFrame([(1, "schsch the"), (2, "the"), (3, None)], "id long, t string")
    from plaintide.operators import classify as C
    got = {r["id"]: (r["capture"], r["capture_ok"]) for r in C.capture_code(df, "t", prose.PACK).collect()}
    assert got == {1: ("blocked:neg", False), 2: ("eligible:short", True), 3: ("empty_text", False)}
    assert default_rules.PACK["capture"] is CAPTURE


def test_slices_are_bounded_by_rows_and_symbols():
    """Long texts are not walked together, and no text is lost."""
    import pandas as pd

    from plaintide.operators.automaton import CHUNK
    from plaintide.operators.signals import ROWS, slices

    texts = ["a"] * 600 + ["b" * (CHUNK // 2 + 1)] * 3 + ["c" * (2 * CHUNK), ""]
    got = list(slices(pd.Series(texts)))
    assert sum(got, []) == texts and list(slices(pd.Series([], dtype=object))) == []
    assert all(len(g) <= ROWS and (len(g) == 1 or sum(map(len, g)) <= CHUNK) for g in got)
