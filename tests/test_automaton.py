"""The pattern automaton and the label stage that uses it, against plain search."""
import random

import numpy as np
import pytest

from plaintide.operators import match as M
from plaintide.operators.automaton import Trie, codes, find


def test_finds_what_plain_search_finds():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcÄ你 😀") for _ in range(n))
    patterns = sorted({word(rnd.randint(1, 5)) for _ in range(120)}) + [""]
    kinds = np.array([i % 2 for i in range(len(patterns))])
    trie = Trie.build(patterns, kinds, np.arange(len(patterns)), 2)
    texts = [word(rnd.randint(0, 60)) for _ in range(300)] + ["", "zzz", patterns[5], "a" * 5000]
    for kind in (0, 1):
        mine = [(i, p) for i, p in enumerate(patterns) if p and kinds[i] == kind]
        least = [min((i for i, p in mine if p in t), default=Trie.NONE) for t in texts]
        assert find(trie, texts, kind)[0].tolist() == least
        value, length, place = find(trie, texts, kind, longest=True)
        for k, t in enumerate(texts):
            best = min(((-len(p), t.find(p), i) for i, p in mine if p in t), default=None)
            assert (value[k] == Trie.NONE) if best is None else (-length[k], place[k], value[k]) == best


def test_no_patterns_and_no_texts():
    none = Trie.build([], np.zeros(0, int), np.zeros(0, int), 1)
    assert find(none, ["abc", ""], 0)[0].tolist() == [Trie.NONE] * 2
    assert len(find(none, [], 0)[0]) == 0 and codes([])[0].tolist() == []


def plain(taxonomy, text):
    for pos, l1, l2, l3 in taxonomy:
        if len(l3) >= 2 and (l3 in text or l3.lower() in text.lower()):
            return l3, 0.88
    best = None
    for pos, l1, l2, l3 in taxonomy:
        for size in (6, 5, 4, 3):
            for i in range(len(l3) - size + 1):
                at = text.lower().find(l3[i:i + size])
                if at >= 0 and (best is None or (-size, at, pos) < best[0]):
                    best = ((-size, at, pos), l3)
    return (best[1], 0.68) if best else (None, None)


@pytest.mark.parametrize("max_symbols", [4_000_000, 500])
def test_labels_in_texts(spark, max_symbols):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdeFG ") for _ in range(n))
    taxonomy = [(i, "c", f"d{i % 3}", word(rnd.randint(1, 9))) for i in range(80)] + [(80, "c", "d0", ""), (81, "c", "d0", "abcdeF")]
    texts = [word(rnd.randint(0, 9)) for _ in range(400)] + ["", "xabcdefx"]
    t = spark.createDataFrame(taxonomy, "pos int, l1 string, l2 string, l3 string")
    d = spark.createDataFrame([*enumerate(texts), (999, None)], "id long, body string")
    got = {r["id"]: r["fuzzy"] for r in M.exact_fuzzy_label(d, t, max_symbols=max_symbols).collect()}
    for i, x in enumerate(texts):
        l3, conf = plain(taxonomy, x)
        assert (got[i] and (got[i]["l3"], got[i]["confidence"])) == (l3 and (l3, conf)), x
    assert got[999] is None and len({v["match_type"] for v in got.values() if v}) == 2
    gated = M.exact_fuzzy_label(d, t, only=d["id"] < 5).filter("id >= 5 AND fuzzy IS NOT NULL")
    assert gated.count() == 0
