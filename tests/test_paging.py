"""Pages by ranges against the whole order."""
import random

import pytest

from plaintide.operators.paging import By, page_rows


def whole(rows, order):
    for b, i in reversed(order):
        known = sorted([r for r in rows if r[i] is not None], key=lambda r: r[i], reverse=b.descending)
        rows = known + [r for r in rows if r[i] is None]
    return rows


@pytest.mark.parametrize("near", [5, 10_000])
def test_pages_equal_the_whole_order(spark, near):
    rnd = random.Random(6)
    day = lambda: rnd.choice([None, "", "2024-01-02 10:00:00", "2024-01-02 10:00:01", f"2024-0{rnd.randint(1, 9)}-11", "2023", "x" * 30, "ü"])
    rows = [(day(), rnd.choice([None, "OP1", "OP12", "OP2", "é"]), i if i % 9 else -10 ** 12 * i) for i in range(400)]
    df = spark.createDataFrame(rows, "t string, o string, id long").repartition(5)
    for order in ([(By("t", True, (4, 7, 10)), 0), (By("o", True), 1), (By("id", True), 2)], [(By("o"), 1), (By("id"), 2)], [(By("id", True), 2)]):
        want = whole(rows, order)
        for page, size in ((3, 40), (14, 29), (41, 10)):
            got, total = page_rows(df, [b for b, _ in order], page, size, near)
            assert total == 400 and [tuple(r) for r in got.collect()] == want[(page - 1) * size:page * size]


def test_no_rows(spark):
    got, total = page_rows(spark.createDataFrame([], "t string, id long"), [By("t"), By("id")], 1, 20)
    assert total == 0 and got.count() == 0


def test_a_late_page_reads_one_range(spark):
    """Page 10,000 of a million rows: what is left to be sorted is a part of one range."""
    df = spark.range(1_000_000).selectExpr("concat('2024-01-', lpad(1 + id % 28, 2, '0')) AS t", "id")
    got, total = page_rows(df, [By("t", True, (4, 7, 10)), By("id", True)], 10_000, 20)
    offset = 9_999 * 20
    per = {d: sum(1 for _ in range(d - 1, 1_000_000, 28)) for d in range(1, 29)}
    for d in range(28, 0, -1):
        if offset < per[d]:
            break
        offset -= per[d]
    last = max(range(d - 1, 1_000_000, 28)) - 28 * offset
    assert total == 1_000_000 and [(r["t"], r["id"]) for r in got.collect()] == [(f"2024-01-{d:02d}", last - 28 * i) for i in range(20)]
