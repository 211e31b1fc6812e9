"""Joins of intervals on hot keys, by bins, give the rows that every pair gives."""

import random

import pytest
from folioforge.operators import geometry as G
from folioforge.operators import joins as J


@pytest.fixture(autouse=True)
def hot(monkeypatch):
    monkeypatch.setattr(J, "HOT_ROWS", 5)


def _spans(rng, n, most):
    out = []
    for k in range(n):
        a = rng.randint(-most, most)
        out.append((rng.choice(["hot", "hot", "hot", f"k{k % 9}"]), a, a + rng.choice([0, 1, 3, 10, most]), k))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_range_first_and_overlap_anti(spark, seed):
    rng = random.Random(seed)
    ranges = _spans(rng, 60, 300)
    points = [(rng.choice(["hot", f"k{k % 9}", "none"]), rng.choice([None, rng.randint(-350, 350)]), k) for k in range(80)]
    r = spark.createDataFrame(ranges, "k string, s int, e int, o int")
    got = {x["n"]: x["f"] for x in J.range_first(spark.createDataFrame(points, "k string, at int, n int"), r, ["k"], "at", "s", "e", "o", "f").collect()}
    assert got == {n: min((o for q, s, e, o in ranges if q == k and at is not None and s <= at <= e), default=None) for k, at, n in points}
    rows = _spans(rng, 70, 300) + [("hot", None, None, 990), (None, 1, 2, 991)]
    got = sorted(x["n"] for x in J.overlap_anti(spark.createDataFrame(rows, "k string, a int, b int, n int"), r, ["k"], ("a", "b"), ("s", "e")).collect())
    assert got == sorted(n for k, a, b, n in rows if a is None or not any(q == k and a < e and s < b for q, s, e, _ in ranges))


def _boxes(rng, n):
    out = []
    for k in range(n):
        x, y = rng.uniform(0, 500), rng.uniform(0, 800)
        out.append((1, rng.choice([1, 1, 2 + k % 7]), k, x, x + rng.choice([2.0, 60.0, 400.0]), y, y + rng.choice([1.0, 40.0, 300.0])))
    return out


BOX = "doc_id int, page_no int, box_no int, x0 double, x1 double, y0 double, y1 double"


@pytest.mark.parametrize("seed", [4, 5])
def test_spatial_joins(spark, monkeypatch, seed):
    rng = random.Random(seed)
    a, b = spark.createDataFrame(_boxes(rng, 60), BOX), spark.createDataFrame(_boxes(rng, 50), BOX)
    words = a.selectExpr("*", "0 AS block_no", "0 AS line_no", "box_no AS word_no", "cast(box_no as string) AS text")
    rects = b.withColumnRenamed("box_no", "rect_no")

    def all_of():
        named = a.withColumnRenamed("box_no", "block")
        parts = [G.inner_items(named, b), G.nearest_below(named, b, 120), G.enclosing_bottom(named, b), G.clip_text(words, rects)]
        return [sorted(map(tuple, p.collect()), key=str) for p in parts]

    by_bins = all_of()
    monkeypatch.setattr(J, "HOT_ROWS", 10**9)
    assert by_bins == all_of() and all(by_bins)


def test_a_hot_key_is_linear(spark):
    """20,000 short ranges and 20,000 points of one key: a pair of each would be 400 million."""
    r = spark.range(20_000).selectExpr("'k' AS k", "cast(id * 10 as int) AS s", "cast(id * 10 + 12 as int) AS e", "cast(id as int) AS o")
    p = spark.range(20_000).selectExpr("'k' AS k", "cast(id * 10 + 1 as int) AS at", "id AS n")
    got = J.range_first(p, r, ["k"], "at", "s", "e", "o", "f")
    assert got.where("f = greatest(n - 1, 0)").count() == 20_000
