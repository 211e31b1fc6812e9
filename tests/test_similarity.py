"""Fuzzy joins find what scoring every pair finds."""

import difflib
import random
from collections import Counter

import numpy as np
import pytest
from folioforge.operators import similarity as M


def ratio(a, b):
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def _texts(seed, n, most=60, letters="ab cd"):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(12)]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))[:most] for _ in range(n)]


def test_bounds_hold_and_close():
    texts = _texts(1, 50) + ["", "x" * 300, ("the quick brown fox " * 20)[:350], "the slow brown dog " * 18]
    for b in texts:
        m = M.Bounds()
        m.second(b)
        for a in texts:
            r = ratio(a, b)
            low, high = m.narrow(a, lambda *_: True)
            assert low <= r <= high and m.narrow(a, lambda *_: False) == (r, r)
            for least in (0.3, r, 0.55, 0.9):
                assert m.ratio(a, least) == (r if r >= least else None)
            cuts = [0.2, 0.4, 0.6]
            assert [m.within(a, cuts) >= c for c in cuts] == [r >= c for c in cuts]


def test_no_ratio_is_above_the_signatures_bound(spark):
    pairs = [(a, b) for a in _texts(2, 12) for b in _texts(3, 12)]
    df = M.added(M.added(spark.createDataFrame(pairs, "a string, b string"), "s", M.T.ArrayType(M.T.IntegerType()), M._signature, "a"), "t", M.T.ArrayType(M.T.IntegerType()), M._signature, "b")
    rows = df.select("a", "b", M.upper_bound(M.F.col("s"), M.F.col("t"), M.F.length("a") + M.F.length("b")).alias("m")).collect()
    assert len(rows) == len(pairs) and all(r["m"] >= ratio(r["a"], r["b"]) for r in rows)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("prefix", [None, 20])
def test_best_match(spark, prefix, inclusive):
    left = [(d, i, t) for d in "xyz" for i, t in enumerate(_texts(ord(d), 14) + [None, "", "abab", "abcd"])]
    right = [(d, i, t) for d in "xyw" for i, t in enumerate(_texts(ord(d) + 1, 10) + ["abab", "abab", None, "abba"])]
    a = spark.createDataFrame(left, "d string, l int, s string").withColumn("key", M.F.struct("d", "l"))
    b = spark.createDataFrame(right, "d string, r int, t string")
    for least in (0.3, 0.5):
        got = {(x["d"], x["l"]): (x["r"], x["similarity"]) for x in M.best_match(a, b, ["d"], "s", "t", "key", "r", least, prefix, inclusive).select("key.*", "r", "similarity").collect()}
        want = {}
        for d, i, s in left:
            scored = [(ratio((s or "")[:prefix], (t or "")[:prefix]), -j) for e, j, t in right if e == d]
            scored = [x for x in scored if x[0] > least or (inclusive and x[0] == least)]
            if scored:
                want[(d, i)] = (-max(scored)[1], max(scored)[0])
        assert got == want


def test_a_hot_block(spark):
    texts = _texts(9, 120)
    a = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "d string, l int, s string")
    b = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts[::-1])], "d string, r int, t string")
    got = {r["l"]: r["similarity"] for r in M.best_match(a, b, ["d"], "s", "t", "l", "r", 0.3).collect()}
    assert all(got[i] == 1.0 for i in range(120))


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ITEMS", 5)
    monkeypatch.setattr(M, "BLOCK_LINES", 7)
    items, lines = list(enumerate(_texts(4, 17) + [None])), list(enumerate(_texts(5, 40) + ["", None]))
    i, n = spark.createDataFrame(items, "i int, s string"), spark.createDataFrame(lines, "n int, t string")
    want = {}
    for k, s in items:
        best = max(((ratio(s, t), -j) for j, t in lines if t is not None), default=(0, 0)) if s is not None else (0, 0)
        if best[0] > 0.4:
            want[k] = (-best[1], best[0])
    assert {r["i"]: (r["n"], r["similarity"]) for r in M.best_of_all(i, n, "s", "t", "i", "n", 0.4).collect()} == want
    assert M.best_of_all(i.limit(0), n, "s", "t", "i", "n", 0.4).count() == 0


def _matched(a, b):
    return sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


@pytest.mark.parametrize("letters", ["ab", "ab cd", "abcdefgh é😀"])
def test_pairs_side_by_side_match_what_difflib_matches(letters, monkeypatch):
    from folioforge.operators import ratios as R

    monkeypatch.setattr(R, "TABLE_BYTES", 40_000)  # several batches
    first = _texts(11, 12, 300, letters) + ["", "x", "abab"]
    lines = _texts(12, 30, 199, letters) + ["", "abab", "ZZ", "b" * 199]
    f = R.Firsts(first)
    coded = [f.coded(R.codes(x)) for x in lines]
    seen = set()
    for batch in R.batches(f, coded):
        s = R.Seconds(f, [coded[k] for k in batch])
        k, t = (x.ravel() for x in np.meshgrid(np.arange(0, len(first)), np.arange(len(batch)), indexing="ij"))
        for part in (k % 2 == 0, k % 2 == 1):
            for i, j, n in zip(k[part], t[part], s.matched(k[part], t[part]), strict=True):
                assert n == _matched(first[i], lines[batch[j]])
                seen.add((i, batch[j]))
    assert len(seen) == len(first) * len(lines)


@pytest.mark.parametrize("seeds", [1 << 20, 50])
def test_the_bound_of_long_lines_holds_and_rules_out(seeds, monkeypatch):
    from folioforge.operators import ratios as R

    monkeypatch.setattr(R, "SEEDS", seeds)
    words = "the quick brown fox jumps over lazy dogs while Żubr 7 rests".split()
    rng = random.Random(13)
    first = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)] + ["", "q", "xyz " * 60, "mnop" * 80]
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 90, 200)] + [first[0] + "!" * 40, "ab" * 200, first[1][:100] + "zz" * 80]
    assert all(len(x) >= R.SHORT for x in lines)
    f = R.Firsts(first)
    rare = R.Rare(f)
    for line in lines:
        most = rare.most(f.coded(R.codes(line)))
        assert all(m >= _matched(a, line) for m, a in zip(most, first, strict=True))
    assert rare.most(f.coded(R.codes("ab" * 200))).tolist() == [0] * len(first)
    assert rare.most(f.coded(R.codes(first[0] + "!" * 40)))[0] == len(first[0])


def test_short_and_long_lines_in_one_join(spark):
    rng = random.Random(14)
    words = "the quick brown fox jumps over lazy dogs while Zubr rests".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((3, 20, 45))))) for k in range(9)]
    lines = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((2, 8, 30, 50, 120))))) for k in range(40)] + [(90, items[4][1]), (80, items[4][1]), (81, "x " + items[8][1])]
    i, n = spark.createDataFrame(items, "i int, s string"), spark.createDataFrame(lines, "n int, t string")
    want = {k: max((ratio(s, t), -j) for j, t in lines) for k, s in items}
    assert {r["i"]: (r["similarity"], -r["n"]) for r in M.best_of_all(i, n, "s", "t", "i", "n", 0.1).collect()} == want
    cuts = {0.0: "Z", 0.2: "B", 0.4: "A", 0.6: "ok"}
    kind = lambda r: cuts[max(c for c in cuts if c <= r)]
    kinds = Counter((kind(ratio(s, t)), kind(ratio(s.lower(), t.lower()))) for _, s in items for _, t in lines)
    assert {(r["before"], r["after"]): r["count"] for r in M.reclassified(i, n, "s", "t", cuts).collect()} == kinds
