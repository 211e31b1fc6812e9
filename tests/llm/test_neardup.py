import random

import numpy as np
from folioforge.llm import neardup as nd
from folioforge.llm import textkernel as tk
from folioforge.llm.scratch import Scratch

from . import brute

SCHEMA = "doc_id long, text string, component_id string, kept int, a int, band string"


def brute_components(rows):
    """doc_id -> least doc_id reachable over links of 0.75 or more."""
    ids = [r[0] for r in rows]
    sets = {r[0]: brute.shingles(r[1]) for r in rows}
    label = {i: i for i in ids}
    for _ in ids:
        new = dict(label)
        for i in ids:
            for j in ids:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    new[i] = min(new[i], label[j])
        if new == label:
            break
        label = new
    return label


def _docs(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        else:
            w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 90))]
        out.append((i, " ".join(w)))
    return out


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    for share in (0.25, 0.75):
        cut = int(900 * share)
        b = np.concatenate([a[:cut], rng.integers(0, 2**63, 900 - cut).astype(np.uint64)])
        t = nd.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 900, 1800, 1801]))
        assert (t != nd._EMPTY).all()
        j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((t[0] == t[1]).mean() - j) < 0.17


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = _docs(150, seed)
        got = {r["doc_id"]: r for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = brute_components(rows)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["n_shingles"] == len(brute.shingles(t)) for (i, t) in rows for r in [got[i]])
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(brute.ODD_TEXTS + brute.ODD_TEXTS[4:9])]
    odd = [(i, t, "x", 0, 1, "b") for i, t in rows] + [(None, "a b c d e", None, None, None, None)] * 2 + [(5, rows[5][1], "y", 1, 1, "c")]
    got = nd.near_duplicates(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == len(odd)
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_candidates_of_different_components_are_compared(spark):
    """A bucket whose least member links with nobody still yields the link of the two others."""
    w = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(w[:52] + [f"a{i}" for i in range(12)])), (1, " ".join(w)), (2, " ".join(w[:-1] + ["z"]))]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_a_long_chain(spark):
    n = 70
    order = random.Random(4).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in nd.components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}
    assert tk.mix1(1) != tk.mix1(2)


def test_hot_classes_and_centers(spark, sf_dir):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(i, base) for i in range(400)] + [(1000 + i, base + f" tail{i} more{i}") for i in range(300)] + [(5000, "quite another text of six words")]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 5000 else 5000 for i, _ in rows}
    clash = spark.createDataFrame(rows[:2] + rows[-1:], "doc_id long, text string").selectExpr("*", "1 AS doc_id_", "'x' AS Digest")
    out = nd.stage_neardup(spark, clash, sf_dir)
    assert out.columns == clash.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 5000]
