import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from folioforge.llm import textkernel as tk
from folioforge.llm import toxicity as tx

from . import brute

SCHEMA = "doc_id long, text string, score string, held_out int"


def _corpus(n=600):
    rng = np.random.default_rng(5)
    calm = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(calm, 40))
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(40))] = ["idiot", "scum"][i % 2]
            w[int(rng.integers(40))] = "scum"
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_features_match_brute_force():
    texts = ["One two, three!", "", "one TWO", "a", "x y z x y z"]
    buf, off = tk.joined(texts)
    ids, doc = tx.features(buf, off)
    for j, t in enumerate(texts):
        w = brute.alnum_words(t)
        want = {("u", x) for x in w} | {("b", *p) for p in zip(w, w[1:])} | {("s", *p) for p in zip(w, w[2:])}  # noqa: B905
        assert len(set(ids[doc == j].tolist())) == len(want)
    assert set(ids[doc == 2].tolist()) <= set(ids[doc == 0].tolist())


def test_learns_and_holds_out(spark):
    docs, labels = _corpus()
    d = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    w = tx.train(d, lab)
    other = tx.train(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert (w.ids == other.ids).all() and np.allclose(w.values, other.values)  # held-out labels are not learnt
    got = {r["doc_id"]: r for r in tx.score(d, w).collect()}
    truth = dict((i, t) for i, _, t in labels)
    wrong = sum(got[i]["predicted"] != t for i, t in truth.items())
    assert wrong <= 6 and all(0 <= r["score"] <= 1 for r in got.values())
    assert len(w.ids) < 2000


def test_odd_rows(spark):
    docs, labels = _corpus(200)
    w = tx.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = [(i, t, "own", 2) for i, t in enumerate(brute.ODD_TEXTS)] + [(None, "idiot scum", "own", 0)] * 2
    out = tx.score(spark.createDataFrame(odd, SCHEMA), w)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(odd) and all(r["predicted"] == int(r["score"] >= tx.THRESHOLD) for r in rows)
    none = tx.train(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert tx.score(spark.createDataFrame(odd, SCHEMA), none).where("predicted = 1").count() == 0
    assert tx.score(spark.createDataFrame([], SCHEMA), w).count() == 0


def test_sample_is_bounded(spark):
    lab = spark.createDataFrame([(i, 0, i % 2) for i in range(500)], "doc_id long, quality int, toxic int")
    assert tx.sample_labels(lab, 40).count() == 40


def _plain_ftrl(rows, labels, alpha, beta, l1, l2, epochs, min_docs):
    """One coordinate at a time, by the published update."""
    count = {}
    for r in rows:
        for x in set(r):
            count[x] = count.get(x, 0) + 1
    z, n = {x: 0.0 for x, c in count.items() if c >= min_docs}, {x: 0.0 for x, c in count.items() if c >= min_docs}
    zb = nb = 0.0

    def weight(x):
        if abs(z[x]) <= l1:
            return 0.0
        return -(z[x] - np.sign(z[x]) * l1) / ((beta + n[x] ** 0.5) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            on = [x for x in sorted(set(rows[j])) if x in z]
            w = {x: weight(x) for x in on}
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-(wb + sum(w.values())))) - labels[j]
            for x in on:
                z[x] += g - ((n[x] + g * g) ** 0.5 - n[x] ** 0.5) / alpha * w[x]
                n[x] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    return {x: weight(x) for x in z if abs(z[x]) > l1}, -zb / ((beta + nb**0.5) / alpha)


def test_fit_equals_a_plain_ftrl():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 2**32, 60) % 97 * 44_000_000).astype(np.uint32) for _ in range(300)]
    labels = np.array([float((r == 44_000_000 * 5).any()) for r in rows])
    want, bias = _plain_ftrl([r.tolist() for r in rows], labels, 2.0, 1.0, 1.0, 0.1, 3, 3)
    got = tx.ftrl(list(rows), labels, l1=1.0, epochs=3, min_docs=3)
    assert set(got.ids.tolist()) == set(want) and 0 < len(want)
    assert np.allclose(got.values, [want[x] for x in got.ids.tolist()]) and np.isclose(got.bias, bias)


def test_columns_that_clash_in_any_case(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b", "own", "x"), (2, None, None, None)], "doc_id long, text string, Score string, predicted_ string")
    out = tx.stage_toxicity(spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted(r["Score"] or "" for r in out.collect()) == ["", "own"]


def test_the_fit_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    """Many rows of few ids, in any order of arrival: the same bounded sample, so the same model; whole texts are learnt from."""
    seen = []
    fit = tx.ftrl
    monkeypatch.setattr(tx, "ftrl", lambda rows, labels, **kw: seen.append((len(rows), sum(len(r) for r in rows))) or fit(rows, labels, **kw))
    rows = [(i % 3, f"w{i % 3} common {i} " + ("scum" if i % 3 else "")) for i in range(900)]
    lab = spark.createDataFrame([(i, 1, int(i > 0)) for i in range(3)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string"
    a = tx.train(spark.createDataFrame(rows, schema), lab, n=50)
    b = tx.train(spark.createDataFrame(rows[::-1] + rows[:100], schema).repartition(7), lab, n=50)
    assert [n for n, _ in seen] == [50, 50] and (a.ids == b.ids).all() and (a.values == b.values).all() and a.bias == b.bias
    tx.train(spark.createDataFrame(rows, schema), lab, most_bytes=200)
    assert 0 < seen[-1][0] <= 200 // 10
    long = [(0, " ".join(f"x{j}" for j in range(20_000)) + " scum"), (1, "fine words"), (2, "more fine words")]
    tx.train(spark.createDataFrame(long, schema), lab)
    assert seen[-1][1] > 59_000
    tx.train(spark.createDataFrame(long, schema), lab, most_bytes=1000)  # a row that doesn't fit is left out as a whole
    assert seen[-1][0] == 2


def test_the_fit_takes_less_memory_than_its_features(spark, monkeypatch):
    """Features and their places lie in mapped files, and ids are counted in ranges."""
    fit, seen = tx.ftrl, {}

    def measured(rows, labels, **kw):
        seen["size"] = 4 * sum(len(r) for r in rows)
        tracemalloc.reset_peak()
        out = fit(rows, labels, **kw)
        seen["peak"] = tracemalloc.get_traced_memory()[1] - seen["before"] + pa.total_allocated_bytes()
        return out

    monkeypatch.setattr(tx, "ftrl", measured)
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 8000), x -> concat('w', if(x % 4 = 0, x, x * 400 + id)))) as text")
    tracemalloc.start()
    try:
        seen["before"] = tracemalloc.get_traced_memory()[0]
        w = tx.train(docs, spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    finally:
        tracemalloc.stop()
    assert seen["size"] > 25_000_000 and seen["peak"] < 25_000_000 and isinstance(w.bias, float)


def test_vocabulary_in_ranges(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 900, 200, dtype=np.uint64) * 4_770_000).astype(np.uint32) for _ in range(60)] + [np.zeros(0, np.uint32)]
    ids, many = np.unique(np.concatenate(rows), return_counts=True)
    for size in (1, 100, 1 << 18):
        monkeypatch.setattr(tx, "COUNT_IDS", size)
        assert (tx.vocabulary(rows, 14) == ids[many >= 14]).all() and len(tx.vocabulary(rows, 61)) == 0
    assert [x.tolist() for x in tx.Mapped(np.int32).arrays()] == [] and 0 < (many >= 14).sum() < len(ids)
