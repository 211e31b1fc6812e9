import itertools
import random

import numpy as np
from folioforge.llm import language as lg
from folioforge.llm import textkernel as tk

from . import brute

SCHEMA = "doc_id long, text string, lang string, score string, spans int"
SOUNDS = {"aa": ["ka", "ko", "mi", "ta"], "bb": ["sch", "ung", "ein", "ach"], "cc": ["eau", "ell", "que", "oi"]}


def _text(lang, rng, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _docs(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, _text(x := "aa bb cc".split()[i % 3], rng, rng.randint(3, 60)), x, "s", 1) for i in range(n)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    n, k = 7, 3
    for fresh in ([1, 0, 0, 0, 0, 0, 0], [1, 0, 1, 0, 0, 1, 0]):
        s, a, b = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        want, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            v = sum(s[t, y] for t, y in enumerate(path)) + sum(b[path[t]] if fresh[t] else a[path[t - 1], path[t]] for t in range(n))
            total += np.exp(v)
            for t, y in enumerate(path):
                want[t, y] += np.exp(v)
                if not fresh[t]:
                    pairs[path[t - 1], y] += np.exp(v)
        want /= want.sum(axis=1, keepdims=True)
        for lane in (1, 2, 3, 64):
            assert np.allclose(lg.forward_backward(s, np.array(fresh, bool), a, b, lane), want)
            prob, both = lg.forward_backward(s, np.array(fresh, bool), a, b, lane, pairs=True)
            assert np.allclose(prob, want) and np.allclose(both, pairs / total)


def test_features_of_a_word_do_not_depend_on_its_place():
    buf, off = tk.joined(["kato eau", "eau"])
    w = tk.Words(buf, off, lg._LETTERS)
    rows, cuts = lg.word_features(w.buf, w.starts, w.ends, w.hashes())
    assert sorted(rows[cuts[1] : cuts[2]]) == sorted(rows[cuts[2] : cuts[3]])
    assert cuts[2] - cuts[1] == 1 + 5 + 4 + 3 + 2 + 2 * 2  # the word, n-grams of ^eau$, affixes


def test_held_out_accuracy_and_isolation(spark):
    rows = _docs()
    crf = lg.train(spark.createDataFrame(rows, SCHEMA))
    got = lg.label(spark.createDataFrame(rows, SCHEMA), crf).withColumn("held", lg.held_out()).where("held").collect()
    assert len(got) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    import zlib

    lied = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else x, s, z) for i, t, x, s, z in rows]
    other = lg.train(spark.createDataFrame(lied + [(9999, "zz", None, None, None)], SCHEMA))
    assert other.labels == crf.labels and np.array_equal(other.weights, crf.weights)


def test_code_switching_is_found_in_spans(spark):
    rng = random.Random(3)
    crf = lg.train(spark.createDataFrame(_docs(), SCHEMA))
    mixed = _text("aa", rng, 30) + ". " + _text("bb", rng, 30)
    row = lg.label(spark.createDataFrame([(1, mixed, None, None, None)], SCHEMA), crf, spans=True).first()
    y = [s["lang"] for s in row["spans"] for _ in range(s["end"] - s["first"])]
    assert len(y) == 60 and sum(a == b for a, b in zip(y, ["aa"] * 30 + ["bb"] * 30, strict=True)) >= 57


def test_odd_rows(spark):
    crf = lg.train(spark.createDataFrame(_docs(60), SCHEMA))
    odd = [(i, t, None, "x", 2) for i, t in enumerate([*brute.ODD_TEXTS, "123 !?", "—", "😀😀", "é"])] + [(None, "ka", "aa", None, None)] * 2
    got = lg.label(spark.createDataFrame(odd, SCHEMA), crf, spans=True).collect()
    assert len(got) == len(odd)
    for r in got:
        has = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == lg.UNKNOWN) == (not has) and 0 <= r["score"] <= 1
    none = lg.train(spark.createDataFrame([], SCHEMA))
    assert {r["lang_pred"] for r in lg.label(spark.createDataFrame(odd, SCHEMA), none).collect()} == {lg.UNKNOWN}
    assert lg.label(spark.createDataFrame([], SCHEMA), crf).count() == 0


def test_chains_side_by_side_give_what_lanes_give():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (40, 3), (300, 5)):
        s, a, b = rng.normal(size=(n, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
        for p in (0.0, 0.1, 1.0):
            fresh = rng.random(n) < p
            fresh[0] = True
            for got, want in zip(lg.chain_marginals(s, fresh, a, b), lg.forward_backward(s, fresh, a, b, pairs=True), strict=True):
                assert np.allclose(got, want)


def test_batches_of_chains_give_the_same_model(monkeypatch):
    texts, labels = [r[1] for r in _docs(60)], [r[2] for r in _docs(60)]
    whole = lg.fit(texts, labels, steps=6)
    monkeypatch.setattr(lg, "BATCH", 200)
    parts = lg.fit(texts, labels, steps=6)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.trans, parts.trans) and np.allclose(whole.start, parts.start)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    """Rows by turns of the languages, whole texts, none twice; every language is learnt."""
    seen = []
    monkeypatch.setattr(lg, "fit", lambda texts, labels, **kw: seen.append(sorted(zip(labels, texts, strict=True))))
    long = " ".join(f"word{i}x" for i in range(3000)) + " " + "y" * 300
    rows = [(i, f"ka ko {i}", f"l{i % 7}", "s", 1) for i in range(700)] * 2 + [(9000, long, "long", "s", 1), (9001, None, "none", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    lg.train(df, per_language=5)
    count = lambda: {x: sum(v == x for v, _ in seen[-1]) for x, _ in seen[-1]}
    assert count() == {f"l{k}": 5 for k in range(7)} | {"long": 1} and dict(seen[-1])["long"] == long and len(set(seen[-1])) == 36
    lg.train(df, most_rows=16)
    assert count() == {f"l{k}": 2 for k in range(7)} | {"long": 1}
    lg.train(df.repartition(3), per_language=5, most_bytes=100)
    assert set(count()) == {f"l{k}" for k in range(7)} and sum(len(t) for _, t in seen[-1]) <= 100


def test_many_languages():
    """150 languages of their own syllables, and one text of each to be named."""
    rng = random.Random(2)
    own = ["".join(p) for p in itertools.product("bdfgklmnprstvz", "aeiou", "bdfgklmnprstvz")]
    rng.shuffle(own)
    text = lambda k, n: " ".join("".join(rng.choices(own[6 * k : 6 * k + 6], k=2)) for _ in range(n))
    crf = lg.fit([text(k, 20) for k in range(150) for _ in range(3)], [f"l{k:03d}" for k in range(150) for _ in range(3)], steps=8)
    right = 0
    for k in range(150):
        prob, _ = crf.word_probabilities(*tk.joined([text(k, 12)]))
        right += crf.labels[int(prob.mean(axis=0).argmax())] == f"l{k:03d}"
    assert len(crf.labels) == 150 and right >= 145


def test_clashing_columns_are_replaced(spark):
    crf = lg.train(spark.createDataFrame(_docs(60), SCHEMA))
    odd = spark.createDataFrame([(1, "ka ko", "x")], "doc_id long, text string, Score string")
    assert lg.label(odd, crf).columns == ["doc_id", "text", "lang_pred", "score"]
