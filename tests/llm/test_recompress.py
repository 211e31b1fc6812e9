import hashlib
import random

import numpy as np
import pytest
from folioforge.llm import recompress as rc
from folioforge.llm import textkernel as tk
from folioforge.llm.scratch import Scratch
from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id long, text string, copy string, gone int, i string, k int"


def brute_force(docs, w=13):
    """(id, words, removed, kept) with windows compared as tuples."""
    first = {}
    texts = [(i, brute.words(t, False)) for i, t in docs]
    for i, x in texts:
        for s in range(len(x) - w + 1):
            k = tuple(x[s : s + w])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, x in texts:
        bad = {s + j for s in range(len(x) - w + 1) if first[tuple(x[s : s + w])] < i for j in range(w)}
        out.append((i, len(x), len(bad), " ".join(v for p, v in enumerate(x) if p not in bad)))
    return sorted(out)


def _docs(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(3 if i % 5 == 0 else 4000)}" for _ in range(rng.randint(0, 80))]
        if out and i % 2:
            src = rng.choice(out)[1].split()
            a = rng.randrange(len(src) + 1)
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randint(5, 40)]
        out.append((i, " ".join(w) if i % 7 else "\n\t".join(w)))
    return out + [(n, "z " * 30), (n + 1, "y z " + "z " * 20), (n + 2, out[3][1]), (n + 3, out[8][1])]


def _windows(texts):
    words = tk.Words(*tk.joined(texts), lower=False)
    got = [(d, s, a, h) for w in rc.windows_of(words, rc.word_hashes(words), words.hashes(other=True)) for d, s, a, h in zip(w.doc.tolist(), w.pos.tolist(), w.anchor.tolist(), w.hash.tolist(), strict=True)]
    return sorted(got)


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(0)
    seen = {}
    for k in (2, 3, 50):
        for _ in range(60):
            x, y = rng.integers(0, k, 45), rng.integers(0, k, 45)
            p, q = rng.integers(0, 32, 2)
            y[q : q + 13] = x[p : p + 13]
            texts = [" ".join(map(str, x)), " ".join(map(str, y)), ""]
            for d, s, a, h in _windows(texts):
                assert a and seen.setdefault(tuple(texts[d].split()[s : s + 13]), (a, h)) == (a, h)
    assert len({h for _, h in seen.values()}) == len(seen)


def test_segments_change_no_window(monkeypatch):
    texts = [" ".join(str(x) for x in np.random.default_rng(2).integers(0, 9, 300)), "a b", " ".join(map(str, range(13)))]
    whole = _windows(texts)
    monkeypatch.setattr(rc, "SEGMENT", 40)
    assert _windows(texts) == whole and len(whole) == 288 + 1


def test_a_symbol_stands_for_its_words():
    rng, seen, first = np.random.default_rng(1), {}, None
    passage = rng.integers(1, 50, 400)
    x = [np.concatenate([rng.integers(1, 50, 30), passage, rng.integers(1, 50, 30)]) for _ in range(20)]
    at, row = np.tile(np.arange(460), 20), np.repeat(np.arange(20), 460)
    s = rc.Symbols(tk.mix(np.concatenate(x).astype(np.uint64)), tk.mix(np.concatenate(x).astype(np.uint64) + np.uint64(9)), at, at + 1, row).steps(9, 0)
    for d in range(20):
        on = s.row == d
        a, b, name = s.a[on], s.b[on], s.name[on].tolist()
        assert a[0] == 0 and b[-1] == 460 and (a[1:] == b[:-1]).all()
        for n, c, p, q in zip(name, s.check[on].tolist(), a.tolist(), b.tolist(), strict=True):
            assert seen.setdefault(n, (c, tuple(x[d][p:q]))) == (c, tuple(x[d][p:q]))
        inner = {n for n, p, q in zip(name, a.tolist(), b.tolist(), strict=True) if 100 < p and q < 360}
        first = first or inner
        assert first == inner and max(b - a) >= rc.WINDOW  # what lies within the passage is named alike everywhere
    apart = rc.Symbols(s.name[:4], s.check[:4], np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7]), np.zeros(4, int)).steps(5, 0)
    assert len(apart.name) == 4  # symbols that don't touch aren't joined


def test_spans_within_others():
    got = rc._within(np.array([0, 0, 1, 1, 2]), np.array([3, 9, 3, 0, 1]), np.array([5, 12, 5, 9, 2]), np.array([0, 1, 0]), np.array([8, 2, 1]), np.array([11, 8, 6]))
    assert got.tolist() == [True, False, True, False, False]


def test_a_name_with_two_second_hashes_is_an_error(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "name long, check long, i long")
    with pytest.raises(Exception, match="different words"):
        rc.verified(rows).collect()


def test_long_repeats_are_found_by_their_symbols(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(900))
    docs = [(i, " ".join(f"o{i}x{j}" for j in range(20)) + " " + passage + f" end{i}") for i in range(6)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    scratch = Scratch(spark, "t")
    own = rows.selectExpr("doc_id AS i", "xxhash64(text) AS k", "text")
    occ = scratch.put(rc.occurrences(own), "o")
    wanted = occ.join(rc.dictionary(occ, "anchor"), "anchor").groupBy("i", "k").agg(F.collect_set("anchor").alias("wanted"))
    parts = scratch.put(rc.live(own.join(wanted, ["i", "k"]), rc.LEVELS[0]), "live")
    long = rc.long_symbols(parts, scratch).collect()
    assert all(sum(r["b"] - r["a"] for r in long if r["i"] == i) > 450 for i in range(1, 6)) and not any(r["i"] == 0 for r in long)
    assert sorted(tuple(r) for r in rc.cut_repeats(rows).collect()) == brute_force(docs)


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = _docs(seed)
        got = sorted(tuple(r) for r in rc.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
        assert got == brute_force(docs)


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(brute.ODD_TEXTS + brute.ODD_TEXTS[8:12])]
    odd = [(i, t, "c", 1, "x", 2) for i, t in docs] + [(None, "q " * 20, None, None, None, None), (8, docs[8][1], "c", 0, "x", 1)]
    got = sorted((tuple(r) for r in rc.cut_repeats(spark.createDataFrame(odd, SCHEMA)).collect()), key=str)
    want = brute_force(docs + [(10**6, "q " * 20), (8, docs[8][1])])
    assert got == sorted(((None if i == 10**6 else i, *x) for i, *x in want), key=str)
    assert rc.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    sha = rc.cut_repeats(spark.createDataFrame(odd[:1], SCHEMA), False).first()
    assert sha["kept"] == hashlib.sha256(b"").hexdigest()


def test_rows_of_one_id_and_without_one(spark):
    docs = [(1, " ".join(f"a{j}" for j in range(40)) + f" x{n}") for n in range(30)] + [(2, " ".join(f"a{j}" for j in range(40)))]
    docs += [(None, " ".join(f"b{j}" for j in range(40)) + f" y{n}") for n in range(30)]
    got = sorted((tuple(r) for r in rc.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    want = brute_force([(10**6 if i is None else i, t) for i, t in docs])
    assert got == sorted(((None if i == 10**6 else i, *x) for i, *x in want), key=str)


def test_repeated_rows_are_worked_on_once(spark):
    """Rows of one id and text: the lists of a document don't grow with their number."""
    words = " ".join(f"w{k}" for k in range(600))
    rows = [(1, words)] + [(None, f"{words} tail {j % 2}") for j in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(rc.F.coalesce("doc_id", rc.F.lit(rc._LAST)).alias("i"), rc.F.xxhash64("text").alias("k"), "text")
    assert rc.one_a_key(keyed, rc.Scratch(spark, "t")).count() == 3
    got = rc.cut_repeats(docs).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["count"]) for r in got) == [(0, 602, 600, 750), (0, 602, 600, 750), (1, 600, 0, 1)]
