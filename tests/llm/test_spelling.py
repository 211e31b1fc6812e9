import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.llm import spelling as sp
from folioforge.llm import textkernel as tk
from folioforge.llm.scratch import Scratch

from . import brute

SCHEMA = "doc_id long, text string"


def plain_words(docs, slip=97):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, min_chars=5, min_count=3, slip=97):
    n = {w: c for w, c in plain_words(docs, slip).items() if len(w) >= min_chars and c >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def _rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def _docs(seed, n, letters="abÉé", most=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    return [(i, " ".join(word() + rng.choice(["", ",", "-", "1", "œ", "ÿ", "Ā"]) for _ in range(60))) for i in range(n)]


def test_runs_and_slips():
    docs = _docs(1, 40) + list(enumerate(brute.ODD_TEXTS, 100)) + [(None, "naïve ÀÿÐ×÷ œuvre Ĉà Ã© " * 3), (7, "a" * 200 + " " + "b" * 64 + " " + "c" * 65), (-3, "ß" * 40)]
    for slip in (97, 5, 1, 0):
        buf, off = tk.joined([t or "" for _, t in docs])
        want = Counter({w: c for w, c in plain_words(docs, slip).items() if w})
        assert sp.block_words(buf, off, [i for i, _ in docs], 1, slip) == want
        assert sp.block_words(buf, off, [i for i, _ in docs], 5, slip) == Counter({w: c for w, c in want.items() if len(w) >= 5})


@pytest.mark.parametrize("q,letters,most", [(4, "ab", 11), (3, "abc", 8), (2, "aé", 9), (4, "aaab", 14)])
def test_near_words_against_all_pairs(spark, q, letters, most):
    rng = random.Random(q * most)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(3, most))): rng.randint(3, 9) for _ in range(700)} | {"x" * 300: 3, "x" * 301: 4, "x" * 150 + "y" + "x" * 149: 5}
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in sp.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), q).collect()}
    want = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), words[best], best)
    assert got == want


def test_small_blocks_give_the_same(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(300)})
    x = sp.Index(words, np.zeros(sp.CLASSES, np.int64))
    row, j = np.nonzero(x.pos[:, :5] >= 0)
    code, pos, size = x.code[row, j], x.pos[row, j], x.size[row]
    keys = np.concatenate([sp.posting_key(code, pos, size), sp.posting_key(code, pos, size + 1), sp.posting_key(code, pos + 1, size + 1)])
    shift, word, j = np.repeat(np.array([-1, 0, 1], np.int8), len(row)), np.tile(row, 3), np.tile(j, 3)
    order = np.argsort(keys, kind="stable")
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(sp, "BLOCK_PAIRS", most)
        s, t = sp.Merge(keys[order], shift[order], j[order], word[order], x).near()
        got = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(s, t, strict=True))
        assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


@pytest.mark.parametrize("slip", [97, 7, 0])
def test_against_the_definition(spark, slip):
    docs = _docs(2, 60) + [(None, None), (1000, ""), (None, "ababab " * 9)] + list(enumerate(brute.ODD_TEXTS, 2000))
    assert _rows(sp.spelling_variants(spark.createDataFrame(docs, SCHEMA), slip=slip)) == plain(docs, slip=slip)
    assert _rows(sp.spelling_variants(spark.createDataFrame(docs, SCHEMA), 3, 1, slip=slip)) == plain(docs, 3, 1, slip)


def test_chain_of_forms(spark):
    """Each word is twice as frequent as the one before and one edit on: ten steps to the root."""
    chain = ["abcde" + "x" * k for k in range(10)]
    docs = [(i, " ".join([w] * 3 * 2**k)) for i, (k, w) in enumerate(enumerate(chain))]
    got = sp.spelling_variants(spark.createDataFrame(docs, SCHEMA), slip=0).collect()
    assert {r["root"] for r in got} == {chain[-1]} and len(got) == 10


def test_roots_of_long_ways(spark):
    rng = random.Random(3)
    links = {f"w{i}": f"w{rng.randint(i + 1, i + 3)}" for i in range(60)}

    def end(w):
        return end(links[w]) if w in links else w

    got = dict(map(tuple, sp.roots(spark.createDataFrame(list(links.items()), "word string, to string"), Scratch(spark, "t")).collect()))
    assert got == {w: end(w) for w in links}


def test_empty_clashing_and_bad_parameters(spark):
    df = spark.createDataFrame([(1, "hello hello hello hellos", "x", 1)], SCHEMA + ", Word string, N int")
    assert _rows(sp.spelling_variants(df, slip=0)) == [("hello", "", "hello", 3, 0, 0)]
    assert sp.spelling_variants(df.limit(0)).count() == 0
    assert sp.spelling_variants(df.withColumn("text", F.lit(None).cast("string"))).count() == 0
    for bad in ({"min_chars": 2}, {"ratio": 1}, {"q": 5}):
        with pytest.raises(ValueError):
            sp.spelling_variants(df, **bad)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted((w, f or "", r, n, m, k or 0) for w, f, r, n, m, k in con.execute(sp.ORACLE_SQL).fetchall())
    assert _rows(sp.op12_spelling(spark, sf_dir)) == want
