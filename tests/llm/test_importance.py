import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from folioforge.llm import importance as im
from folioforge.llm import textkernel as tk

from . import brute

SCHEMA = "doc_id long, text string"


def features(text, n, buckets):
    w = brute.alnum_words(text)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    """{doc_id: (n_features, weight, score, rank)} of distinct ids, from the definition."""
    own = {i: features(t, n, buckets) for i, t in docs}
    s, t = Counter(b for _, f in own.values() for b in f), Counter(b for x in target for b in features(x, n, buckets)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets)))) for b in s}
    out = {}
    for i, (_, f) in own.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in own if own[i][0] >= min_words), key=lambda i: (-out[i][2], math.inf if i is None else i))
    for rank, i in enumerate(able[: len(able) * percent // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def _texts(seed, n):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)] + ["Éa", "ß", "好", "X1"]
    return [" ".join(rng.choices(pool, k=rng.randint(0, 60))) + rng.choice(["", "!", "\n"]) for _ in range(n)]


def _got(df):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_buckets_of_a_block(n):
    texts = _texts(n, 30) + ["", "a a a a a a", "a b a b a b a b", "ab", "z" * 3000]
    found, cut, many = im.ngram_buckets(*tk.joined(texts), n, 977)
    for j, t in enumerate(texts):
        words, want = features(t, n, 977)
        assert many[j] == words and sorted(found[cut[j] : cut[j + 1]]) == sorted(want)
        if n == 1:
            assert found[cut[j] : cut[j + 1]].tolist() == want


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 30, 20)
    ids = rng.integers(0, 3, size.sum())
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(ids))
    for depth in (1, 2, 3, 4, 7):
        order = im.suffix_array(ids, left, depth)
        key = [tuple(ids[i : i + min(depth, left[i])]) for i in order]
        assert key == sorted(key) and sorted(order) == list(range(len(ids)))
        lcp = im.common_prefixes(ids, left, order, depth)
        for a, b, n in zip(key, key[1:], lcp[1:], strict=False):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("n,buckets,percent,min_words", [(1, 10_000, 10, 20), (2, 300, 37, 5), (3, 70_000, 100, 0), (1, 50, 0, 20)])
def test_against_the_definition(spark, n, buckets, percent, min_words):
    docs = list(enumerate(_texts(1, 90) + brute.ODD_TEXTS + [t.upper() for t in brute.ODD_TEXTS if t])) + [(None, "one two " * 20)]
    target = _texts(2, 20) + [None, ""]
    got = im.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, percent, min_words)
    assert _got(got) == plain(docs, target, n, buckets, percent, min_words)


def test_repeated_rows_hot_scores_and_clashing_names(spark):
    docs = [(7, "a b c d e f " * 5, "x", 1, 2, 3.0)] * 60 + [(8, "other words here " * 9, "y", 4, 5, 6.0)] * 40 + [(None, None, None, None, None, None)] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string, Rank string, words_ int, Packed_ int, before_ double")
    target = spark.createDataFrame([("a b",)], "text string")
    got = im.resample(df, target, percent=50)
    assert got.columns == ["doc_id", "text", "words_", "Packed_", "before_", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert len(rows) == 105 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 51))
    assert all((r["words_"], r["before_"]) == ((1, 3.0) if r["doc_id"] == 7 else (4, 6.0)) for r in rows if r["doc_id"])
    assert im.resample(df.limit(0), target).count() == 0
    assert im.resample(df, target.limit(0)).where("rank is not null").count() == 10


@pytest.mark.parametrize("block", [64, 1 << 10, 1 << 20])
def test_blocks_of_the_hashing_kernel(block, monkeypatch):
    texts = ["lorem Ipsum é " * 300 + "x" * 5000, "", "lorem " + "好" * 700] + _texts(3, 40)
    want = im.ngram_buckets(*tk.joined(texts), 2, 5000)
    monkeypatch.setattr(tk, "BLOCK", block)
    monkeypatch.setattr(tk, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    for a, b in zip(im.ngram_buckets(*tk.joined(texts), 2, 5000), want, strict=True):
        assert a.tolist() == b.tolist()


def test_very_long_text(spark):
    docs = [(1, "lorem Ipsum é " * 3000 + "x" * 5000), (2, "lorem")]
    got = im.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("lorem",)], "text string"))
    assert _got(got) == plain(docs, ["lorem"])


def test_query_equals_sql_and_the_definition(spark, sf_dir):
    got = _got(im.op11_importance(spark, sf_dir))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == {r[0]: r[1:] for r in con.execute(im.ORACLE_SQL).fetchall()}
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert got == plain(docs, [r[0] for r in con.execute("SELECT text FROM benchmark").fetchall()])
