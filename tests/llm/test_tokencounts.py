import base64

import pytest
from folioforge.llm import tokencounts as tc
from folioforge.llm.scratch import Scratch

from . import brute

tiktoken = pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string, source string, lang string, tokens string"
CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def _counter(name):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tc.TOKENIZERS[name], "rb"))}
    return tiktoken.Encoding("own", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_and_odd_rows(spark):
    rows = [(i, t, "s", None, "x") for i, t in enumerate(brute.ODD_TEXTS)] + [(None, "a", None, None, None)] * 2
    got = tc.count_tokens(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 2 * len(rows)
    for name in tc.TOKENIZERS:
        e = _counter(name)
        want = sorted(len(e.encode_ordinary(t or "")) for _, t, *_ in rows)
        assert sorted(r["tokens"] for r in got if r["tokenizer"] == name) == want
    assert tc.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_batches_are_idempotent_and_signed(spark):
    r = tc.Rollup(spark, Scratch(spark, "t").path("r"))
    assert r.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", 7, None), ("insert", "b", "en", "v1", None, None)], CHANGES)
    assert r.commit("day 1/a", one) and not r.commit("day 1/a", one)
    two = spark.createDataFrame([("revise", "a", "en", "v1", 12, 10), ("delete", "a", "en", "v1", None, 5), ("delete", None, None, "v1", None, 7), ("insert", "a", "en", "v2", 3, None)], CHANGES)
    assert r.commit("day 2", two) and not r.commit("day 2", one)
    got = {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}
    assert got == {("a", "en", "v1"): (1, 12), ("a", "en", "v2"): (1, 3), ("b", "en", "v1"): (1, 0)}
    assert r.commit("empty", spark.createDataFrame([], CHANGES)) and len(r.committed()) == 3
    with pytest.raises(Exception, match="unknown op"):
        r.commit("bad", spark.createDataFrame([("upsert", "a", "en", "v1", 1, 1)], CHANGES))
    assert len(r.committed()) == 3
    assert {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()} == got
    for more in (False, True):  # merging changes no total and no batch can come twice, before and after old folders go
        assert r.compact() and len(r.committed()) == 3 and not r.commit("day 2", two)
        assert {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()} == got
        assert r._folders("batch-") == ([] if more else r.committed())
    assert r.commit("day 3", spark.createDataFrame([("delete", "b", "en", "v1", None, 0), ("delete", "a", "en", "v2", None, 3)], CHANGES))
    assert {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()} == {("a", "en", "v1"): (1, 12)} and r.compact() and len(r.committed()) == 4


def test_query_equals_a_direct_count(spark, sf_dir):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in tc.op6_tokencounts(spark, sf_dir).collect()}
    want = {}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for name in tc.TOKENIZERS:
        e = _counter(name)
        for r in rows:
            k = (r["source"], r["lang"], name)
            d, t = want.get(k, (0, 0))
            want[k] = d + 1, t + len(e.encode_ordinary(r["text"] or ""))
    assert got == want
