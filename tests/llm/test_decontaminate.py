import hashlib
import random

from folioforge.llm import decontaminate as dc

from . import brute

DOCS = "doc_id long, text string, n_hit long, span string, item_id int"
ITEMS = "item_id long, text string, doc_id long, k string"


def brute_force(docs, items, window=10):
    spans = {}
    for item, text in items:
        w = brute.alnum_words(text)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            spans.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = brute.alnum_words(text), set(), set()
        for m in {len(s) for s in spans}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in spans:
                    hit |= set(range(p, p + m))
                    found |= spans[tuple(w[p : p + m])]
        ids = ",".join(sorted(str(i) for i in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 9, "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 7, "y") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in dc.contamination(d, b).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    item = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 7, 9, 10, 11, 14, 30]))] for _ in range(14)]
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(40)}" if rng.random() < 0.3 else f"v{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
        if i % 2:
            part = rng.choice(item)
            a = rng.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = part[a : a + rng.randint(8, 16)]
        docs.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    items = [(j, " - ".join(w)) for j, w in enumerate(item)]
    assert _run(spark, docs, items) == brute_force(docs, items)


def test_every_span_of_ten_words_is_found(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(s, " ".join(["a", "b", *item[s : s + 10], "c"])) for s in range(31)] + [(99, " ".join(item[:9]))]
    got = _run(spark, docs, [(1, " ".join(item))])
    assert [r[2] for r in sorted(got)] == [10] * 31 + [0]


def test_odd_rows(spark):
    docs = list(enumerate(brute.ODD_TEXTS)) + [(None, "a b c d"), (None, "zz"), (3, "a b c d e f")]
    items = [(i, t) for i, t in enumerate(brute.ODD_TEXTS)] + [(None, "zz"), (4, "one")]
    want = brute_force(docs, [x for x in items if x[0] is not None])
    got = _run(spark, docs, [x for x in items if x[0] is not None])
    assert got == want
    assert len(_run(spark, docs, [])) == len(docs) and not any(r[5] for r in _run(spark, docs, []))
    assert _run(spark, [], items) == []
    assert [r[5] for r in _run(spark, [(1, "zz")], [(None, "zz")])] == [True]  # hit, though the item has no id to list


def test_native_plan(spark, sf_dir, capsys):
    dc.op7_decontaminate(spark, sf_dir).explain()
    out = capsys.readouterr().out
    assert "Python" not in out and "Arrow" not in out and "Pandas" not in out


def test_stage_takes_clashing_columns_and_judges_rows_of_one_id_by_text(spark, tmp_path):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "a b c"), (3, "d e")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "one two three four five six seven eight nine ten", "x", 1), (1, "clean text", "y", 2), (2, "z a b c", None, None), (3, None, None, None), (None, "q d e", None, None)]
    out = dc.stage_decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, bad_id string, I_ int"), str(tmp_path))
    assert out.columns == ["doc_id", "text", "bad_id", "I_"]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "clean text"), (3, None)]
