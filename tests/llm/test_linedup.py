import random

from folioforge.llm import linedup as ld
from folioforge.llm import textkernel as tk

from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id long, text string, n_lines string, i int, k string, line int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute_force(docs):
    """(id, kept text, lines, removed): each line against all earlier ones."""
    seen, out = [], []
    for i, t in sorted(docs):
        kept = []
        lines = (t or "").split("\n")
        for x in lines:
            w = brute.words(x)
            bad = bool(w) and any(w == v or (len(w) >= 8 and len(v) >= 8 and distance(w, v) <= 1) for v in seen)
            if w:
                seen.append(w)
            if not bad:
                kept.append(x)
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(lines), len(lines) - len(kept)))
    return sorted(out)


def _docs(seed, n=40):
    rng = random.Random(seed)
    pool, out = [], []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            if pool and rng.random() < 0.6:
                w = list(rng.choice(pool))
                for _ in range(rng.randint(0, 2)):
                    at = rng.randrange(len(w) + 1)
                    w[at : at + rng.randint(0, 1)] = [f"E{rng.randrange(9)}"] * rng.randint(0, 1)
            else:
                w = [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 14))]
            if w:
                pool.append(w)
            lines.append("  ".join(w) if rng.random() < 0.3 else " ".join(w))
        out.append((i, "\n".join(lines)))
    return out


def _got(rows):
    return sorted(((r["doc_id"], r["text"], int(r["n_lines"]), r["n_removed"]) for r in rows), key=str)


def test_line_bounds():
    texts = ["a\nb", "", "\n", "x\n\ny\n", "z"]
    buf, off = tk.joined(texts)
    t = ld.Lines(buf, off)
    assert (t.first[1:] - t.first[:-1]).tolist() == [len(x.split("\n")) for x in texts]
    assert t.size.tolist() == [len(brute.words(x)) for y in texts for x in y.split("\n")]


def test_within_one_edit(spark):
    rng = random.Random(0)
    rows = [([rng.choice("ab") for _ in range(rng.randint(0, 5))], [rng.choice("ab") for _ in range(rng.randint(0, 5))]) for _ in range(2000)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", ld.within_one_edit(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == (distance(r["a"], r["b"]) <= 1) for r in got)


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        docs = _docs(seed)
        assert _got(ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == sorted(brute_force(docs), key=str)


def test_one_word_at_every_place(spark):
    base = [f"w{i}" for i in range(9)]
    docs = [(0, " ".join(base))]
    for p in range(10):
        docs.append((len(docs), " ".join(base[:p] + ["new"] + base[p:])))
    for p in range(9):
        docs += [(len(docs), " ".join(base[:p] + base[p + 1 :])), (len(docs) + 1, " ".join(base[:p] + ["sub"] + base[p + 1 :]))]
    got = _got(ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute_force(docs), key=str)
    assert sum(r[3] for r in got) == len(docs) - 1


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(brute.ODD_TEXTS + brute.ODD_TEXTS[8:14])]
    odd = [(i, t, "x", 1, "k", 0) for i, t in docs] + [(None, "a b c d e f g h\n\nnew", None, None, None, None), (12, "other text", "x", 1, "k", 0), (12, docs[12][1], "x", 1, "k", 0)]
    got = ld.dedup_lines(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == len(odd)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 12)}
    for i, t, n, m in brute_force([d for d in docs if d[0] != 12]):
        if i != 12:
            assert (by[i]["text"], by[i]["n_lines"], by[i]["n_removed"]) == (t, n, m)
    assert ld.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_lines(spark):
    text = "\n".join(f"line {i // 3}" for i in range(400))
    got = ld.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["text"] == "\n".join(f"line {i}" for i in range(134)) and got["n_removed"] == 400 - 134


def test_stage_drops_only_what_stands_elsewhere(spark):
    rows = [(1, "a b\nc d", "en", "s", 7), (2, "c d\na b", "en", "s", 7), (3, "", "en", "s", 0), (4, "c d\nnew", "en", "s", 7), (5, None, None, None, None)]
    out = ld.stage_linedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "a b\nc d", 7), (3, "", 0), (4, "new", 3), (5, None, None)]


def test_edit_bound_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "a b c d\na b c d e f g h i"), (2, "a b x d\na b c d e f g h j"), (3, "a b c d")], "doc_id long, text string")
    left = lambda n: {r["doc_id"]: r["n_removed"] for r in ld.dedup_lines(docs, near_words=n).collect()}
    assert left(None) == {1: 0, 2: 0, 3: 1} and left(8) == {1: 0, 2: 1, 3: 1} and left(4) == {1: 0, 2: 2, 3: 1}
    assert [ld.edits(n) for n in (7, 8)] == [0, 1] and ld.edits(50, None) == 0


def test_columns_that_clash_in_any_case(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b\na b", "x", 1, 2, 3)], "doc_id long, text string, I_ string, k_ int, N_removed int, __gone int")
    assert ld.stage_linedup(spark, docs, sf_dir).first().asDict() == {"doc_id": 1, "text": "a b", "I_": "x", "k_": 1, "N_removed": 2, "__gone": 3}


def test_hot_lines(spark):
    rows = [(i, f"the same line in all of them\nown {i} own") for i in range(700)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: int(i > 0) for i in range(700)}
