"""Queries take every row and the whole of each text: small tables against brute force."""

import difflib
from collections import Counter
from hashlib import md5

import pytest
from folioforge import catalog

REG = catalog.load_all()


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over the given tables: name -> (rows, schema)."""

    def go(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return REG[query][0](spark, str(tmp_path)).collect()

    return go


ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "A Stone Bridge crosses the river near Dunmore"), (3, "zzzz"), (4, None)]
LINES = ["he saw that the quick brown fox jumps over the lazy dog today", "one quick brown fox jumped over a lazy dog", "a stone bridge\n\nfar off, A Stone Bridge crosses the river", None, "", "Fox " * 90, "one quick brown fox jumped over a lazy dog"]
FUZZY = {"benchmark": (ITEMS, "item_id long, text string"), "documents": (list(enumerate(LINES)), "doc_id long, text string")}


def pairs():
    return [(i, a, d, line) for i, a in ITEMS if a is not None for d, t in enumerate(LINES) if t is not None for line in t.split("\n")]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_seq_ratio_match(run):
    want = {}
    for i, a, d, line in pairs():
        if (r := ratio(a, line)) > 0.3:
            want[i] = max(want.get(i, (0, 0)), (r, -d))
    assert sorted(want) == [1, 2]
    assert {x["item_id"]: (x["similarity"], -x["doc_id"]) for x in run("seq_ratio_match", **FUZZY)} == want


def test_what_if_reclassify(run):
    kind = lambda r: "ok" if r >= 0.6 else "A" if r >= 0.4 else "B" if r >= 0.2 else "Z"
    want = Counter((kind(ratio(a, b)), kind(ratio(a.lower(), b.lower()))) for _, a, _, b in pairs())
    assert {(x["before"], x["after"]): x["count"] for x in run("what_if_reclassify", **FUZZY)} == want


def test_exam_texts_are_whole_turns(run):
    turn = "which of these " * 12 + "\n2. and a second question of the same turn\n① x ② y"
    r = run("segment_documents", conversations=([(1, 0, "user", turn)], "conv_id long, turn int, role string, text string"))
    assert [(x["n_questions"], x["n_passages"]) for x in r] == [(2, 0)]


def test_question_stems_are_compared_whole(spark):
    from folioforge.operators import similarity as M

    head, other, tail, end = "alpha beta gamma " * 30, "0123456789-+=*/#" * 32, "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "?!" * 450
    stem, read = head + tail, {11: head + end, 12: other + tail}
    best = max(read, key=lambda n: ratio(stem, read[n]))
    assert best == 12 and ratio(stem, read[12]) > 0.55 and max(read, key=lambda n: ratio(stem[:500], read[n][:500])) == 11
    stored = spark.createDataFrame([("d", 1, stem)], "doc_id string, number int, stem string")
    r = M.match_questions(stored, spark.createDataFrame([("d", n, t) for n, t in read.items()], "doc_id string, number int, stem string")).collect()
    assert [(x["read_number"], x["how"]) for x in r] == [(12, "stem")]


DOCS = "doc_id long, text string, n_chars long, source string, lang string"


def docs(*texts, sized=True):
    return {"documents": ([(k, t, len(t) if sized and t is not None else None, "s", "en") for k, t in enumerate(texts)], DOCS)}


@pytest.mark.parametrize("sized", [True, False])
def test_lead_slice(run, sized):
    texts = ["a\nb\n\nc", "x" * 2990 + "\n" + "é" * 40 + "\n" + "z" * 3000 + "\n", "no break", "", None, "\n"]
    want = set()
    for k, t in enumerate(texts):
        at = [i for i, c in enumerate(t or "") if c == "\n"]
        want |= {(k, i, md5(t[i:j].encode()).hexdigest()) for i, j in zip(at, [*at[1:], len(t or "")], strict=False)}
    got = run("lead_slice", **docs(*texts, sized=sized))
    assert len(got) == len(want) == 7 and {(x["doc_id"], x["pos"], x["digest"]) for x in got} == want


@pytest.mark.parametrize("sized", [True, False])
def test_quoted_text(run, sized):
    texts = ["note: tail", "x" * 2500 + " 'in quotes' y", "y" * 2500 + ": behind the colon ", "z" * 2500, None]
    got = {x["doc_id"]: x["quoted"] for x in run("quoted_text", **docs(*texts, sized=sized))}
    assert got == dict(enumerate(["tail", "in quotes", "behind the colon", "", ""]))


def test_char_range_scan(run):
    texts = ["plain", "x" * 2500 + "é한😀\n", "ü" + "y" * 3000 + "\x80", None]
    assert [(x["source"], x["n"]) for x in run("char_range_scan", **docs(*texts))] == [("s", sum(ord(c) > 127 for t in texts for c in t or ""))]


def test_grouped_lists(run):
    rows = [(k, "t", n, "s", "en") for k, n in [(30001, 1), (7, 9000), (20000, None), (7, 5), (123456, 5000)]] + [(8, None, None, None, "en"), (None, "t", 6000, "s", "en")]
    got = {(x["source"], x["lang"]): (x["n"], x["docs"]) for x in run("grouped_lists", documents=(rows, DOCS))}
    assert got == {("s", "en"): (6, "000000007,000000007,000020000,000030001,000123456"), (None, "en"): (1, "000000008")}


def test_usage_last_30d(run):
    from datetime import datetime, timedelta

    end = datetime(2024, 3, 31, 12)
    ages = [timedelta(0), timedelta(7, 1), timedelta(30), timedelta(30, 1), timedelta(60)]
    rows = [(k, "view", end - a) for k, a in enumerate(ages)]
    assert [(x["event_type"], x["calls"]) for x in run("usage_last_30d", events=(rows, "event_id long, event_type string, ts timestamp"))] == [("view", 3)]
