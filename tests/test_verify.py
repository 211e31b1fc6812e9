"""Verification against a second reading: goldens by hand, and text corrections against a plain version."""

import difflib
import random
import re

import pytest
from folioforge.operators import standoff as O
from folioforge.operators import verify as V
from pyspark.sql import functions as F

P = "doc_id string, passage_id string, question_range string, content string"
R = "doc_id string, page_no int, seq int, question_range string, text string, box string, underlines array<string>, ranges array<struct<label:string,text:string>>"
Q = "doc_id string, number int, stem string, bogi string, choices map<string,string>, has_choices boolean"
QR = "doc_id string, number int, stem string, box string, choices map<string,string>"
BODY = "옛날 옛적에 한 사람이 산에 살았다. 그는 나무를 베어 팔았으며 날마다 책을 읽었다. 어느 날 호랑이가 찾아와 말하였다. 떡 하나 주면 안 잡아먹지 하고 물었다."


def passages(spark, stored, read, clips=None):
    clips = spark.createDataFrame(clips, "doc_id string, label string, text string") if clips else None
    rows = V.verify_passages(spark.createDataFrame(stored, P), spark.createDataFrame(read, R), clips).collect()
    return {(r["doc_id"], r["passage_id"]): (r["content"], [(c["kind"], c["field"]) for c in r["corrections"]], [c["message"] for c in r["corrections"]]) for r in rows}


def read(doc, page, rng, text, box=None, underlines=(), ranges=(), seq=1):
    return (doc, page, seq, rng, text, box, list(underlines), list(ranges))


TEXTS = ["plain", "[A:START]\n가나다[A:END]\n <u>라마</u> 바 <img src='x'>\n사 <보기>\n아", "<u><u>x</u>", "", "[그림]\n[그림]끝", "[F:START] is no mark", "a\n[B:END]\n\n"]


def test_marks_beside_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("a", O.taken_apart(F.col("t")))
    rows = df.select("t", "a.clean", "a.marks", O.put_together(F.col("a.clean"), F.col("a.marks")).alias("again")).collect()
    for r in rows:
        assert r["again"] == r["t"] and r["clean"] == re.sub(O.MARK, "", r["t"])
    assert [(m["at"], m["mark"]) for m in rows[1]["marks"]] == [(0, "[A:START]\n"), (3, "[A:END]\n"), (4, "<u>"), (6, "</u>"), (9, "<img src='x'>\n"), (11, "<보기>")]


def test_patches_carry_places(spark):
    """Blocks, gaps, the patched text and every place in it, against difflib's opcodes."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
    pairs = [(word(), word()) for _ in range(60)] + [("", ""), ("abc", "abc"), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("h", F.col("a"))
    df = O.likeness(df, "a", "h", "b").withColumn("g", F.filter(O.gaps(F.col("like.blocks"), F.col("a"), F.col("b")), lambda g: g["a0"] < g["a1"]))
    out = df.select("a", "b", O.patched(F.col("a"), F.col("b"), F.col("g")).alias("p"), F.transform(F.sequence(F.lit(0), F.length("a")), lambda i: O.moved(i, F.col("g"))).alias("at"), "like.plain").collect()
    for r in out:
        m = difflib.SequenceMatcher(None, r["a"], r["b"])
        assert r["plain"] == m.ratio()
        text, at = "", []
        for op, i, j, k, n in m.get_opcodes():
            new = r["a"][i:j] if op in ("equal", "insert") else r["b"][k:n]
            at += [len(text) + min(x, len(new)) for x in range(j - i)]
            text += new
        assert r["p"] == text and r["at"] == [*at, len(text)]


def test_text_marks_and_box_compose(spark):
    """The text is corrected, its header goes, and a range, two underlines and a box are put into the corrected text."""
    stored = [("d", "1", "1~3", "[1~3] 다음 글을 읽고 물음에 답하시오.\n" + BODY.replace("호랑이가", "호렁이가"))]
    seen = [read("d", 1, "1 ～ 3", BODY[:40], underlines=["날마다 책을 읽었다", "없는 밑줄 글자입니다"], ranges=[("A", BODY[10:60])]), read("d", 2, "1~3", BODY[40:], "상자 글", ["떡 하나\n주면"])]
    content, kinds, _ = passages(spark, stored, seen)[("d", "1")]
    want = f"{BODY[:10]}[A:START]\n{BODY[10:60]}\n[A:END]{BODY[60:]}".replace("날마다 책을 읽었다", "<u>날마다 책을 읽었다</u>").replace("떡 하나 주면", "<u>떡 하나 주면</u>")
    assert content.replace("\n", "") == (want + "\n<보기>\n상자 글").replace("\n", "")
    assert kinds == [("FIXED", "content"), ("FIXED", "brackets.A"), ("FIXED", "underlines"), ("WARNING", "underlines"), ("FIXED", "underlines"), ("FIXED", "bogi")]


def test_range_rules(spark):
    inner = BODY[10:60]
    marked = f"[A:START]\n{BODY[:8]}\n[A:END]{BODY[8:]}"
    stored = [("d", str(k), f"{k}~{k}", t) for k, t in enumerate([marked, marked, BODY, BODY, BODY, BODY + "<img src='x'>", f"[A:START]\n{inner}\n[A:END]" + BODY[60:], BODY])]
    ranges = [[("A", inner)], [("A", "전혀 없는 글입니다 그렇습니다")], [("B", "")], [("B", inner[:30] + " 없는 끝")], [("C", "없는 글 하나 둘 셋 넷")], [("C", "없는 글 하나 둘 셋 넷")], [("Ⓐ", inner)], [("F", inner)]]
    out = passages(spark, stored, [read("d", k, f"{k}~{k}", stored[k][3].replace("<img src='x'>", "[그림]"), ranges=g) for k, g in enumerate(ranges)])
    got = [out[("d", str(k))][1] for k in range(8)]
    assert got == [[("FIXED", "brackets.A")], [("WARNING", "brackets.A")], [("WARNING", "brackets.B")], [("WARNING", "brackets.B")], [("WARNING", "brackets.C")], [("INFO", "brackets.C")], [], []]
    assert out[("d", "0")][0].replace("\n", "") == f"{BODY[:10]}[A:START]{inner}[A:END]{BODY[60:]}"
    assert "끝 위치" in out[("d", "3")][2][0] and out[("d", "1")][0] == marked


def test_a_range_without_text_is_read_off_the_layout(spark):
    out = passages(spark, [("d", "1", "1~1", BODY)], [read("d", 1, "1~1", BODY, ranges=[("B", "")])], [("d", "B", BODY[10:60]), ("d", "A", "x")])
    assert out[("d", "1")][0].replace("\n", "") == f"{BODY[:10]}[B:START]{BODY[10:60]}[B:END]{BODY[60:]}"


def test_labels_twice(spark):
    assert V.relabel("[B:START]\n가[B:END] 나 [B:START]\n다[C:END]") == ("[A:START]\n가[A:END] 나 [B:START]\n다[C:END]", "[B]→[A]")
    assert V.relabel("[A:START]x[A:END]") == ("[A:START]x[A:END]", "") and V.relabel(None) == (None, "")
    out = passages(spark, [("d", "1", "1~1", "[B:START]\n가나[B:END] 다라 [B:START]\n마바[B:END]")], [read("d", 1, "1~1", "가나 다라 마바")])
    assert out[("d", "1")][0] == "[A:START]\n가나[A:END] 다라 [B:START]\n마바[B:END]" and out[("d", "1")][1] == [("FIXED", "brackets")]


def test_underline_rules(spark):
    text = BODY.replace("나무를 베어", "<u>나무를 베어</u>").replace("한 사람이 산에 살았다", "<u>한 사람이 산에 살았다</u>")
    phrases = ["나무를 베어", "ⓐ", "다.", "나무를 베어", "찾아와 말하였다. 떡 하나 주면 안 잡아먹지만", "사람이.산에살았다!", "하나 주면", "물 었 다"]
    content, kinds, messages = passages(spark, [("d", "1", "1~1", text)], [read("d", 1, "1~1", BODY, underlines=phrases)])[("d", "1")]
    assert kinds == [("FIXED", "underlines"), ("WARNING", "underlines"), ("SKIPPED", "underlines")] and "사람이.산에살았다!" in messages[1]
    at = text.index("찾아와")  # by its first 20 characters, as long as it is
    assert content == f"{text[:at]}<u>{text[at : at + len(phrases[4])]}</u>{text[at + len(phrases[4]) :]}"
    out = passages(spark, [("d", "1", "1~1", text)], [read("d", 1, "1~1", BODY, underlines=["전혀 다른 말 qwerty"])])[("d", "1")]
    assert [k for k, _ in out[1]] == ["WARNING", "SKIPPED"] and "한 사람이" in out[2][1]  # `나무를 베어` has fewer than six letters
    assert V.confirmed(["가나다라마바\n사아자차카타"], ["사아자차카타", "가나다라마바"]) == [True] and V.confirmed(None, []) is None


def test_pictures_boxes_and_unlike_texts(spark):
    img = "<img src='a.png'>"
    stored = [("d", str(k), f"{k}~{k}", t) for k, t in enumerate([BODY, BODY + img, BODY + img + img, BODY + img, f"{BODY[:30]}{img}{BODY[30:]}", BODY + "\n<보기>\n상자의 글이다", BODY])]
    seen = [BODY + "[그림]", BODY, BODY + "[그림]", BODY + "[그림][그림]", BODY + "[그림]", BODY, "qwerty uiop asdf"]
    rows = [read("d", k, f"{k}~{k}", t, "전혀 다른 내용 xyz" if k == 5 else None) for k, t in enumerate(seen)] + [read("d", 90, "90~91", "z")]
    out = passages(spark, [*stored, ("d", "x", None, "!!!! ????"), ("e", "1", "1~1", BODY), ("d", "n", "90~91", None)], rows)
    got = [out[("d", str(k))][1] for k in range(7)]
    assert got == [[("WARNING", "images")], [("INFO", "images")], [("INFO", "images")], [("WARNING", "images")], [("WARNING", "images")], [("FIXED", "content"), ("WARNING", "bogi")], [("SKIPPED", "content")]]
    assert out[("d", "x")][1] == out[("e", "1")][1] == [("WARNING", "content")] and out[("d", "n")] == ("", [], [])


def test_pieces_of_a_reading(spark):
    rows = [read("d", 1, "1～3", "하나", underlines=["a"], seq=1), read("d", 1, None, "둘", "b1", ["b"], seq=2), read("d", 2, "", "셋", seq=1), read("d", 2, "1 ~ 3", "둘", "b2", seq=2), read("d", 2, None, "하나", underlines=["x"], seq=3), read("e", 1, None, None)]
    got = {r["read_id"]: (r["doc_id"], r["text"], r["box"], r["underlines"]) for r in V.merged_passages(spark.createDataFrame(rows, R)).where("doc_id = 'd'").collect()}
    assert got == {"1.1": ("d", "하나\n둘", "b2", ["a", "b"]), "2.1": ("d", "셋", None, [])}
    assert V.merged_passages(spark.createDataFrame(rows, R)).count() == 3


def questions(spark, stored, seen):
    rows = V.verify_questions(spark.createDataFrame(stored, Q), spark.createDataFrame(seen, QR)).collect()
    return {r["number"]: (r["stem"], r["bogi"], r["choices"], [(c["kind"], c["field"]) for c in r["corrections"]]) for r in rows}


def test_questions(spark):
    stored = [
        ("d", 1, "1. 윗글에 대한 설명으로 적절한 것은?", None, {"1": "가나다라마바사", "2": "완전히 다른 말", "3": "abcdefgh\n<img src='x'>", "4": "가나다라마", "9": "남는다"}, True),
        ("d", 2, "2.", None, None, False), ("d", 3, "3. 다음 중 알맞지 않은 것을 모두 고르시오.", "보기의 내용이 여기 있다", {"1": "x"}, True), ("d", 4, "4. 이 글의 주제로 가장 적절한 것은?", "b", None, True),
        ("d", 5, "다섯째 물음은 이것이다", None, {"1": "x"}, True), ("d", 6, "없는 물음 하나 있다", None, None, None), ("d", 8, "여덟째", None, None, False), ("d", 9, "9. [A]의 뜻은?", None, None, True),
    ]
    seen = [
        ("d", 1, "1. 윗글에 대한 설명으로 적절하지 않은 것은?", "새 상자", {"1": "가나다라마바아", "2": "qqqqq", "3": "① abcdxyzw", "4": "가나다라바사", "5": "새로"}), ("d", 7, "이 글의 주제로 가장 알맞은 것은?", None, {"1": "a"}),
        ("d", 3, "3. 다음 중 알맞지 않은 것을 모두 고르시오.", "보기의 내용은 거기 없었다", {"1": "zzz"}), ("d", 5, "qwerty", None, {"1": "y"}), ("d", 8, "여덟째", None, {"1": "y"}), ("d", 9, "9. 의 뜻은?", None, None),
    ]
    got = questions(spark, stored, seen)
    assert got[1] == ("1. 윗글에 대한 설명으로 적절하지 않은 것은?", "새 상자", {"1": "가나다라마바사", "2": "완전히 다른 말", "3": "abcdefgh", "4": "가나다라바사", "5": "새로", "9": "남는다"}, [("FIXED", "stem"), ("WARNING", "choices.2"), ("FIXED", "choices.3"), ("FIXED", "choices.4"), ("FIXED", "choices.5"), ("FIXED", "bogi")])
    assert got[2][3] == [("INFO", "stem")] and got[6][3] == [("WARNING", "stem")]
    assert got[3][3] == [("SKIPPED", "choices"), ("WARNING", "bogi")] and got[3][2] == {"1": "x"}
    assert got[4] == ("이 글의 주제로 가장 알맞은 것은?", "b", {"1": "a"}, [("FIXED", "stem"), ("FIXED", "choices")])
    assert got[5][3] == [("SKIPPED", "stem"), ("SKIPPED", "choices")] and got[8][3] == [("SKIPPED", "choices")] and got[9][3] in ([], [("FIXED", "stem")])


def test_one_table_of_corrections(spark):
    p = V.verify_passages(spark.createDataFrame([("d", "1", "1~1", BODY)], P), spark.createDataFrame([read("d", 1, "1~1", BODY, "box", ["떡 하나 주면"])], R))
    q = V.verify_questions(spark.createDataFrame([("d", 2, "2.", None, None, None)], Q), spark.createDataFrame([], QR))
    rows = V.corrections(p, q).collect()
    assert sorted((r["location"], r["seq"], r["kind"], r["field"]) for r in rows) == [("문항2", 0, "INFO", "stem"), ("지문1", 0, "FIXED", "underlines"), ("지문1", 1, "FIXED", "bogi")]
    for empty in (V.verify_passages(spark.createDataFrame([], P), spark.createDataFrame([], R)), V.verify_questions(spark.createDataFrame([], Q), spark.createDataFrame([], QR))):
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["verify_correct"])
def test_the_query_finds_text_corrections(spark, sf_dir, name):
    from folioforge import catalog

    rows = {(r["of"], r["field"], r["kind"]): r["n"] for r in catalog.load_all()[name][0](spark, sf_dir).collect()}
    assert rows[("지문", "content", "FIXED")] > 0 and rows[("문항", "bogi", "FIXED")] > 0 and rows[("문항", "choices", "SKIPPED")] > 0
