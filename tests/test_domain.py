"""The domain corpus: Korean exam texts, messages and layouts with expected values worked out by hand."""

import pytest
from folioforge.functions import classify as C
from folioforge.functions import text as X
from folioforge.operators import answers as A
from folioforge.operators import geometry as G
from folioforge.operators import regression as R
from folioforge.operators import segment as S
from folioforge.operators import sequences as Q
from folioforge.operators import similarity as M
from pyspark.sql import functions as F

D1 = """--- 페이지 1 ---
[1~2] 다음 글을 읽고 물음에 답하시오.
독서는 글을 통해 저자와 대화하는 과정이다. 독자는 배경지식을 활용하여 의미를 구성한다.

1. 윗글에 대한 설명으로 적절한 것은?
① 가 ② 나 ③ 다 ④ 라 ⑤ 마

2. <보기>를 참고할 때 적절한 것은? [3점]
<보기>
상자 내용
① A ② B ③ C ④ D ⑤ E
"""


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_segmentation(spark):
    r = S.segment_documents(spark.createDataFrame([("d", D1), ("n", None), ("e", "no numbers")], "doc_id string, text string")).collect()
    by = {x["doc_id"]: x for x in r}
    assert [p["content"] for p in by["d"]["passages"]] == ["독서는 글을 통해 저자와 대화하는 과정이다. 독자는 배경지식을 활용하여 의미를 구성한다."]
    q1, q2 = by["d"]["questions"]
    assert q1["stem"] == "1. 윗글에 대한 설명으로 적절한 것은?" and q1["bogi"] is None
    assert q1["choices"] == {"1": "가", "2": "나", "3": "다", "4": "라", "5": "마"}
    assert q2["stem"] == "2. <보기>를 참고할 때 적절한 것은? [3점]" and q2["bogi"] == "상자 내용" and q2["choices"]["5"] == "E"
    assert q1["passage_idx"] == q2["passage_idx"] == 0
    assert by["n"]["questions"] == [] and by["e"]["passages"] == []


def test_islands_and_missing(spark):
    assert sorted(S.believed({n: n for n in (1, 2, 3, 4, 10, 20, 21)})) == [1, 2, 3, 4, 20, 21]
    assert sorted(S.believed({n: n for n in (1, 9, 30)})) == [1, 9, 30]
    rows = spark.createDataFrame([("d", n) for n in (1, 2, 3, 4, 10, 20, 21)] + [("e", n) for n in (1, 9, 30)] + [("f", n) for n in (1, 11, 21, 31)], "doc string, n int")
    got = sorted((r["doc"], r["n"]) for r in Q.valid_numbers(rows, ["doc"], "n").collect())
    assert got == [("d", n) for n in (1, 2, 3, 4, 20, 21)] + [("e", n) for n in (1, 9, 30)] + [("f", n) for n in (1, 11, 21, 31)]
    rows = spark.createDataFrame([("d", n) for n in (1, 2, 5, 12)], "doc string, n int")
    assert sorted(r["missing"] for r in Q.missing_numbers(rows, ["doc"], "n").collect()) == [3, 4]


def test_zones(spark):
    rows = spark.createDataFrame([("d", p) for p in (10, 20, 900, 2000)], "doc string, pos int")
    assert sorted((r["start"], r["end"]) for r in Q.zones(rows, ["doc"], "pos").collect()) == [(10, 120), (900, 1000), (2000, 2100)]


def test_issues(spark):
    q = {"number": 2, "passage_idx": None, "stem": "2.", "bogi": None, "choices": {"1": "a", "2": "b", "3": "c", "4": "d"}, "content": "", "has_choices": True}
    s = spark.createDataFrame([("d", [], [q])], S.SCHEMA)
    found = S.issues(s)
    assert sorted((r["type"], r["severity"]) for r in found.collect()) == [("choices_incomplete", "medium"), ("empty_stem", "high")]
    assert S.issue_stats(s, found).first()["passed"] is False


def test_patch(spark):
    seg = S.segment_documents(spark.createDataFrame([("d", D1)], "doc_id string, text string"))
    three = D1.replace("2. <보기>", "3. <보기>").replace("① 가", "① 가") + "\n2. 새로 찾은 문항은?\n① 1 ② 2 ③ 3 ④ 4 ⑤ 5\n"
    seg3 = S.segment_documents(spark.createDataFrame([("d", three.replace("\n2. 새로", "\n새로"))], "doc_id string, text string"))
    out = S.patch_documents(seg3, spark.createDataFrame([("d", three)], "doc_id string, text string")).first()
    assert [q["number"] for q in out["questions"]] == [1, 2, 3]
    assert [(p["type"], p["patched"]) for p in out["patch_log"]] == [("missing_question", True)]
    assert S.patch_documents(seg, spark.createDataFrame([], "doc_id string, text string")).first()["patch_log"] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("■ [공통: 독서·문학]\n01. ③\n02. ⑤\n■ [선택: 언어와 매체]\n35. ③", [(1, 3, "공통"), (2, 5, "공통"), (35, 3, "언어와매체")]),
        ("1\n②\n2\n③", [(1, 2, "공통"), (2, 3, "공통")]),
        ("1\n②\n화법과 작문\n35\n①\n35\n④\n언어와 매체\n35\n⑤", [(1, 2, "공통"), (35, 1, "화법과작문"), (35, 5, "언어와매체")]),
        ("nothing", []),
    ],
)
def test_answer_table(spark, text, want):
    rows = A.answer_table(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    assert sorted((r["number"], r["answer"], r["subject"]) for r in rows) == sorted(want)


@pytest.mark.parametrize(("table", "pos"), [(4, 2), (1, 2), (2, 1)])
def test_prefer_answered(spark, table, pos):
    rows = spark.createDataFrame([("d", 35, 1, 2), ("d", 35, 2, 4)], "doc_id string, number int, pos int, correct_answer int")
    ans = spark.createDataFrame([("d", 35, table)], "doc_id string, number int, answer int")
    assert S.prefer_answered(rows, ans).first()["pos"] == pos


def test_attach_by_range(spark):
    qs = [{"number": n, "passage_idx": None, "stem": "", "bogi": None, "choices": None, "content": "", "has_choices": False} for n in (3, 4, 7)]
    ps = [{"id": "p1", "question_range": "1~3", "content": "", "short": None}, {"id": "p2", "question_range": "4～6", "content": "", "short": None}]
    out = S.attach_passages(spark.createDataFrame([("d", ps, qs)], S.SCHEMA)).collect()
    assert {r["number"]: r["passage_idx"] for r in out} == {3: 0, 4: 1, 7: None}


MESSAGES = [
    ("JSON의 <u> 태그가 PDF에서 미확인: x", "밑줄_JSON→PDF미확인", "기타"),
    ("PDF 밑줄 텍스트를 지문에서 찾지 못함: x", "밑줄_PDF→JSON못찾음", "밑줄못찾음"),
    ("[A] 범위 내 텍스트 불일치 — 수동 확인 필요", "bracket텍스트불일치", "bracket텍스트불일치"),
    ("[B] 시작 위치는 찾았으나 끝 위치 특정 불가 x", "bracket위치특정불가", "bracket텍스트불일치"),
    ("JSON에 <img> 1개 존재하나 Gemini가 [그림]을 감지하지 못함 x", "img_그림불일치", "기타"),
    ("대응하는 PDF 지문을 찾지 못했습니다. x", "지문못찾음", "지문못찾음"),
    ("PDF에서 해당 문항을 찾지 못했습니다. x", "문항못찾음", "문항못찾음"),
]


def test_message_categories(spark):
    rows = spark.createDataFrame([(m,) for m, *_ in MESSAGES], "m string")
    got = rows.select("m", C.message_category(F.col("m")).alias("a"), C.message_category(F.col("m"), "review").alias("b")).collect()
    assert [tuple(r) for r in got] == MESSAGES


def test_years(spark):
    assert [one(spark, t, C.exam_year) for t in ("25학년도", "2024학년도", "none", "2023년 a 2022")] == ["2025", "2024", "", "2023"]
    rows = [("2025", "9월 모의평가", "x", "2026"), ("2025", "7월 학력평가", "x", "2025"), ("2024", "수능", "2024학년도 수능", "2024"), ("", "수능", None, "")]
    df = spark.createDataFrame(rows, "y string, e string, n string, w string")
    assert all(r["g"] == r["w"] for r in df.select("w", C.academic_year(F.col("y"), F.col("e"), F.col("n")).alias("g")).collect())
    assert one(spark, "2025년 9월 모의평가 국어", C.exam_type) == "9월 모의평가" and one(spark, "2024 수능", C.exam_type) == "수능"


def test_text_scalars(spark):
    assert one(spark, "　 a  b　", X.squeeze) == "a b" and one(spark, "③", X.circled) == 3 and one(spark, "x", X.circled) == 0
    assert one(spark, "3. “a”  b<img src=x>", X.comparable) == '"a" b[그림]'
    assert one(spark, "[[IMG:/a.png]]", X.image_tags) == '<img src="/a.png">'
    assert one(spark, "[A:START]x[A:END]", X.render_brackets) == '<span class="bracket" data-label="A">x</span>'
    assert one(spark, "판정: 오탐\n이유: 같다", X.verdict) == ("오탐", "같다") and one(spark, "?", X.verdict)["judgment"] == "보류"
    assert one(spark, ["a", "b"], X.choices_map, "array<string>") == {"1": "a", "2": "b"}
    assert one(spark, {"10": "z", "2": "b"}, X.choices_list, "map<string,string>") == ["b", "z"]
    got = spark.createDataFrame([("x" * 100, "x" * 60), ("① a", "① a"), ("① a b", "a b c")], "a string, b string").select(X.acceptance(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == ["length 0.60", None, "choices"]
    assert one(spark, [50, 30, 450, 480], lambda c: C.scale_box(c, F.lit(1700), F.lit(2200)).alias("x"), "array<int>") is not None
    df = spark.createDataFrame([([30, 50, 480, 450],)], "b array<int>").select(C.scale_box(F.col("b"), F.lit(1700), F.lit(2200)).alias("r"), C.bbox_valid(F.col("b")).alias("v")).first()
    assert df["r"] == [51, 110, 816, 990] and df["v"]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a"), ("", "")], "a string, b string").select(M.seq_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in df] == [0.75, 0.0, 1.0]
    stored = spark.createDataFrame([("d", "p1", "1~3", "alpha beta"), ("d", "p2", None, "the quick brown fox"), ("d", "p3", None, "zzzz")], "doc_id string, passage_id string, question_range string, content string")
    read = spark.createDataFrame([("d", 1, "1 ～ 3", "other"), ("d", 2, None, "the quick brown fix")], "doc_id string, read_id int, question_range string, text string")
    got = {r["passage_id"]: r["read_id"] for r in M.match_passages(stored, read).collect()}
    assert got == {"p1": 1, "p2": 2}
    assert M._patch("가나다 <img src=x> 라", "가너다 라") == "가너다 <img src=x> 라"


def test_compare_questions(spark):
    seen = spark.createDataFrame([("d", 1, "abc def", True, 5, False), ("d", 2, "x", False, 5, False)], "doc_id string, number int, stem string, has_bogi boolean, choice_count int, has_image boolean")
    stored = spark.createDataFrame([("d", 1, "abc def", "", 4, "")], "doc_id string, number int, stem string, bogi string, choice_count int, content string")
    assert sorted((r["number"], r["field"]) for r in M.compare_questions(seen, stored).collect()) == [(1, "bogi"), (1, "choices"), (2, "missing")]


def test_regression(spark):
    w = [("f1", "p1", "a"), ("f1", "p1", "b"), ("f2", "p1", "a")]
    b = [("f1", "p1", "a"), ("f3", "p1", "z")]
    now, before = (R.snapshot(spark.createDataFrame(x, "filename string, location string, message string")) for x in (w, b))
    got = {r["filename"]: (r["before"], r["now"], r["n_new"], r["n_gone"], r["status"]) for r in R.diff(now, before).collect()}
    assert got == {"f1": (1, 2, 1, 0, "worsened"), "f2": (0, 1, 1, 0, "NEW"), "f3": (1, 0, 0, 1, "REMOVED")}
    flip = {r["filename"]: (r["n_new"], r["n_gone"]) for r in R.diff(before, now).collect()}
    assert flip == {f: (g, n) for f, (_, _, n, g, _) in got.items()}
    assert one(spark, ["고3 국어", "ok"], R.bleed_in, "array<string>") == 1


def test_geometry(spark):
    xs = spark.createDataFrame([("d", 1, i, 0, float(i), 10.0, 20.0 * i + 60, 20.0 * i + 70, "t", 1000.0, 1000.0) for i in range(12)], "doc_id string, page_no int, block_no int, kind int, x0 double, x1 double, y0 double, y1 double, text string, page_w double, page_h double")
    assert G.column_baselines(xs).first()["baseline"] == 1.0
    assert G.page_text(xs).first()["text"].count("t") == 12
    lab = spark.createDataFrame([("d", 1, "A", 10.0, 20.0, 95.0, 105.0), ("d", 1, "B", 500.0, 510.0, 495.0, 505.0)], "doc_id string, page_no int, label string, x0 double, x1 double, y0 double, y1 double")
    ver = spark.createDataFrame([("d", 1, 30.0, 30.0, 50.0, 200.0)], "doc_id string, page_no int, x0 double, x1 double, y0 double, y1 double")
    box = spark.createDataFrame([], "doc_id string, page_no int, x0 double, x1 double, y0 double, y1 double")
    got = {r["label"]: (r["top"], r["bottom"]) for r in G.bracket_ranges(lab, ver, box, 1000.0).collect()}
    assert got == {"A": (50.0, 200.0), "B": (420.0, 580.0)}


def test_merge_extracts(spark):
    rows = [("d", 1, 7, "ab", "", {"1": "x"}), ("d", 2, 7, "abc", "box", {"1": "longer", "2": "y"}), ("d", 3, 7, "xyz", "late", {"2": "q"})]
    r = S.merge_extracts(spark.createDataFrame(rows, "doc_id string, page_no int, number int, stem string, bogi string, choices map<string,string>")).first()
    assert (r["stem"], r["bogi"], r["choices"]) == ("abc", "box", {"1": "longer", "2": "y"})


def test_anchor_tiers_and_underlines():
    from folioforge.operators import correct as V

    assert V.anchor("가 나다  라마", "나다 라마") == 2 and V.anchor('x "abc def', "abc def") == 3 and V.anchor("a", "zzz") == -1
    assert V.anchor("ab-cd.ef gh", "abcdefgh") == 0 and V.anchor(None, "x") == -1
    assert V.underline("가나다 라마", ["나다", "없음", "", None]) == "가<u>나다</u> 라마"
    assert V.underline("<u>나다</u>", ["나다"]) == "<u>나다</u>"


def test_spacing(spark):
    assert one(spark, "학생 은 간다", X.join_endings) == "학생은 간다"
    assert one(spark, "끝났다. 학생 1: 네", X.break_dialogue) == "끝났다.\n학생 1: 네"
    assert one(spark, "a   b  \n　c", X.protect_indent) == "a b\n　c"


ASK = "다음 중 적절한 것은?"


def test_a_long_stem_ends_behind_the_last_request():
    long = "가" * 60
    text = f"1. {'나' * 420} {ASK}\n\n{long} 이어지는 글 {ASK}\n\n{long}\n① 가 ② 나"
    assert S.stem(text).endswith(ASK) and S.stem(text).count(ASK) == 2
    assert [r for r, _ in S.stem_ends(text)] == ["choice", "unmarked"]
    assert S.stem("2. 물음 [A:START] 상자") == "2. 물음" and S.stem(f"2. 물음 [A:START] {ASK}") == f"2. 물음 [A:START] {ASK}"


def test_a_closing_mark_ahead_of_the_opening_one_makes_no_open_box():
    assert S.box("물음 [A:START] 글 [[IMG:a.png]] 끝\n① 가") == "[[IMG:a.png]] 끝"
    assert S.box("물음 [A:END] 글 [A:START] [[IMG:a.png]] 끝\n① 가") is None
    assert S.box("물음 [A:START] 상자 [A:END]\n① 가") == "상자" and S.box("물음 < 보 기 > 글 [[IMG:b.png]]\n① 가") == "[[IMG:b.png]]"


def test_choices_and_next_passage():
    passage = "다음 지문은 " + "길다 " * 30
    block = f"3. {ASK}\n① 가 ② 나\n③ 다\n\n{passage}\n둘째 줄"
    assert S.choices(block) == {"1": "가", "2": "나", "3": "다"} and S.trim_next_passage(block).endswith("③ 다")
    assert S.passage_behind(block) == f"{passage}\n둘째 줄".strip() and S.passage_behind("글만 " * 40) is None
    assert S.choices("없다") is None and S.choices("① 가 ① 또 ② 나") == {"1": "가 ① 또", "2": "나"}


def test_issue_of_a_merged_box_counts_what_is_behind_the_request(spark):
    rows = [("d", [], [(1, None, "가" * 10 + " 고르시오  .   " + "나" * n, None, {"1": "a", "2": "b", "3": "c", "4": "d", "5": "e"}, "", True)]) for n in (49, 50)]
    seg = spark.createDataFrame([(f"{d}{k}", p, q) for k, (d, p, q) in enumerate(rows)], S.SCHEMA)
    assert [(r["doc_id"], r["type"]) for r in S.issues(seg).collect()] == [("d1", "stem_bogi_merged")]


def test_first_free_labels(spark):
    from folioforge.operators import correct as V

    assert V.free_labels(["A"], ["A", "B", "b", "?", ""]) == ["B", "C", "D", "E", "F"] and V.free_labels(list(V.LABELS), ["A"]) == [None]
    assert V.free_labels([], ["A", "A", "A"], [False, True, True]) == ["A", "A", "B"]
    r = V.label_ranges(spark.createDataFrame([("d", 2, "A"), ("d", 1, "A"), ("e", 1, "C")], "doc_id string, pos int, label string"), spark.createDataFrame([("d", ["B"])], "doc_id string, labels array<string>"))
    assert sorted((x["doc_id"], x["pos"], x["actual"]) for x in r.collect()) == [("d", 1, "A"), ("d", 2, "C"), ("e", 1, "C")]
    r = V.label_ranges(spark.createDataFrame([("d", 1, "A", False), ("d", 2, "A", True), ("d", 3, "A", None)], "doc_id string, pos int, label string, found boolean"), spark.createDataFrame([], "doc_id string, labels array<string>"))
    assert sorted((x["pos"], x["actual"]) for x in r.collect()) == [(1, None), (2, "A"), (3, None)]


TEXT = "처음 글이 있고 가나다라 마바사 끝난다 그리고 한참 더 이어지는 글이 뒤에 있다"


@pytest.mark.parametrize(
    ("text", "phrases", "ranges", "want"),
    [
        (TEXT, ["글이"], [("A", "가나다라", "마바사")], TEXT.replace("글이", "<u>글이</u>", 1).replace("가나다라 마바사", "[A:START]\n가나다라 마바사\n[A:END]")),
        # a range that isn't there takes no label
        (TEXT, [], [("A", "없는 말", "끝"), ("A", "가나다라", "마바사")], TEXT.replace("가나다라 마바사", "[A:START]\n가나다라 마바사\n[A:END]")),
        # other white space: the mark stands behind the match, not behind the phrase's length
        (TEXT.replace("가나다라 마바사", "가나다라\n  마바사"), [], [("b", "가나다라", "라 마바사")], TEXT.replace("가나다라 마바사", "[B:START]\n가나다라\n  마바사\n[B:END]")),
        (TEXT, ["가나다라   마바사"], None, TEXT.replace("가나다라 마바사", "<u>가나다라 마바사</u>")),
        (TEXT.replace("가나다라 마바사", "가나다라\n마바사"), ["가나다라 마바사"], [], TEXT.replace("가나다라 마바사", "<u>가나다라\n마바사</u>")),
        ("<u>가나다라 마바사</u> 끝", ["가나다라 마바사아자"], [], "<u>가나다라 마바사</u> 끝"),  # its first ten characters are underlined
        (TEXT, [], [("A", "처음", "뒤에 있다")], TEXT),  # more than half
        ("① 가 ② 나 " + "다" * 150 + " 라마바 사아 " + "자" * 100, [], [("A", "라마바", "사아")], "① 가 ② 나 " + "다" * 150 + " [A:START]\n라마바 사아\n[A:END] " + "자" * 100),  # behind the zone
        ("가나 다라 ① 가 ② 나 " + "다" * 150, [], [("A", "가나", "다라 ①")], "가나 다라 ① 가 ② 나 " + "다" * 150),  # meets it
        ("[A:START]\n글[A:END] " + TEXT, [], [("A", "가나다라", "마바사"), ("", "한참", "더"), ("Z", "", "x")], "[A:START]\n글[A:END] " + TEXT.replace("가나다라 마바사", "[B:START]\n가나다라 마바사\n[B:END]").replace("한참 더", "[C:START]\n한참 더\n[C:END]")),
        (None, ["x"], [("A", "a", "b")], None), ("", [], [], ""),
    ],
)
def test_structure_is_put_into_a_text(spark, text, phrases, ranges, want):
    from folioforge.operators import correct as V

    rows = spark.createDataFrame([("d", text, phrases, ranges)], "doc_id string, text string, phrases array<string>, ranges array<struct<label:string,start:string,end:string>>")
    assert V.structured(rows).first()["text"] == want


def test_choice_zones():
    from folioforge.operators import correct as V

    assert V.choice_zones("①" + "x" * 799 + "②" + "x" * 801 + "③") == [(0, 900), (1602, 1702)] and V.choice_zones("x") == []


def test_image_places(spark):
    from folioforge.operators import correct as V

    a = spark.createDataFrame([("d", "p1", "앞의 글 하나 <img src='x'> 뒤 또 다른 말 <img src='y'>"), ("d", "p2", "글 <img src='x'>")], "doc_id string, passage_id string, content string")
    b = spark.createDataFrame([("d", "p1", "앞의 글 하나 [그림] 뒤 xyz0123456789abc [그림]"), ("d", "p2", "[그림] [그림]")], "doc_id string, passage_id string, text string")
    assert [(r["passage_id"], r["n"]) for r in V.image_places(a, b).collect()] == [("p1", 2)]
