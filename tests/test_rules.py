"""Rules on exam texts, file names and warnings, on samples worked out by hand."""

import pytest
from folioforge.functions import classify as C
from folioforge.functions import text as X
from folioforge.operators import correct as V
from folioforge.operators import investigate as I
from folioforge.operators import regression as R
from folioforge.operators import similarity as M
from folioforge.sources import tables as T
from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = {}


def samples(name, answer, rows):
    """rows have the arguments of `answer`, all texts, and at last what it gives, as a text."""
    RULES[name] = (answer, rows)


def _box(c: Column) -> Column:
    return C.bbox_valid(F.from_json(c, "array<double>"))


MESSAGES = [
    ("<u> 태그 미확인", "밑줄_JSON→PDF미확인", "기타"), ("PDF 밑줄 텍스트를 JSON에서 찾지 못함: '가나다'", "밑줄_PDF→JSON못찾음", "밑줄못찾음"), ("<img> 2개, [그림] 1개", "img_그림불일치", "기타"),
    ("이미지 1번 위치 불일치", "img_그림불일치", "기타"), ("이미지 개수 차이", "이미지개수불일치", "기타"), ("[A] 범위 내 텍스트 불일치", "bracket텍스트불일치", "bracket텍스트불일치"),
    ("[B] 시작 위치는 찾았으나", "bracket위치특정불가", "bracket텍스트불일치"), ("텍스트 불일치 (유사도 62%)", "텍스트불일치", "텍스트불일치"), ("선택지 3번 불일치", "텍스트불일치", "텍스트불일치"),
    ("대응하는 PDF 지문을 찾지 못했습니다", "지문못찾음", "지문못찾음"), ("PDF에서 해당 문항을 찾지 못했습니다", "문항못찾음", "문항못찾음"), ("SKIPPED: 유사도 낮음", "SKIPPED", "기타"), ("알 수 없음", "미분류", "기타"),
]
samples("message_category", C.message_category, [(m, a) for m, a, _ in MESSAGES])
samples("message_category_review", lambda m: C.message_category(m, "review"), [(m, b) for m, _, b in MESSAGES])
samples("exam_year", C.exam_year, [("2024학년도 6월 모의평가", "2024"), ("국어 2023년 9월", "2023"), ("22학년도 수능", "2022"), ("시험 2021", "2021"), ("국어", "")])
samples("academic_year", C.academic_year, [("2023", "수능", "국어", "2024"), ("2023", "6월 모의평가", "2023학년도 국어", "2023"), ("2023", "3월 학력평가", "국어", "2023"), ("", "수능", "국어", "")])
samples("exam_type", C.exam_type, [("6월 모의평가", "6월 모의평가"), ("고3 10월 학평", "10월 학력평가"), ("2024 수능 국어", "수능"), ("모평", "모의평가"), ("국어", "")])
samples("subject_track", C.subject_track, [("국어(화작)", "화법과작문"), ("언어와 매체", "언어와매체"), ("국어", "공통")])
samples("file_type", C.file_type, [("국어 정답.pdf", "answer"), ("국어( ).pdf", "combined"), ("국어(화작).pdf", "track"), ("국어영역.pdf", "paper")])
samples("image_kind", C.image_kind, [("p1_gapL.png", "gap"), ("crop_3.png", "crop"), ("page_2.png", "page"), ("fig1.png", "figure"), ("x.png", "other")])
samples("mismatch_kind", lambda f, a, b, s: C.mismatch_kind(f, a == "1", b == "1", s.cast("double")), [
    ("bogi", "1", "0", "0", "bogi_X"), ("bogi", "0", "1", "0", "bogi_Y"), ("stem", "1", "1", "0.1", "stem_Z"), ("stem", "1", "1", "0.3", "stem_B"), ("stem", "1", "1", "0.5", "stem_A"), ("image", "1", "0", "0", "other"),
])
samples("bbox_validity", _box, [("[0,0,100,100]", "true"), ("[0,0,5,5]", "false"), ("[10,0,5,90]", "false"), ("[0,0,1001,50]", "false"), ("[0,0,50]", "false"), (None, "false")])
samples("scaled_box", lambda b: F.array_join(C.scale_box(F.from_json(b, "array<double>"), F.lit(1700), F.lit(2200)).cast("array<string>"), ","), [("[0,0,500,500]", "0,0,850,1100"), ("[1,1,999,999]", "1,2,1698,2197")])
samples("comparable_form", X.comparable, [("3. “가” 나", '"가" 나'), ("(가) 글\n 둘", "글 둘"), ("a ～ b", "a ~ b"), ("<img src='x'> 뒤", "[그림] 뒤"), ("  ", "")])
samples("structure_strip", X.drop_structure, [("[A:START]가[A:END]", "가"), ("<u>밑</u>줄", "밑줄"), ("< 보 기 >글", "글"), ("앞<img src='a'>[그림]뒤", "앞뒤")])
samples("header_strip", X.drop_header, [("[1~3] 다음 글을 읽고 물음에 답하시오.\n본문", "본문"), ("다음 글을 읽고 물음에 답하시오. 본문 <img src='a'>끝", "본문 끝"), ("본문", "본문")])
samples("header_strip_keep_images", lambda c: X.drop_header(c, True), [("다음을 읽고 답하시오. <img src='a'>끝", "<img src='a'>끝"), ("[ 4 ～ 6 ] 머리\n본문", "본문")])
samples("indent_protect", X.protect_indent, [("가   나", "가 나"), ("　들여  쓴 줄", "　들여 쓴 줄"), ("끝  ", "끝")])
samples("spacing_repair", X.join_endings, [("학생 은 책 을 읽는다", "학생은 책을 읽는다"), ("한\n다.", "한다."), ("그대로", "그대로")])
samples("dialogue_breaks", X.break_dialogue, [("그렇다. 학생 1: 네", "그렇다.\n학생 1: 네"), ("좋아요! 사회자: 다음", "좋아요!\n사회자: 다음"), ("학생들", "학생들")])
samples("bracket_render", X.render_brackets, [("[A:START]가[A:END]", '<span class="bracket" data-label="A">가</span>'), ("[A:START]가[B:END]", "[A:START]가[B:END]")])
samples("image_markers", X.image_tags, [("가[[IMG:a.png]]나", '가<img src="a.png">나'), ("[[IMG:]]", "[[IMG:]]")])
samples("question_reassembly", lambda s, b, c: X.reassemble(s, b, F.from_json(c, "array<string>")), [("물음", "상자", '["a","b"]', "물음\n< 보 기 >\n상자\n① a　② b"), ("물음", "", "[]", "물음")])
samples("circled_number", X.circled, [("①", "1"), ("⑤", "5"), ("x", "0"), ("①②", "0")])
samples("verdict_parse", lambda a: F.concat_ws("|", X.verdict(a)["judgment"], X.verdict(a)["reason"]), [("판정: 오탐\n이유: 같은 글", "오탐|같은 글"), ("이유: 모름", "보류|모름"), ("", "보류|")])
samples("acceptance_guard", X.acceptance, [("가나다라마바사", "가나다라마바아", None), ("가나다라", "가나다라마바", "length 1.50"), ("① 가나다라", "가나다라마", "choices"), ("가나다라마바사아자차", "[A:START]가나다", "structure"), ("", "가", "empty")])
samples("choice_forms", lambda c: F.to_json(X.choices_map(X.choices_list(F.from_json(c, "map<string,string>")))), [('{"2":"나","1":"가"}', '{"1":"가","2":"나"}'), ("{}", "{}")])
samples("bleed_in_counts", lambda c: R.bleed_in(F.from_json(c, "array<string>")), [('["가","나 국어영역 고3"]', "1"), ('["홀수형","짝수형"]', "2"), ('["가"]', "0")])
samples("bleed_in_passages", R.bleed_in_passage, [("<u>국어영역</u> <u>고3</u> 글", "1"), ("국어영역 고3", "0")])
samples("judge_evidence", lambda c, m: I.evidence(c, m), [("밑줄못찾음", "밑줄 '가나' 없음", "밑줄 구절: 가나"), ("bracket텍스트불일치", "[B] 범위", "범위: [B]"), ("이미지개수불일치", "2개", "그림: 2개"), ("기타", "글", "글")])
samples("boilerplate_blocks", X.boilerplate, [("저작권은 평가원에", "true"), ("12", "true"), ("3 / 20", "true"), ("- 4 -", "true"), ("2024학년도 시험", "true"), ("국어 영역", "true"), ("<b>고3</b>", "true"), ("* 확인 사항", "true"), ("홀수형", "true"), ("본문 글", "false"), ("1234", "false"), ("학교 이야기", "false")])
samples("noise_underlines", X.noise_underline, [("[1～3] 다음", "true"), ("다음 글을 읽고 물음에 답하시오", "true"), ("* 각주", "true"), ("- 작자 미상, 「가시리」 -", "true"), ("3. 물음", "true"), ("밑줄 친 부분", "false")])
samples("noise_marks", X.noise_mark, [("㉠", "true"), ("[A]", "true"), ("홀수형", "true"), ("①②③ 12", "true"), ("바람이 분다", "false")])
samples("json_key_update", lambda d: T.set_json_key(d, "z", F.lit("x")), [('{"a":1,"q":[{"n":1}],"b":{"c":true}}', '{"a":1,"q":[{"n":1}],"b":{"c":true},"z":"x"}'), ('{"z":2}', '{"z":"x"}'), ("bad", '{"z":"x"}')])
samples("json_repair", T.repair_json, [('```json\n{"a":1}\n```', '{"a":1}'), ('{"a":"x\ny"}', '{"a":"x\\ny"}'), ("{not json", "{}"), ('{"a":\n1}', '{"a":\n1}')])
samples("json_objects", lambda c: F.array_join(T.objects_only(c), "|"), [('[{"a":1},2,"x",{"b":2}]', '{"a":1}|{"b":2}'), ("[]", "")])
samples("run_estimate", lambda p: F.to_json(C.estimate(p.cast("int"))), [("16", '{"tokens":20800,"usd":0.158}'), ("0", '{"tokens":0,"usd":0.0}')])
samples("money_format", lambda c: F.concat_ws(" ", X.money(c.cast("double"))["usd"], X.money(c.cast("double"))["krw"]), [("0.1905", "$0.1905 ₩263"), ("12.5", "$12.5000 ₩17,250")])
samples("leader_choices", lambda b: F.array_join(X.leader_choices(b), "|"), [("발문\n◦ 첫째 글·····①\n둘째 글·····②\n셋째····③", "첫째 글|둘째 글|셋째"), ("① 가 ② 나", None)])
samples("text_opcodes_patch", M.patched, [("가나다라", "가나바라", "가나바라"), ("가<img src='a'>나", "가나", "가<img src='a'>나"), ("① 가", "가", "① 가")])
samples("text_diff_summary", M.changes, [("가나다", "가라다", "나 → 라"), ("같다", "같다", "")])
samples("text_verdict_tiers", lambda a, b: M.text_verdict(a, b, V.tiered_ratio(a, b), 0.85), [("같은 글이다", "같은 글이다", "NONE"), ("같은 글이다 그렇다", "같은 글이다 그랬다", "FIXED"), ("가나다라 마바사", "가나다라 xyz사", "WARNING"), ("가나다", "xyz", "SKIPPED"), ("[1~3] 다음 글을 읽고 물음에 답하시오.\n본문은 짧다", "본문은 짧다", "FIXED")])
samples("image_verdicts", lambda a, b: M.image_verdict(a.cast("int"), b.cast("int")), [("0", "0", "NONE"), ("1", "1", "OK"), ("2", "1", "INFO"), ("1", "2", "WARNING"), ("1", "0", "INFO"), ("0", "1", "WARNING")])
samples("choice_verdicts", lambda s, j: M.choice_verdict(s.cast("double"), j == "1"), [("0.9", "0", "OK"), ("0.7", "0", "REPLACE"), ("0.5", "1", "TRIM"), ("0.5", "0", "WARNING"), ("0.1", "1", "WARNING")])
samples("box_verdicts", lambda a, b, s: M.box_verdict(a, b, s.cast("double")), [("", "상자", "0", "APPEND"), ("상자", "상자", "1", "OK"), ("상자", "상지", "0.82", "CORRECT"), ("상자", "다른", "0.2", "WARNING"), ("", "", "0", None)])
samples("underline_states", lambda t, p, s: V.underline_state(t, p, s.cast("double")), [("가<u>나다</u>", "나다", "0", "CONFIRMED"), ("가나다", "나다", "0", "MISSING"), ("가나다", "라", "0.8", "CONFIRMED"), ("가나다", "라", "0", "ABSENT")])
samples("anchor_tiers", V.find_anchor, [("앞 가나 다라 뒤", "가나 다라", "2"), ("앞 가나\n다라 뒤", "가나 다라", "2"), ("앞 가나다라", "“가나", "2"), ("앞 가-나-다-라-마-바", "가나다라마바", "2"), ("앞", "없음", "-1")])
samples("underline_insert", lambda t, p: V.underlined(t, F.from_json(p, "array<string>")), [("가나다", '["나다"]', "가<u>나다</u>"), ("<u>나다</u>", '["나다"]', "<u>나다</u>"), ("가", '["나다"]', "가")])


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(spark, name):
    answer, rows = RULES[name]
    n = len(rows[0]) - 1
    df = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], ", ".join(["k int", *(f"a{j} string" for j in range(n))]))
    got = df.select("k", answer(*(F.col(f"a{j}") for j in range(n))).cast("string").alias("r")).collect()
    assert [r["r"] for r in sorted(got)] == [r[-1] for r in rows]
