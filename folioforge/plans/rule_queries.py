"""Rules on exam texts, file names and warnings, over the sentences and words of all turns of conversations, each within one of the
contexts that a rule tells apart. The oracle knows what each context gives for any sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog import query
from ..functions import classify as C, text as X
from ..operators import correct as V, investigate as I, regression as R, similarity as M
from ..session import load
from ..sources import tables as T


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


#: Of each turn of a conversation: its first sentence, and the first word of that.
SENTENCE = "trim(regexp_replace(split_part(coalesce(text, ''), '.', 1), '[\\s]+', ' '{g}))"
WORD = "regexp_replace(split_part({s}, ' ', 1), '[^\\p{{L}}]', ''{g})"


def _turns(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"cast((conv_id * 8 + turn) % {n} AS int) AS sample", SENTENCE.replace("{g}", "").replace("\\", "\\\\") + " AS s")
    word = WORD.format(s="s", g="").replace("\\", "\\\\")
    return rows.selectExpr("conv_id", "turn", "sample", "coalesce(nullif(s, ''), '글') AS s", f"coalesce(nullif({word}, ''), '말') AS w")


def samples(name: str, answer: Callable[..., Column], rows: list[tuple]) -> None:
    """Register a query over the turns of conversations: each is put into one of the rows' texts, in which {s} stands for its first
    sentence and {w} for the first word of it. rows have the arguments of `answer`, all texts, and at last what it gives."""
    n = len(rows[0]) - 1
    values = ", ".join(f"({k}, {_literal(r[-1])})" for k, r in enumerate(rows))
    s, w = SENTENCE.replace("{g}", ", 'g'"), WORD.format(s="s", g=", 'g'")
    oracle = f"""WITH t AS (SELECT conv_id, turn, CAST((conv_id * 8 + turn) % {len(rows)} AS INT) AS sample, {s} AS s FROM conversations),
      u AS (SELECT conv_id, turn, sample, coalesce(nullif(s, ''), '글') AS s, coalesce(nullif({w}, ''), '말') AS w FROM t)
      SELECT conv_id, turn, replace(replace(v.answer, '{{s}}', s), '{{w}}', w) AS answer FROM u JOIN (VALUES {values}) AS v(sample, answer) USING (sample)"""

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        few = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], ", ".join(["sample int", *(f"a{j} string" for j in range(n))]))
        turns = _turns(spark, sf_dir, len(rows)).join(F.broadcast(few), "sample")
        filled = lambda j: F.replace(F.replace(F.col(f"a{j}"), F.lit("{s}"), F.col("s")), F.lit("{w}"), F.col("w"))
        return turns.select("conv_id", "turn", *(filled(j).alias(f"f{j}") for j in range(n))).select("conv_id", "turn", answer(*(F.col(f"f{j}") for j in range(n))).cast("string").alias("answer"))


MESSAGES = [
    ("<u> 태그 미확인: {s}", "밑줄_JSON→PDF미확인", "기타"), ("PDF 밑줄 텍스트를 JSON에서 찾지 못함: '{s}'", "밑줄_PDF→JSON못찾음", "밑줄못찾음"), ("<img> 2개, [그림] 1개 {w}", "img_그림불일치", "기타"),
    ("이미지 1번 위치 불일치 {s}", "img_그림불일치", "기타"), ("이미지 개수 차이 {w}", "이미지개수불일치", "기타"), ("[A] 범위 내 텍스트 불일치 {s}", "bracket텍스트불일치", "bracket텍스트불일치"),
    ("[B] 시작 위치는 찾았으나 {s}", "bracket위치특정불가", "bracket텍스트불일치"), ("텍스트 불일치 (유사도 62%) {s}", "텍스트불일치", "텍스트불일치"), ("선택지 3번 불일치 {s}", "텍스트불일치", "텍스트불일치"),
    ("대응하는 PDF 지문을 찾지 못했습니다 {s}", "지문못찾음", "지문못찾음"), ("PDF에서 해당 문항을 찾지 못했습니다 {s}", "문항못찾음", "문항못찾음"), ("SKIPPED: 유사도 낮음 {s}", "SKIPPED", "기타"), ("알 수 없음 {s}", "미분류", "기타"),
]
samples("message_category", C.message_category, [(m, a) for m, a, _ in MESSAGES])
samples("message_category_review", lambda m: C.message_category(m, "review"), [(m, b) for m, _, b in MESSAGES])
samples("exam_year", C.exam_year, [("{w} 2024학년도 6월 모의평가", "2024"), ("{s} 2023년 9월", "2023"), ("22학년도 수능 {s}", "2022"), ("{s} 2021", "2021"), ("{s}", "")])
samples("academic_year", C.academic_year, [("2023", "수능", "{s}", "2024"), ("2023", "6월 모의평가", "2023학년도 {s}", "2023"), ("2023", "3월 학력평가", "{s}", "2023"), ("", "수능", "{s}", "")])
samples("exam_type", C.exam_type, [("{w} 6월 모의평가", "6월 모의평가"), ("고3 10월 학평 {w}", "10월 학력평가"), ("2024 수능 {s}", "수능"), ("{s} 모평", "모의평가"), ("{s}", "")])
samples("subject_track", C.subject_track, [("{w}(화작)", "화법과작문"), ("{w} 언어와 매체", "언어와매체"), ("{s}", "공통")])
samples("file_type", C.file_type, [("{w} 정답.pdf", "answer"), ("{w} 국어( ).pdf", "combined"), ("{w} 국어(화작).pdf", "track"), ("{w}영역.pdf", "paper")])
samples("image_kind", C.image_kind, [("{w}_gapL.png", "gap"), ("{w}/crop_3.png", "crop"), ("{w}/page_2.png", "page"), ("{w}/fig1.png", "figure")])
samples("comparable_form", X.comparable, [("3. “{s}” 나", '"{s}" 나'), ("(가) {s}\n 둘", "{s} 둘"), ("{w} ～ b", "{w} ~ b"), ("<img src='x'>  {s} ", "[그림] {s}"), ("{s}", "{s}")])
samples("structure_strip", X.drop_structure, [("[A:START]{s}[A:END]", "{s}"), ("<u>{w}</u>줄", "{w}줄"), ("< 보 기 >{s}", "{s}"), ("{s}<img src='a'>[그림]뒤", "{s}뒤")])
samples("header_strip", X.drop_header, [("[1~3] 다음 글을 읽고 물음에 답하시오.\n{s}", "{s}"), ("다음 글을 읽고 물음에 답하시오. {s} <img src='a'>끝", "{s} 끝"), ("{s}", "{s}")])
samples("header_strip_keep_images", lambda c: X.drop_header(c, True), [("다음을 읽고 답하시오. <img src='a'>{s}", "<img src='a'>{s}"), ("[ 4 ～ 6 ] {w}\n{s}", "{s}")])
samples("indent_protect", X.protect_indent, [("{w}   나", "{w} 나"), ("　{s}  쓴 줄", "　{s} 쓴 줄"), ("{s}  ", "{s}")])
samples("spacing_repair", X.join_endings, [("{w} 학생 은 책 을 읽는다", "{w} 학생은 책을 읽는다"), ("{s} 한\n다.", "{s} 한다."), ("{s}", "{s}")])
samples("dialogue_breaks", X.break_dialogue, [("{s}. 학생 1: 네", "{s}.\n학생 1: 네"), ("{w}! 사회자: {s}", "{w}!\n사회자: {s}"), ("{s} 학생들", "{s} 학생들")])
samples("bracket_render", X.render_brackets, [("[A:START]{s}[A:END]", '<span class="bracket" data-label="A">{s}</span>'), ("[A:START]{s}[B:END]", "[A:START]{s}[B:END]")])
samples("image_markers", X.image_tags, [("{s}[[IMG:{w}.png]]나", '{s}<img src="{w}.png">나'), ("{w}[[IMG:]]", "{w}[[IMG:]]")])
samples("question_reassembly", lambda s, b, c: X.reassemble(s, b, F.from_json(c, "array<string>")), [("{s}", "{w}", '["a","{w}"]', "{s}\n< 보 기 >\n{w}\n① a　② {w}"), ("{s}", "", "[]", "{s}")])
samples("circled_number", X.circled, [("①", "1"), ("⑤", "5"), ("{w}x", "0"), ("①②", "0")])
samples("verdict_parse", lambda a: F.concat_ws("|", X.verdict(a)["judgment"], X.verdict(a)["reason"]), [("판정: 오탐\n이유: {s}", "오탐|{s}"), ("이유: {s}", "보류|{s}"), ("{w}", "보류|")])
samples("acceptance_guard", X.acceptance, [("{s}가나다라마바사", "{s}가나다라마바아", None), ("{s}{s}", "{s}{s}{s}", "length 1.50"), ("① {s}나다라마바사", "{s}나다라마바사", "choices"), ("{s}1234567890{s}1234567890", "{s}[A:START]1{s}1234567890", "structure"), ("", "{w}", "empty")])
samples("choice_forms", lambda c: F.to_json(X.choices_map(X.choices_list(F.from_json(c, "map<string,string>")))), [('{"2":"{s}","1":"{w}"}', '{"1":"{w}","2":"{s}"}'), ("{}", "{}")])
samples("bleed_in_counts", lambda c: R.bleed_in(F.from_json(c, "array<string>")), [('["{s}","{w} 국어영역 고3"]', "1"), ('["{s} 홀수형","짝수형"]', "2"), ('["{s}"]', "0")])
samples("bleed_in_passages", R.bleed_in_passage, [("<u>국어영역</u> <u>고3</u> {s}", "1"), ("국어영역 고3 {s}", "0")])
samples("judge_evidence", lambda c, m: I.evidence(c, m), [("밑줄못찾음", "밑줄 '{w}' 없음", "밑줄 구절: {w}"), ("bracket텍스트불일치", "[B] 범위 {s}", "범위: [B]"), ("이미지개수불일치", "2개", "그림: 2개"), ("기타", "{w}", "{w}")])
samples("boilerplate_blocks", X.boilerplate, [("{s} 저작권은 평가원에", "true"), ("12", "true"), ("3 / 20", "true"), ("- 4 -", "true"), ("2024학년도 {s}", "true"), ("<b>고3</b> {w}", "true"), ("* 확인 사항 {s}", "true"), ("홀수형 {w}", "true"), ("본문 글 {s}", "false"), ("1234", "false"), ("{s}", "false")])
samples("noise_underlines", X.noise_underline, [("[1～3] {s}", "true"), ("{w} 글을 읽고 물음에 답하시오", "true"), ("* {s}", "true"), ("- {w} 미상, 「{w}」 -", "true"), ("3. {s}", "true"), ("{s}", "false")])
samples("noise_marks", X.noise_mark, [("㉠", "true"), ("[A]", "true"), ("홀수형", "true"), ("①②③ 12", "true"), ("{s} 분다", "false")])
samples("json_key_update", lambda d: T.set_json_key(d, "z", F.lit("x")), [('{"a":"{s}","q":[{"n":1}],"b":{"c":"{w}"}}', '{"a":"{s}","q":[{"n":1}],"b":{"c":"{w}"},"z":"x"}'), ('{"z":"{s}"}', '{"z":"x"}'), ("{w} bad", '{"z":"x"}')])
samples("json_repair", T.repair_json, [('```json\n{"a":"{s}"}\n```', '{"a":"{s}"}'), ('{"a":"{w}\n{s}"}', '{"a":"{w}\\n{s}"}'), ("{not {w}", "{}"), ('{"a":\n"{s}"}', '{"a":\n"{s}"}')])
samples("json_objects", lambda c: F.array_join(T.objects_only(c), "|"), [('[{"a":"{s}"},2,"{w}",{"b":2}]', '{"a":"{s}"}|{"b":2}'), ("[]", "")])
samples("leader_choices", lambda b: F.array_join(X.leader_choices(b), "|"), [("발문\n◦ {w} 글·····①\n{w}·····②\n셋째····③", "{w} 글|{w}|셋째"), ("① {s} ② 나", None)])
samples("text_opcodes_patch", M.patched, [("{w} 가나다라", "{w} 가나바라", "{w} 가나바라"), ("{w}<img src='a'>나", "{w}나", "{w}<img src='a'>나"), ("① {w}", "{w}", "① {w}")])
samples("text_diff_summary", M.changes, [("{w} 가나다", "{w} 가라다", "나 → 라"), ("{s}", "{s}", "")])
samples("text_verdict_tiers", lambda a, b: M.text_verdict(a, b, V.tiered_ratio(a, b), 0.85), [("{s}", "{s}", "NONE"), ("{w} 같은 글이다 그렇다", "{w} 같은 글이다 그랬다", "FIXED"), ("가나다라 마바사", "가나다라 xyz사", "WARNING"), ("가나다", "xyz", "SKIPPED"), ("[1~3] 다음 글을 읽고 물음에 답하시오.\n{s}", "{s}", "FIXED")])
samples("box_verdicts", lambda a, b, s: M.box_verdict(a, b, s.cast("double")), [("", "{s}", "0", "APPEND"), ("{s}", "{s}", "1", "OK"), ("{s} 자", "{s} 지", "0.82", "CORRECT"), ("{s}", "다른", "0.2", "WARNING"), ("", "", "0", None)])
samples("underline_states", lambda t, p, s: V.underline_state(t, p, s.cast("double")), [("가<u>{w}</u>", "{w}", "0", "CONFIRMED"), ("{s} 나다", "나다", "0", "MISSING"), ("{s}", "라", "0.8", "CONFIRMED"), ("{s}", "라", "0", "ABSENT")])
samples("anchor_tiers", V.find_anchor, [("앞 가나 {w} 뒤", "가나 {w}", "2"), ("앞 가나\n{w} 뒤", "가나 {w}", "2"), ("앞 가나{w}", "“가나", "2"), ("앞 가-나-다-라-마-바{w}", "가나다라마바", "2"), ("{s}", "없음", "-1")])
samples("underline_insert", lambda t, p: V.underlined(t, F.from_json(p, "array<string>")), [("{w} 나다", '["나다"]', "{w} <u>나다</u>"), ("<u>나다 {w}</u>", '["나다"]', "<u>나다 {w}</u>"), ("{s}", '["나다"]', "{s}")])


# --- rules on numbers: those of line items ---

_LINE = "l_orderkey AS a, l_linenumber AS b, l_partkey AS p"


def numbers(name: str, oracle: str, answer: Callable[[], dict[str, Column]]) -> None:
    """Register a query of answers over all line items; the oracle has the same columns."""

    @query(name, f"SELECT {_LINE}, {oracle} FROM lineitem")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = load(spark, sf_dir, "lineitem")
        return rows.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("p"), *(c.alias(n) for n, c in answer().items()))


_q, _p, _d = (lambda: F.col("l_quantity").cast("double")), (lambda: F.col("l_partkey")), (lambda: F.col("l_discount").cast("double"))
_corners = lambda: F.array(_q() * 20, (_p() % 1100).cast("double"), _q() * 20 + _p() % 50, (_p() % 1100 + _q() % 30).cast("double"))
_field = lambda: F.element_at(F.array(F.lit("bogi"), F.lit("stem"), F.lit("image")), (_p() % 3 + 1).cast("int"))

numbers("bbox_validity", """l_quantity * 20 BETWEEN 0 AND 1000 AND l_partkey % 1100 <= 1000 AND l_quantity * 20 + l_partkey % 50 <= 1000 AND l_partkey % 1100 + CAST(l_quantity AS DOUBLE) % 30 <= 1000
  AND l_partkey % 50 > 0 AND CAST(l_quantity AS DOUBLE) % 30 > 0 AND (l_partkey % 50) * (CAST(l_quantity AS DOUBLE) % 30) >= 100 AS valid""", lambda: {"valid": C.bbox_valid(_corners())})
numbers("scaled_box", """CAST(trunc(l_quantity * 20 * 1700 / 1000) AS INT) AS x0, CAST(trunc((l_partkey % 1100) * 2200 / 1000) AS INT) AS y0""", lambda: {"x0": C.scale_box(_corners(), F.lit(1700), F.lit(2200))[0], "y0": C.scale_box(_corners(), F.lit(1700), F.lit(2200))[1]})
numbers("mismatch_kind", """CASE l_partkey % 3 WHEN 0 THEN CASE WHEN l_quantity > 25 AND l_linenumber % 2 <> 0 THEN 'bogi_X' WHEN l_quantity <= 25 AND l_linenumber % 2 = 0 THEN 'bogi_Y' ELSE 'other' END
  WHEN 1 THEN CASE WHEN l_discount * 10 < 0.2 THEN 'stem_Z' WHEN l_discount * 10 < 0.4 THEN 'stem_B' ELSE 'stem_A' END ELSE 'other' END AS kind""", lambda: {"kind": C.mismatch_kind(_field(), _q() > 25, F.col("l_linenumber") % 2 == 0, _d() * 10)})
numbers("run_estimate", "CAST(l_quantity * 1300 AS BIGINT) AS tokens, round(CAST(l_quantity AS DOUBLE) * 0.0099, 3) AS usd", lambda: {"tokens": C.estimate(F.col("l_quantity").cast("int"))["tokens"], "usd": C.estimate(F.col("l_quantity").cast("int"))["usd"]})
numbers("money_format", """printf('$%d.%04d', CAST(l_quantity AS BIGINT), (l_partkey % 100) * 100) AS usd, '₩' || regexp_replace(CAST(CAST(l_quantity AS BIGINT) * 1380 + CAST(round((l_partkey % 100) * 13.8, 0) AS BIGINT) AS VARCHAR), '(\\d)(\\d{3})$', '\\1,\\2') AS krw""",
    lambda: {"usd": X.money(F.col("l_quantity").cast("int") + (_p() % 100) / 100)["usd"], "krw": X.money(F.col("l_quantity").cast("int") + (_p() % 100) / 100)["krw"]})
numbers("image_verdicts", """CASE WHEN l_partkey % 3 = 0 AND l_linenumber % 3 = 0 THEN 'NONE' WHEN l_partkey % 3 = l_linenumber % 3 THEN 'OK' WHEN l_partkey % 3 > l_linenumber % 3 THEN 'INFO' ELSE 'WARNING' END AS verdict""", lambda: {"verdict": M.image_verdict(_p() % 3, F.col("l_linenumber") % 3)})
numbers("choice_verdicts", """CASE WHEN l_quantity / 50.0 >= 0.85 THEN 'OK' WHEN l_quantity / 50.0 >= 0.6 THEN 'REPLACE' WHEN l_quantity / 50.0 >= 0.4 AND l_linenumber % 2 = 1 THEN 'TRIM' ELSE 'WARNING' END AS verdict""", lambda: {"verdict": M.choice_verdict(_q() / 50, F.col("l_linenumber") % 2 == 1)})
