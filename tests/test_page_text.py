"""A page as it is read: columns, indents, underlines, range marks and poems."""

from folioforge.operators import geometry as G

BLOCK = "doc_id string, page_no int, block_no int, kind int, x0 double, y0 double, x1 double, y1 double, text string, page_w double, page_h double"
WORD = "doc_id string, page_no int, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
LINE = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double"
RANGE = "doc_id string, page_no int, label string, top double, bottom double"


def block(n, x0, y0, text, x1=None, kind=0, page=1):
    return ("d", page, n, kind, float(x0), float(y0), float(x1 or x0 + 200), float(y0 + 20), text, 500.0, 800.0)


def text(spark, blocks, words=(), lines=(), ranges=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {r["page_no"]: r["text"] for r in G.marked_page_text(df(blocks, BLOCK), df(words, WORD), df(lines, LINE), df(ranges, RANGE)).collect()}


def test_columns_gaps_indents_and_questions(spark):
    blocks = [
        block(0, 20, 50, "두 단에 걸친 제목이다", 480), block(1, 20, 100, "왼쪽 첫째\n줄의 글이"), block(2, 20, 122, "이어진다 여기서"), block(3, 30, 144, "들여 쓴 문단이다"), block(4, 20, 190, "넓은 틈 뒤의 글"), block(5, 20, 212, "1. 물음은 무엇인가"),
        block(6, 260, 100, "오른쪽 글이 있다"), block(7, 260, 300, "홀수형"), block(8, 260, 760, "발의 글이다 길게"), block(9, 20, 130, "그림", kind=1), block(10, 20, 240, None), block(11, 20, 100, "둘째 쪽의 글이다", page=2),
    ]
    assert text(spark, blocks) == {1: "두 단에 걸친 제목이다\n\n왼쪽 첫째 줄의 글이 이어진다 여기서\n　들여 쓴 문단이다\n넓은 틈 뒤의 글\n\n1. 물음은 무엇인가\n\n오른쪽 글이 있다", 2: "둘째 쪽의 글이다"}


def test_range_marks_by_height(spark):
    blocks = [block(k, 20, 100 + 22 * k, f"{k}째 줄의 글이다") for k in range(6)] + [block(9, 5, 130, "[A]", 15)]
    ranges = [("d", 1, "A", 126.0, 160.0), ("d", 1, "B", 205.0, 300.0), ("d", 2, "C", 0.0, 900.0)]
    assert text(spark, blocks, ranges=ranges) == {1: "0째 줄의 글이다 [A:START]\n1째 줄의 글이다 2째 줄의 글이다[A:END] 3째 줄의 글이다 [B:START]\n4째 줄의 글이다 5째 줄의 글이다[B:END]"}


def test_underlined_words_and_poems(spark):
    words = [("d", 1, 0, line, k, 20.0 + 30 * k, 100.0 + 10 * line, 45.0 + 30 * k, 108.0 + 10 * line, f"말{line}{k}") for line in (0, 1) for k in range(3)]
    lines = [("d", 1, 50.0, 109.0, 105.0, 109.0), ("d", 1, 20.0, 128.0, 45.0, 128.0)]
    assert text(spark, [block(0, 20, 100, "바꿔 쓸 글이다")], words, lines) == {1: "말00 <u>말01 말02</u> <u>말10</u> 말11 말12"}
    poem = [block(k, 20, 100 + 22 * k, f"시의 행이다 {k}", 100 if k else 220) for k in range(4)]
    assert text(spark, poem) == {1: "시의 행이다 0 시의 행이다 1\n시의 행이다 2\n시의 행이다 3"}
    assert text(spark, []) == {}
