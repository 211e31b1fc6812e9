"""Parts that no query runs: page marks, stem classes, underlines of a page, schemas, listings and catalogs."""

from folioforge.functions import text as X
from folioforge.operators import correct as V
from folioforge.operators import geometry as G
from folioforge.operators import segment as S
from folioforge.operators import sequences as Q
from folioforge.sources import layout as L
from folioforge.sources import tables as T
from pyspark.sql import functions as F
from pyspark.sql import types as TY


def test_stem_classes(spark):
    rows = [("", False, "empty"), ("  ", True, "empty"), ("12.", False, "number_only"), (" 3．  ", False, "number_only"), ("물음 <보기>\n상자의 글", False, "box_in_stem"), ("물음 <보기>\n상자의 글이 길게 이어진다", True, "ok"), ("짧은 물음", False, "short"), ("다음 중 적절한 것을 고르시오.", False, "ok")]
    got = spark.createDataFrame(rows, "t string, b boolean, w string").select("w", S.stem_class(F.col("t"), F.col("b")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["w"] for r in got]


def test_page_marks_and_forms(spark):
    df = spark.createDataFrame([("--- 페이지 1 ---\n가\n--- 페이지 22 ---\n나", "12.  <u>가 \n 나</u> <img src='x'>"), (None, None)], "a string, b string")
    r = df.select(X.drop_page_marks(F.col("a")), X.normalised(F.col("b")), X.normalised(F.col("b"), tags=False)).collect()
    assert tuple(r[0]) == ("가\n나", "<u>가 나</u> <img src='x'>", "가 나 <img src='x'>") and tuple(r[1]) == (None, None, None)


def test_underlines_of_a_page(spark):
    p = spark.createDataFrame([("d", 1, "p1", "앞의 글 밑줄 친 말이 여기 있다"), ("d", 2, "p2", "밑줄 친 말"), ("e", 1, "p3", "밑줄 친 말")], "doc_id string, page_no int, passage_id string, content string")
    m = spark.createDataFrame([("d", 1, "밑줄 친 말이"), ("d", 1, "앞의 글 밑줄 친 말이 여기 없다고 한다"), ("d", 1, "앞의 글 밑줄 친 말이 여기 있다 그리고 더"), ("d", 2, "없음")], "doc_id string, page_no int, phrase string")
    assert sorted((r["passage_id"], r["phrase"]) for r in V.page_underlines(p, m).collect()) == [("p1", "밑줄 친 말이"), ("p1", "앞의 글 밑줄 친 말이 여기 없다고 한다"), ("p1", "앞의 글 밑줄 친 말이 여기 있다 그리고 더")]


def test_text_blocks_and_estimates(spark):
    b = spark.createDataFrame([(1, 100.0, 120.0, "본문의 글", 1000.0), (2, 100.0, 120.0, "홀수형", 1000.0), (3, 10.0, 20.0, "머리", 1000.0), (4, 900.0, 920.0, "발", 1000.0), (5, 100.0, 120.0, None, 1000.0)], "n int, y0 double, y1 double, text string, page_h double")
    assert sorted(r["n"] for r in G.text_blocks(b).collect()) == [1, 5]
    e = G.estimate_run(spark.createDataFrame([("d", 16), ("e", 0)], "doc_id string, pages int")).collect()
    assert [(r["est_tokens"], r["est_usd"]) for r in e] == [(20800, 0.158), (0, 0.0)]


def test_columns_that_a_table_lacks_are_added(spark):
    want = TY.StructType().add("id", TY.IntegerType()).add("name", TY.StringType()).add("n", TY.LongType())
    out = T.with_columns(spark.createDataFrame([(1, "own")], "id int, extra string"), want)
    assert out.columns == ["id", "extra", "name", "n"] and out.first().asDict() == {"id": 1, "extra": "own", "name": None, "n": None}
    assert T.with_columns(out, want).columns == out.columns and dict(out.dtypes)["n"] == "bigint"


def test_first_folder_of_a_job(spark):
    files = spark.createDataFrame([("a", "scan", "1"), ("a", "crop", "2"), ("a", "scan", "3"), ("b", "crop", "4"), ("c", "other", "5")], "job_id string, folder string, name string")
    assert sorted((r["job_id"], r["name"]) for r in T.first_folder(files, ["scan", "crop"]).collect()) == [("a", "1"), ("a", "3"), ("b", "4")]


def test_columns_of_the_catalog(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("folio_t")
    got = {(r["table"], r["column"]): r["type"] for r in L.columns_of(spark).collect()}
    assert got[("folio_t", "id")] == "int" and got[("folio_t", "name")] == "string"
    spark.catalog.dropTempView("folio_t")
    assert "folio_t" not in {r["table"] for r in L.columns_of(spark).collect()}


def test_elements_and_bounded_search(spark):
    items = "array<struct<number:string,kind:string>>"
    df = spark.createDataFrame([([("1", "WARNING"), ("x", "info"), ("2", "Warning"), ("2", None)],), ([],), (None,)], f"i {items}")
    rows = df.select(T.element_of(F.col("i"), "number", F.lit(2)).alias("e"), F.size(T.of_kind(F.col("i"), "warning")).alias("n")).collect()
    assert (rows[0]["e"]["kind"], rows[0]["n"]) == ("Warning", 2) and rows[1]["e"] is None and rows[1]["n"] == 0
    n = spark.createDataFrame([("d", 1, 0), ("d", 2, 5), ("d", 4, 3), ("d", 20, 50)], "k string, n int, p int")
    assert {r["n"]: r["s"] for r in Q.next_within(n, ["k"], "n", "p", 15, "s").collect()} == {1: 5, 2: None, 4: None, 20: None}
    assert {r["n"]: r["s"] for r in Q.next_within(n, ["k"], "n", "p", 18, "s").collect()} == {1: 5, 2: 50, 4: 50, 20: None}


def test_missing_questions_by_where_each_number_stands_first(spark):
    from folioforge.operators import investigate as I

    text = "intro\n 1. first ① a\n7.5 loose\n2．second\n3.\n4. 페이지\n1. again, without\n07. seven\n45. ② b\n46. no\r5. behind a return"
    pages = spark.createDataFrame([("d", text), ("e", "9. x\n09. y\n"), ("n", None)], "doc_id string, text string")
    stored = spark.createDataFrame([("d", 2)], "doc_id string, number int")
    reported = spark.createDataFrame([("d", 7), ("d", 46), ("d", 1), ("n", 3), ("z", 1)], "doc_id string, number int")
    rows = I.missing_questions(pages, stored, reported).collect()
    got = {(r["doc_id"], r["number"]): (r["in_text"], r["reported"], "".join(c[0] for c in r["causes"])) for r in rows}
    assert len(rows) == len(got) and got == {
        ("d", 1): (True, True, "BD"), ("d", 3): (True, False, "BC"), ("d", 4): (True, False, "BC"), ("d", 5): (True, False, "C"), ("d", 7): (True, True, "BCD"), ("d", 45): (True, False, ""),
        ("d", 46): (False, True, "CD"), ("e", 9): (True, False, "C"), ("n", 3): (False, True, "A"), ("z", 1): (False, True, "A"),
    }
    for r in rows:
        at = {1: text.index(" 1."), 7: text.index("7.5"), 46: text.index("46")}.get(r["number"])
        assert r["doc_id"] != "d" or at is None or r["context"] == text[max(at - 30, 0) : max(at - 30, 0) + 60]
