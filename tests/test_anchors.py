"""Regions of elements by the words that they begin with."""

from folioforge.operators import anchors as A

WORDS = [("d", 1, k, 40.0 if k < 8 else 300.0, 100.0 + 20 * (k % 8), t) for k, t in enumerate("다음 글을 읽고 물음에 답하시오 1. 윗글의 주제는 2. 그림을 보고 답하시오 A 다음 글을".split())]
ELEMENTS = [("d", 1, 1, "passage", "다음 글을 읽고 물음에 답하시오"), ("d", 1, 2, "question", "1. 윗글의 주제로 알맞은"), ("d", 1, 3, "visual", "그림을 보고"), ("d", 1, 4, "question", "없는 말"), ("d", 1, 5, "question", "a  다음"), ("d", 1, 6, "passage", None), ("d", 1, 7, "question", "2. 아닌 말"), ("d", 2, 1, "passage", "다음")]
PAGES = [("d", 1, 500.0, 800.0, 1000, 1600), ("d", 2, 500.0, 800.0, 1000, 1600)]


def regions(spark, words=WORDS, elements=ELEMENTS):
    w = spark.createDataFrame(words, "doc_id string, page_no int, n int, x0 double, y0 double, text string")
    e = spark.createDataFrame(elements, "doc_id string, page_no int, elem_no int, type string, anchor string")
    return A.anchor_regions(w, e, spark.createDataFrame(PAGES, "doc_id string, page_no int, page_w double, page_h double, image_w int, image_h int")), A.anchor_places(w, e)


def test_regions(spark):
    out, places = regions(spark)
    assert {r["elem_no"]: r["n_words"] for r in places.where("page_no = 1").collect()} == {1: 5, 2: 2, 3: 2, 5: 2, 7: 1}
    got = {(r["page_no"], r["elem_no"]): tuple(r[c] for c in ("side", "x0", "y0", "x1", "y1", "px0", "py1")) for r in out.collect() if r["found"]}
    assert got == {
        (1, 1): ("left", 30.0, 100.0, 245.0, 195.0, 60, 390), (1, 2): ("left", 30.0, 200.0, 245.0, 750.0, 60, 1500), (1, 7): ("right", 255.0, 100.0, 470.0, 175.0, 510, 350),
        (1, 3): ("right", 255.0, 115.0, 470.0, 270.0, 510, 540), (1, 5): ("right", 255.0, 180.0, 470.0, 750.0, 510, 1500),
    }
    assert {r["page_no"]: r["rate"] for r in A.anchor_rates(out).collect()} == {1: 0.714, 2: 0.0}


def test_empty_tables(spark):
    out, places = regions(spark, [], ELEMENTS)
    assert places.count() == 0 and out.where("found").count() == 0 and out.count() == 8
    out, places = regions(spark, WORDS, [])
    assert places.count() == out.count() == 0


def test_words_and_elements_go_to_their_page_once(spark):
    import re

    out, _ = regions(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert 0 < len(dealt) <= 2 and all(re.findall(r"[a-z_]+(?=#)", x) == ["doc_id", "page_no"] for x in dealt)
