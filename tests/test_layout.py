"""Layout files: splits, pruned kinds, pushed page filters, three tables and the underlines of a page."""

import json

from folioforge.sources import layout as L
from pyspark.sql import functions as F


def _file(path, pages):
    path.write_text("".join(json.dumps(p, ensure_ascii=False) + "\n" for p in pages))
    return f"file://{path}"


PAGE = {
    "page_no": 1, "width": 500.0, "height": 800.0,
    "blocks": [{"box": [1, 2, 3, 4], "text": "본문"}, {"box": [5, 6, 7, 8], "kind": 1}],
    "words": [{"box": [10, 100, 40, 110], "text": "밑줄", "block": 0, "line": 0, "word": 0}, {"box": [45, 100, 80, 110], "text": "친 말", "block": 0, "line": 0, "word": 1}, {"box": [200, 100, 230, 110], "text": "밖", "block": 0, "line": 0, "word": 2}, {"box": [10, 300, 30, 310], "text": "㉠", "block": 1, "line": 0, "word": 0}],
    "drawings": [
        {"box": [8, 112, 90, 112.5], "width": 0.5, "kind": "line"}, {"box": [90, 112, 8, 112], "width": 0.5, "kind": "line"}, {"box": [8, 112, 90, 112], "width": 2.0, "kind": "line"}, {"box": [8, 112, 20, 112], "width": 0.5, "kind": "line"},
        {"box": [5, 311, 60, 311], "width": 0.5, "kind": "line"}, {"box": [8, 112, 90, 112], "width": 0.5, "kind": "rect"}, {"box": [8, 112, 90, 112], "kind": "line"},
    ],
}


def test_three_tables_and_underlines(spark, tmp_path):
    path = _file(tmp_path / "d1.layout.jsonl", [PAGE, {"page_no": 2, "width": 1.0, "height": 1.0}])
    (tmp_path / "broken.jsonl").write_text("{bad\n\n" + json.dumps({**PAGE, "page_no": 7}) + "\n")
    pages = L.layout_pages(spark, [path, f"file://{tmp_path}/broken.jsonl"])
    assert sorted((r["doc_id"], r["page_no"]) for r in pages.collect()) == [("broken", 7), ("d1", 1), ("d1", 2)]
    one = pages.where("doc_id = 'd1'")
    assert [tuple(r) for r in L.layout_blocks(one).collect()] == [("d1", 1, 0, 1.0, 2.0, 3.0, 4.0, 0, "본문", 500.0, 800.0), ("d1", 1, 1, 5.0, 6.0, 7.0, 8.0, 1, "", 500.0, 800.0)]
    words, drawings = L.layout_words(one), L.layout_drawings(one)
    assert [r["text"] for r in words.orderBy("n").collect()] == ["밑줄", "친 말", "밖", "㉠"] and drawings.count() == 7
    assert [tuple(r) for r in L.underline_manifest(words, drawings).collect()] == [("d1", 1, "밑줄 친 말")]


def test_a_file_has_several_splits_and_only_what_is_asked_for_is_read(spark, tmp_path):
    path = _file(tmp_path / "big.jsonl", [{**PAGE, "page_no": k} for k in range(400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        some = L.layout_blocks(L.layout_pages(spark, [path], F.col("page_no").between(10, 19)))
        assert some.rdd.getNumPartitions() > 3 and some.select("page_no").distinct().count() == 10
        plan = some.select("page_no", "text")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(page_no,10)" in plan and "drawings" not in plan.split("ReadSchema")[1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
