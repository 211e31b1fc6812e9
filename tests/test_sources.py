import json

import pytest
from folioforge.sources import html as H
from folioforge.sources import tables as T
from folioforge.streaming import usage as U
from pyspark.sql import functions as F


def test_sanitise(spark):
    rows = [("<script>x</script><b>y</b>",), ('<p style="color: red; position: fixed">a</p><img src="http://e/x"><img src="/static/a.png" onerror="x">',), (None,)]
    got = [r["s"] for r in spark.createDataFrame(rows, "h string").select(H.sanitise("h").alias("s")).collect()]
    assert got == ["x<b>y</b>", '<p style="color: red">a</p><img src="/static/a.png">', None]


def test_links_posts_files_and_crawl(spark):
    page = '<a href="/12">2025년 9월 모의평가</a> <a class="x" href="https://c/f%20a.pdf?x=1"></a> <a href="/12">again</a>'
    found = H.links(spark.createDataFrame([(1, "https://h/list", page)], "page_id int, url string, html string"))
    assert [r["href"] for r in found.orderBy("pos").collect()] == ["https://h/12", "https://c/f%20a.pdf?x=1", "https://h/12"]
    assert H.first_links(found).count() == 2
    assert [(r["year"], r["exam_type"]) for r in H.posts(found).where("pos = 0").collect()] == [("2025", "9월 모의평가")]
    assert [r["filename"] for r in H.files(found).collect()] == ["f a.pdf"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "a")], "src string, href string")
    out = H.crawl(edges, spark.createDataFrame([("a",)], "href string"), 2)
    assert sorted((r["href"], r["depth"]) for r in out.collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_double_encoded_questions(spark):
    q = [{"number": 3, "stem": "s"}]
    rows = [(json.dumps({"questions": q}),), (json.dumps({"questions": json.dumps(q)}),), ("{bad",), (None,)]
    got = [r["q"] for r in spark.createDataFrame(rows, "s string").select(T.questions_of(F.col("s")).alias("q")).collect()]
    assert [None if x is None else x[0]["number"] for x in got] == [3, 3, None, None]
    fixed = spark.createDataFrame([('```json\n{"a": "x\ny"}\n```',)], "s string").select(F.from_json(T.repair_json(F.col("s")), "a string").alias("r")).first()["r"]
    assert fixed["a"] == "x\ny"


def test_reports_and_listing(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for k, (f, t, n) in enumerate([("a", "1", 5), ("a", "2", 3), ("b", "1", 0)]):
        (tmp_path / "r" / f"qa_report_{k}.json").write_text(json.dumps([{"filename": f, "timestamp": t, "summary": {"total_issues": n}}]))
    (tmp_path / "r" / "qa_report_9.json").write_text("{broken")
    reports = T.read_reports(spark, str(tmp_path / "r"), "filename string, timestamp string, summary struct<total_issues:int>")
    got = {r["filename"]: r["summary"]["total_issues"] for r in T.latest_reports(reports.where("filename is not null")).collect()}
    assert got == {"a": 3, "b": 0}
    assert {r["name"] for r in T.listing(spark, str(tmp_path / "r"), ("json",)).collect()} == {f"qa_report_{k}.json" for k in (0, 1, 2, 9)}


def test_keyed_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    T.overwrite_keys(spark.createDataFrame([("p1", 1), ("p2", 2)], "paper_code string, n int"), path, "paper_code")
    for _ in range(2):
        T.overwrite_keys(spark.createDataFrame([("p1", 9)], "paper_code string, n int"), path, "paper_code")
    assert sorted((r["paper_code"], r["n"]) for r in spark.read.parquet(path).collect()) == [("p1", 9), ("p2", 2)]
    with pytest.raises(Exception, match="already exists"):
        T.backup(spark.range(1), path)


def test_mutations(spark):
    t = {"jobs": spark.createDataFrame([(1, "a"), (2, "b")], "job_id int, x string"), "other": spark.range(2)}
    ids = spark.createDataFrame([(1,)], "job_id int")
    assert T.cascade(t, ids, "job_id")["jobs"].count() == 1 and T.cascade(t, ids, "job_id")["other"].count() == 2
    assert [tuple(r) for r in T.reference_counts(t, ids, "job_id").collect()] == [("jobs", 1, 1)]
    r = spark.createDataFrame([('{"a":"1","b":"2"}', " 7 ", " ")], "d string, n string, e string").select(T.set_json_key(F.col("d"), "a", F.lit(9)).alias("d"), T.form_int(F.col("n")).alias("n"), T.form_text(F.col("e")).alias("e")).first()
    assert json.loads(r["d"]) == {"a": 9, "b": "2"} and r["n"] == 7 and r["e"] is None
    assert T.report_lines(spark.createDataFrame([(1, None)], "a int, b int"), ["a", "b"])[-1] == "| 1 |  |"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "in")
    e.repartition(3).write.parquet(src)
    stream = U.windowed(U.read_usage(spark, src, e.schema.simpleString()[7:-1].replace(":", " ")), "1 day", "400 days")
    q = U.write_batches(stream.withColumnRenamed("start", "s"), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # nothing is later than the watermark allows, so no window has closed yet: append mode writes none
    assert q.exception() is None


def test_layout_source(spark, tmp_path):
    from folioforge.operators import investigate as I
    from folioforge.sources import layout as L

    page = {"page_no": 1, "width": 600, "height": 800, "blocks": [{"kind": 0, "box": [10, 100, 50, 120], "text": "1. 가"}, {"box": [1, 2, 3, 4]}]}
    (tmp_path / "d1.jsonl").write_text(json.dumps(page) + "\n" + json.dumps({**page, "page_no": 2}))
    rows = L.read_layout(spark, [str(tmp_path / "d1.jsonl")])
    assert rows.count() == 4 and rows.where("doc_id = 'd1' and page_no = 2 and text = '1. 가'").count() == 1
    text = L.document_text(rows.where("text <> ''").select("doc_id", "page_no", "text")).first()
    assert text["n_pages"] == 2 and text["text"].startswith("--- 페이지 1 ---\n1. 가")
    pages = spark.createDataFrame([("d", "1. a ① x\n2. b\n")], "doc_id string, text string")
    none = spark.createDataFrame([("d", 1)], "doc_id string, number int")
    got = I.missing_questions(pages, none, spark.createDataFrame([("d", 7)], "doc_id string, number int"))
    assert {r["number"]: [c[0] for c in r["causes"]] for r in got.collect()} == {2: ["C"], 7: ["A"]}
    assert {r["cause"][0]: r["count"] for r in I.cause_counts(got).collect()} == {"A": 1, "C": 1}
    many = spark.createDataFrame([("d", n, "화법과 작문" if n == 3 else "언어와 매체" if n == 5 else "x") for n in range(12)], "doc_id string, page_no int, text string")
    assert [r["doc_id"] for r in L.combined_exams(many).collect()] == ["d"]
    assert {r["section"]: len(r["pages"]) for r in L.page_classes(many).collect()} == {"hwajak": 1, "eonmae": 1, "common": 10}


def test_snapshot_documents_and_apply(spark, tmp_path):
    snap = spark.createDataFrame([("a", "x", "f1"), ("a", "x", "f2"), ("a", "y", "f3"), ("b", "x", "f4")], "filename string, category string, fingerprint string")
    T.write_snapshot(snap, str(tmp_path / "s"))
    files = {r["filename"]: r for r in spark.read.json(str(tmp_path / "s" / "files")).collect()}
    assert files["a"]["total"] == 3 and files["a"]["counts"]["x"] == 2 and files["a"]["warnings"]["x"] == ["f1", "f2"]
    assert spark.read.json(str(tmp_path / "s" / "summary")).first()["total"] == 4
    table = T.Versioned(spark, f"file://{tmp_path}/t", snap.schema, ["fingerprint"])
    table.replace(snap)
    assert T.apply(table.read().where("filename = 'a'"), table).count() == 3 and table.read().count() == 4
    assert T.apply(table.read().where("filename = 'a'"), table, dry_run=False).count() == 3 == table.read().count()


def test_numbering_in_ranges_and_texts_held_whole(spark):
    from folioforge.operators import joins as J
    from folioforge.operators import sequences as Q

    rows = spark.createDataFrame([(i * 7, "s" if i % 3 else None) for i in range(50)], "doc_id long, source string")
    got = {(r["source"], r["doc_id"]): r["n"] for r in Q.numbered(rows, ["source"], "doc_id", "n", 20).collect()}
    for s in ("s", None):
        ids = sorted(d for x, d in got if x == s)
        assert [got[s, d] for d in ids] == list(range(1, len(ids) + 1))
    docs = [(1, "xa b c d ey\nz"), (2, "a b c"), (3, None), (4, "one two")]
    items = [(1, "a b c d e"), (2, "two"), (3, "a b c d f"), (4, None), (5, "a\tb c d e")]
    r = J.containing(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, x string"), "d", "t", "i", "x").collect()
    assert sorted((x["d"], x["i"]) for x in r) == [(1, 1), (4, 2)]

