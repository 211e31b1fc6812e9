"""The whole job of a document, and a job's status from its events."""

from folioforge.operators import job as J
from folioforge.operators import segment as S

from .test_domain import D1

DOCS = "doc_id string, text string"


def job(spark, docs, pieces=(), questions=(), answers=(), structure=None):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return J.run(df(docs, DOCS), df(pieces, J.PIECES), df(questions, J.QUESTIONS), df(answers, J.KEY), None if structure is None else df(structure, J.STRUCTURE))


def test_the_whole_job(spark):
    first = "독서는 글을 통해 저자와 대화하는 과정이다. 독자는 배경지식을 활용하여 의미를 구성한다."
    pieces = [("d", 1, 1, None, first.replace("배경지식", "배경 지식"), None, ["저자와 대화하는"], [])]
    questions = [("d", 1, "1. 윗글에 대한 설명으로 적절한 것은?", None, {"1": "가", "2": "나"}), ("d", 2, "2. <보기>를 참고할 때 알맞은 것은? [3점]", "상자 내용", {"5": "E"})]
    out = job(spark, [("d", D1), ("n", None), ("e", "번호가 없는 글")], pieces, questions, [("d", 1, 3, "까닭"), ("d", 2, 5, ""), ("d", 9, 1, "x")])
    got = {r["doc_id"]: r.asDict() for r in out.summary.collect()}
    assert got["d"] == {"doc_id": "d", "status": "reviewing", "n_passages": 1, "n_questions": 2, "n_patched": 0, "n_issues": 0, "passed": True, "fixed": 2, "open": 0, "n_answers": 2}
    assert got["n"]["status"] == "error" and got["n"]["n_questions"] == 0 and got["e"]["status"] == "reviewing"
    assert [r["content"] for r in out.passages.collect()] == [first.replace("저자와 대화하는", "<u>저자와 대화하는</u>")]  # what a reading only adds is left
    asked = {r["number"]: r for r in out.questions.collect()}
    assert (asked[1]["answer"], asked[1]["explanation"], asked[2]["answer"], asked[2]["explanation"]) == (3, "까닭", 5, None)
    assert asked[1]["passage_idx"] == 0 and asked[2]["stem"] == "2. <보기>를 참고할 때 적절한 것은? [3점]"
    log = sorted((r["doc_id"], r["seq"], r["status"]) for r in out.events.collect())
    assert [s for d, _, s in log if d == "d"] == ["analyzing", "segmenting", "qa_checking", "tagging", "verifying", "parsing answers", "reviewing"]
    assert [s for d, _, s in log if d == "n"] == ["analyzing", "error"]


def test_structure_patches_and_issues(spark):
    lost = D1.replace("2. <보기>", "3. <보기>") + "\n2. 새로 찾은 문항은?\n① 1 ② 2 ③ 3 ④ 4 ⑤ 5\n"
    bad = "1. 물음은 무엇인가 적절한 것은?\n① 가 ② 나\n3. 둘\n① 가 ② 나 ③ 다 ④ 라 ⑤ 마"
    out = job(spark, [("p", lost), ("b", bad)], structure=[("p", ["저자와 대화하는"], [("A", "독자는", "활용하여")])])
    got = {r["doc_id"]: (r["status"], r["passed"]) for r in out.summary.collect()}
    assert got["b"] == ("needs_attention", False) and got["p"][1]
    assert [r["content"] for r in out.passages.where("doc_id = 'p'").collect()][0].count("<u>저자와 대화하는</u>") == 1
    assert "vision" in {r["status"] for r in out.events.where("doc_id = 'p'").collect()} and out.events.where("status = 'vision' and doc_id = 'b'").count() == 0


def test_empty_tables(spark):
    out = job(spark, [])
    assert out.summary.count() == out.questions.count() == out.passages.count() == out.events.count() == out.corrections.count() == 0


def test_status_of_a_stream_of_events(spark, tmp_path):
    """Events in any order, twice and late: the sink ends with the last stage of each job."""
    events = [("a", 0, "analyzing"), ("b", 0, "analyzing"), ("a", 7, "reviewing"), ("a", 2, "segmenting"), ("a", 7, "reviewing"), ("b", 1, "error"), ("b", 0, "analyzing")]
    schema = "doc_id string, seq int, status string"
    src = tmp_path / "in"
    seen = {}
    for k in range(0, len(events), 3):
        spark.createDataFrame(events[k : k + 3], schema).coalesce(1).write.mode("append").json(str(src))
    stream = J.status_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))

    def sink(batch, _):
        seen.update({r["doc_id"]: r["status"] for r in batch.collect()})

    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination(120)
    assert seen == {"a": "reviewing", "b": "error"}
    assert {r["doc_id"]: r["status"] for r in J.status_of(spark.createDataFrame(events, schema)).collect()} == seen
    assert S.LONG_STEM == 400
