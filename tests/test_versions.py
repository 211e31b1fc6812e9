"""Versioned tables: replace, merge, a driver that is lost between steps, the memo of extractions, and stored answers."""

import random
from datetime import datetime

import pytest
from folioforge.operators import answers as A
from folioforge.sources import tables as T
from folioforge.sources import versions as V
from pyspark.sql import functions as F

SCHEMA = "id int, name string, n long"


@pytest.fixture
def table(spark, tmp_path):
    return V.Versioned(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], 4)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace_reads_from_itself(spark, table):
    assert rows(table.read()) == [] and table.version() == 0
    table.replace(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA))
    assert table.replace(table.read().withColumn("n", F.col("n") + 10)) == 2
    assert rows(table.read()) == [(1, "a", 11), (2, "b", 12)] and rows(table.read(1)) == [(1, "a", 1), (2, "b", 2)]
    table.replace(table.read().limit(0))
    assert rows(table.read()) == []


def test_merge_against_a_dictionary(spark, table):
    rng = random.Random(1)
    want = {}
    for _ in range(5):
        new = {rng.randrange(30): (rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for _ in range(9)}
        gone = rng.sample(range(30), 3)
        table.merge(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA), spark.createDataFrame([(g,) for g in gone], "id int"))
        for k, v in new.items():
            old = want.get(k, (None, None))
            want[k] = tuple(b if b is not None else a for a, b in zip(old, v, strict=True))
        want = {k: v for k, v in want.items() if k not in gone}
        assert {r[0]: r[1:] for r in rows(table.read().fillna({"name": "-", "n": 0}))} == {k: (a or "-", b or 0) for k, (a, b) in want.items()}


def test_a_merge_repeated_changes_nothing_and_only_touched_buckets_are_written(spark, table):
    new = spark.createDataFrame([(k, "a", k) for k in range(40)], SCHEMA)
    assert table.merge(new) == 1 and table.merge(new) == 1
    assert table.merge(spark.createDataFrame([(7, "b", None)], SCHEMA)) == 2 and (7, "b", 7) in rows(table.read())
    old, now = table._folders(1), table._folders(2)
    assert sum(old[b] != now[b] for b in old) == 1
    twice = spark.createDataFrame([(50, "a", 1), (50, "b", 0), (50, "a", 1)], SCHEMA)
    table.merge(twice)
    assert [r for r in rows(table.read()) if r[0] == 50] == [(50, "b", 0)]


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_driver_lost_at_any_step_leaves_the_old_table(spark, table, monkeypatch, step):
    table.replace(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    whole = getattr(V.Versioned, step)

    def lost(self, *a):
        if step == "_write":
            whole(self, *a)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(V.Versioned, step, lost)
        for write in (lambda: table.replace(spark.createDataFrame([(2, "b", 2)], SCHEMA)), lambda: table.merge(spark.createDataFrame([(1, "c", 9)], SCHEMA))):
            with pytest.raises(OSError, match="lost"):
                write()
            assert rows(table.read()) == [(1, "a", 1)] and table.version() == 1
    assert table.merge(spark.createDataFrame([(1, "c", 9)], SCHEMA)) == 2 and rows(table.read()) == [(1, "c", 9)]


def test_of_two_writers_one_must_repeat(spark, table):
    table.replace(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    mine = table._write(spark.createDataFrame([(1, "mine", 1)], SCHEMA))
    table.replace(spark.createDataFrame([(1, "other", 1)], SCHEMA))
    with pytest.raises(V.Conflict):
        table._commit(1, mine)
    assert rows(table.read()) == [(1, "other", 1)]


def test_dry_run_and_apply(spark, table):
    df = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert rows(T.apply(df, table)) == [(1, "a", 1)] and table.version() == 0
    assert rows(T.apply(df, table, dry_run=False)) == [(1, "a", 1)] and table.version() == 1
    assert rows(T.apply(table.read().withColumn("n", F.lit(5).cast("long")), table, dry_run=False)) == [(1, "a", 5)]


def test_a_second_run_extracts_nothing(spark, tmp_path):
    memo, asked = V.Versioned(spark, f"file://{tmp_path}/m", V.MEMO, ["file"], 3), []

    def extract(stale):
        asked.append(sorted(r["file"] for r in stale.collect()))
        return stale.select("file", F.when(F.col("file") != "bad", F.concat(F.lit("read "), "file")).alias("result"))

    t = lambda d: datetime(2024, 1, d)
    files = spark.createDataFrame([("a", t(1)), ("b", t(2))], "file string, modified timestamp")
    assert {r["file"]: r["result"] for r in V.memoised(files, extract, memo).collect()} == {"a": "read a", "b": "read b"}
    assert {r["file"]: r["result"] for r in V.memoised(files, extract, memo).collect()} == {"a": "read a", "b": "read b"}
    assert asked == [["a", "b"]] and memo.version() == 1
    newer = spark.createDataFrame([("a", t(1)), ("b", t(3)), ("bad", t(1))], "file string, modified timestamp")
    assert {r["file"]: r["result"] for r in V.memoised(newer, extract, memo).collect()} == {"a": "read a", "b": "read b", "bad": None}
    assert asked[1:] == [["b", "bad"]]
    V.memoised(newer, extract, memo)
    assert asked[2:] == [["bad"]] and V.memoised(files.limit(0), extract, memo).count() == 0


KEY = "■ [공통: 독서·문학]\n01. ③\n02. ⑤\n■ [선택: 언어와 매체]\n35. ③"
TEXT = "[1~3] 독서 지문 해설\n1. 정답: ③\n글의 뜻이 그렇다.\n① 아니다\n② 틀리다\n35번 정답 ④\n문법이다\n40번 정답 ①\n따로"


def test_answers_are_stored_once(spark, tmp_path):
    table = V.Versioned(spark, f"file://{tmp_path}/a", A.ANSWERS, A.ANSWER_KEY, 2)
    df = lambda *r: spark.createDataFrame(list(r), "doc_id string, text string")
    assert A.store_answers(df(("d", KEY)), df(), table) == 1
    assert A.store_answers(df(("d", KEY)), df(("d", TEXT)), table) == 2 and A.store_answers(df(("d", KEY)), df(("d", TEXT)), table) == 2
    assert A.store_answers(df(), df(), table) == 2  # nothing new overwrites nothing
    got = {(r["subject"], r["number"]): (r["answer"], r["explanation"], r["domain"]) for r in table.read().collect()}
    assert got == {("공통", 1): (3, "글의 뜻이 그렇다.", "독서"), ("공통", 2): (5, None, "독서"), ("언어와매체", 35): (3, "문법이다", None), ("공통", 40): (1, "따로", None)}
    wrong = table.read().where("number = 1").first()["wrong_answers"]
    assert wrong == '{"1":"아니다","2":"틀리다"}'


def test_explanations_and_heads(spark):
    df = spark.createDataFrame([("d", TEXT), ("n", None), ("e", "")], "doc_id string, text string")
    got = sorted((r["number"], r["correct_answer"], r["explanation"]) for r in A.explanations(df).collect())
    assert got == [(1, 3, "글의 뜻이 그렇다."), (35, 4, "문법이다"), (40, 1, "따로")]
    assert [tuple(r) for r in A.passage_heads(df).collect()] == [("d", 1, 3, "독서")]
