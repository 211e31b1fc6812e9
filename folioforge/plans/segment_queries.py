"""Segmentation, validation and repair over documents made of numbered turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..operators import segment as S
from ..session import load


def _exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exam texts: each turn is a numbered question, its first words the choices."""
    c = load(spark, sf_dir, "conversations")
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    marks = F.transform(F.slice(words, 2, 5), lambda w, i: F.concat(F.substring(F.lit(S.MARKS), i + 1, F.lit(1)), F.lit(" "), w))
    q = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.col("text"), F.lit("\n"), F.array_join(marks, " "))
    parts = F.array_sort(F.collect_list(F.struct("turn", q.alias("q"))))
    return c.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda p: p["q"]), "\n\n").alias("text"))


@query("segment_documents")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.segment_documents(_exams(spark, sf_dir))
    return s.select("doc_id", F.size("passages").alias("n_passages"), F.size("questions").alias("n_questions"), F.aggregate("questions", F.lit(0), lambda a, q: a + F.coalesce(F.size(q["choices"]), F.lit(0))).alias("n_choices"))


@query("segment_issue_stats")
def segment_issue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.segment_documents(_exams(spark, sf_dir))
    return S.issue_stats(s, S.issues(s))


@query("auto_patch")
def auto_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _exams(spark, sf_dir)
    s = S.segment_documents(docs).withColumn("questions", F.filter("questions", lambda q, i: i % 3 != 1))
    return S.patch_documents(s, docs).select("doc_id", F.size("questions").alias("n_questions"), F.size("patch_log").alias("n_log"))


@query("question_anchors", r"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, turn + 1 AS n, text || chr(10) || coalesce((SELECT string_agg(substr('①②③④⑤', i + 1, 1) || ' ' || w[i + 2], ' ' ORDER BY i) FROM range(5) r(i) WHERE i + 2 <= len(w)), '') AS body
    FROM (SELECT *, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM conversations) c),
  q AS (SELECT *, CAST(n AS VARCHAR) || '. ' || body AS part FROM t)
  SELECT doc_id, CAST(n AS INT) AS number, CAST(coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM q""")
def question_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each numbered question starts in its document."""
    d = _exams(spark, sf_dir)
    return S.question_anchors(d)


@query("answer_pipeline", """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, '공통' AS subject, CAST(l_linenumber AS INT) AS number, CAST(min(CAST(l_quantity AS BIGINT) % 5 + 1) AS INT) AS answer FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answer keys: their lines' numbers and quantities as rows of two lines each."""
    from ..operators import answers as A

    li = load(spark, sf_dir, "lineitem")
    mark = F.substring(F.lit("①②③④⑤"), (F.col("l_quantity") % 5 + 1).cast("int"), F.lit(1))
    pair = F.concat(F.col("l_linenumber").cast("string"), F.lit("\n"), mark)
    docs = li.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(pair)), "\n").alias("text"))
    return A.answer_table(docs)
