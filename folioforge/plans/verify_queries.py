"""Verification of conversations' turns, as passages, against second readings made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..operators import verify as V
from ..session import load


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").where("text is not null")
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), "turn", F.concat(F.col("turn"), F.lit("~"), F.col("turn")).alias("question_range"), "text")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, every other one with a picture, and a reading of the same words with an underline, a range, some boxes and pictures."""
    t = _turns(spark, sf_dir)
    stored = t.select("doc_id", F.col("turn").cast("string").alias("passage_id"), "question_range", F.concat("text", F.when(F.col("turn") % 2 == 0, '<img src="x">').otherwise("")).alias("content"))
    ranges = F.when(F.length("text") >= 95, F.array(F.struct(F.lit("Ⓐ").alias("label"), F.substring("text", 31, 60).alias("text")))).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
    read = t.select(
        "doc_id", F.col("turn").alias("page_no"), F.lit(0).alias("seq"), "question_range", F.concat("text", F.when(F.col("turn") % 4 == 0, "[그림]").otherwise("")).alias("text"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("box "), F.col("turn"))).alias("box"), F.array(F.substring("text", 11, 24)).alias("underlines"), ranges.alias("ranges"),
    )
    return V.verify_passages(stored, read)


@query("verify_marks", r"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, text, regexp_replace(substr(text, 11, 24), '^\s+|\s+$', '', 'g') AS u, regexp_replace(substr(text, 31, 60), '^\s+|\s+$', '', 'g') AS g FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, length(u) > 2 AND NOT (length(regexp_replace(u, '\s', '', 'g')) <= 4 AND (length(text) - length(replace(text, u, ''))) / length(u) > 1) AS has_u, length(text) >= 95 AS has_g, position(u IN text) - 1 AS us,
  position(regexp_replace(left(g, 30), '^\s+|\s+$', '', 'g') IN text) - 1 AS gs, regexp_replace(CASE WHEN length(g) > 30 THEN right(g, 30) ELSE g END, '^\s+|\s+$', '', 'g') AS tail FROM t),
s AS (SELECT *, us + length(u) AS ue, gs + position(tail IN substr(text, gs + 1)) - 1 + length(tail) AS ge FROM p),
m AS (SELECT doc_id, turn, us AS pos, 2 AS k, '<u>' AS mark FROM s WHERE has_u UNION ALL SELECT doc_id, turn, ue, -2, '</u>' FROM s WHERE has_u
  UNION ALL SELECT doc_id, turn, gs, 1, '[A:START]' || chr(10) FROM s WHERE has_g UNION ALL SELECT doc_id, turn, ge, -1, chr(10) || '[A:END]' FROM s WHERE has_g
  UNION ALL SELECT doc_id, turn, length(text), 0, CASE WHEN turn % 2 = 0 THEN '<img src="x">' ELSE '' END FROM s),
w AS (SELECT m.*, s.text, lag(pos, 1, 0) OVER (PARTITION BY doc_id, turn ORDER BY pos, k) AS prev FROM m JOIN s USING (doc_id, turn)),
c AS (SELECT doc_id, turn, string_agg(substr(text, CAST(prev + 1 AS BIGINT), CAST(pos - prev AS BIGINT)) || mark, '' ORDER BY pos, k) AS content FROM w GROUP BY doc_id, turn)
SELECT doc_id, CAST(turn AS VARCHAR) AS passage_id, md5(content || CASE WHEN turn % 3 = 0 THEN chr(10) || '<보기>' || chr(10) || 'box ' || turn ELSE '' END) AS digest,
  CAST(has_u AS INT) + CAST(has_g AS INT) + CAST(turn % 3 = 0 AS INT) AS fixed, CAST(turn % 2 = 0 AND turn % 4 <> 0 AS INT) AS info FROM s JOIN c USING (doc_id, turn)""")
def verify_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.size(F.filter("corrections", lambda c: c["kind"] == kind))
    return _marked(spark, sf_dir).select("doc_id", "passage_id", F.md5("content").alias("digest"), of("FIXED").alias("fixed"), of("INFO").alias("info"))


@query("verify_correct")
def verify_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections of turns by a second reading of them with every fifth word in capitals, and of their first sentences as stems."""
    t = _turns(spark, sf_dir)
    words = F.transform(F.split("text", " "), lambda w, i: F.when(i % 5 == 4, F.upper(w)).otherwise(w))
    passages = t.select("doc_id", F.col("turn").cast("string").alias("passage_id"), "question_range", F.col("text").alias("content"))
    none = F.array().cast("array<string>")
    read = t.select("doc_id", F.col("turn").alias("page_no"), F.lit(0).alias("seq"), "question_range", F.array_join(words, " ").alias("text"), F.lit(None).cast("string").alias("box"), none.alias("underlines"), F.array().cast("array<struct<label:string,text:string>>").alias("ranges"))
    number, head = F.col("turn").cast("int").alias("number"), F.substring_index("text", ".", 1)
    choices = F.create_map(F.lit("1"), F.substring_index("text", ".", -2))
    questions = t.select("doc_id", number, head.alias("stem"), F.lit(None).cast("string").alias("bogi"), choices.alias("choices"), F.lit(True).alias("has_choices"))
    again = t.select("doc_id", number, F.regexp_replace(head, "e", "é").alias("stem"), head.alias("box"), F.transform_values(choices, lambda _, v: F.upper(v)).alias("choices"))
    fixes = V.corrections(V.verify_passages(passages, read), V.verify_questions(questions, again))
    return fixes.groupBy(F.substring("location", 1, 2).alias("of"), "field", "kind").agg(F.count(F.lit(1)).alias("n"))
