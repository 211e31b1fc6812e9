"""Snapshots, their differences, and classifiers, over documents as warnings (source: file, first line: message)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..functions import text as tx
from ..operators import regression as R
from ..session import load
from . import sql

# Two snapshots of the same corpus: the baseline lacks what came in with even-numbered sources, the current one short texts.
_SNAP = """SELECT DISTINCT source AS filename, CASE WHEN contains(text, 'http') THEN 'link' WHEN n_chars < 400 THEN 'short' ELSE 'other' END AS category,
  substring(md5(concat_ws('|', source, lang, substring(text, 1, 80))), 1, 12) AS fingerprint FROM documents WHERE {}"""
_NOW, _BEFORE = "n_chars >= 150", "NOT (source LIKE '%2' AND lang <> 'en') AND source <> 'src5'"
_CTE = f"WITH raw_c AS ({_SNAP.format(_NOW)}), raw_b AS ({_SNAP.format(_BEFORE)}), c AS (SELECT filename, fingerprint, min(category) AS category FROM raw_c GROUP BY ALL), b AS (SELECT filename, fingerprint, min(category) AS category FROM raw_b GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY filename, fingerprint")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = load(spark, sf_dir, "documents")
    cat = F.when(F.col("text").contains("http"), "link").when(F.col("n_chars") < 400, "short").otherwise("other")

    def snap(rows: DataFrame) -> DataFrame:
        w = rows.select(F.col("source").alias("filename"), F.col("lang").alias("location"), F.col("text").alias("message"), cat.alias("c"))
        key = tx.fingerprint(F.col("filename"), F.col("location"), F.col("message"))
        return w.groupBy("filename", key.alias("fingerprint")).agg(F.min("c").alias("category"))

    return snap(d.where(_NOW)), snap(d.where(_BEFORE))


@query("snapshot_counts", _CTE + " SELECT coalesce(filename, 'ALL') AS filename, coalesce(category, 'ALL') AS category, count(*) AS n FROM c GROUP BY ROLLUP (filename, category)")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(_snapshots(spark, sf_dir)[0])


@query(
    "snapshot_diff_full_outer",
    _CTE + """, nw AS (SELECT filename, count(*) AS n FROM c ANTI JOIN b USING (filename, fingerprint) GROUP BY filename), gn AS (SELECT filename, count(*) AS n FROM b ANTI JOIN c USING (filename, fingerprint) GROUP BY filename),
    tc AS (SELECT filename, count(*) AS n FROM c GROUP BY filename), tb AS (SELECT filename, count(*) AS n FROM b GROUP BY filename)
    SELECT coalesce(tc.filename, tb.filename) AS filename, coalesce(tb.n, 0) AS before, coalesce(tc.n, 0) AS now, coalesce(tc.n, 0) - coalesce(tb.n, 0) AS delta, coalesce(nw.n, 0) AS n_new, coalesce(gn.n, 0) AS n_gone,
      CASE WHEN tb.n IS NULL THEN 'NEW' WHEN tc.n IS NULL THEN 'REMOVED' WHEN tc.n < tb.n THEN 'improved' WHEN tc.n > tb.n THEN 'worsened' ELSE 'unchanged' END AS status
    FROM tc FULL OUTER JOIN tb ON tc.filename = tb.filename LEFT JOIN nw ON nw.filename = coalesce(tc.filename, tb.filename) LEFT JOIN gn ON gn.filename = coalesce(tc.filename, tb.filename)""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diff(*_snapshots(spark, sf_dir))


@query("new_fingerprints", _CTE + " SELECT filename, fingerprint FROM c ANTI JOIN b USING (filename, fingerprint)")
def new_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changes(*_snapshots(spark, sf_dir)).where("change = 'new'").select("filename", "fingerprint")


@query("gone_fingerprints", _CTE + " SELECT filename, fingerprint FROM b ANTI JOIN c USING (filename, fingerprint)")
def gone_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changes(*_snapshots(spark, sf_dir)).where("change = 'gone'").select("filename", "fingerprint")


@query(
    "segment_assertions",
    """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS bs, count(*) AS bc FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN l_quantity / 3 ELSE l_quantity END) AS cs, count(CASE WHEN l_tax > 0 THEN 1 END) AS cc FROM lineitem WHERE l_discount < 0.09 GROUP BY ALL),
       j AS (SELECT CAST(l_orderkey AS VARCHAR) AS filename, l_linenumber AS number, CASE WHEN cs IS NULL THEN 'question lost' WHEN bs > 5 AND cs < 5 THEN 'stem emptied' WHEN cc < bc THEN 'choices lost' END AS f, CASE WHEN bs > 0 AND abs(cs - bs) >= 0.5 * bs THEN 'stem length' END AS w FROM b LEFT JOIN c USING (l_orderkey, l_linenumber))
       SELECT filename, number, CASE WHEN f IS NOT NULL THEN 'FAIL' ELSE 'WARN' END AS severity, coalesce(f, w) AS reason FROM j WHERE f IS NOT NULL OR w IS NOT NULL""",
)
def segment_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").withColumn("filename", F.col("l_orderkey").cast("string")).withColumn("number", F.col("l_linenumber"))
    base = li.groupBy("filename", "number").agg(F.max("l_quantity").alias("stem_length"), F.count(F.lit(1)).alias("choices_count"))
    now = li.where("l_discount < 0.09").groupBy("filename", "number")
    now = now.agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 3).otherwise(F.col("l_quantity"))).alias("stem_length"), F.count(F.when(F.col("l_tax") > 0, 1)).alias("choices_count"))
    return R.assert_segments(now, base)


sql(
    "delta_classification",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN b < a THEN 'improved' WHEN b > a THEN 'worsened' ELSE 'unchanged' END AS status FROM
       (SELECT user_id, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS a, count(CASE WHEN event_id % 2 = 1 THEN 1 END) AS b FROM {events} GROUP BY user_id) t) s GROUP BY status""",
)
sql("classification_pivot_share", "SELECT lang, count_if(n_chars < 300) AS bogi_x, count_if(n_chars BETWEEN 300 AND 3000) AS stem_a, count_if(n_chars > 3000) AS stem_z, CASE WHEN count_if(n_chars > 3000) * 100 / count(*) >= 30 THEN 'Case A' ELSE 'Case B' END AS verdict FROM {documents} GROUP BY lang", "SELECT lang, CAST(count_if(n_chars < 300) AS BIGINT) AS bogi_x, CAST(count_if(n_chars BETWEEN 300 AND 3000) AS BIGINT) AS stem_a, CAST(count_if(n_chars > 3000) AS BIGINT) AS stem_z, CASE WHEN count_if(n_chars > 3000) * 100 / count(*) >= 30 THEN 'Case A' ELSE 'Case B' END AS verdict FROM documents GROUP BY lang")
sql("qa_summary_stale", "SELECT user_id, count_if(event_type = 'error') AS errors, max(ts) < (SELECT max(ts) FROM {events}) - INTERVAL 24 HOURS AS stale FROM {events} GROUP BY user_id", "SELECT user_id, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AS stale FROM events GROUP BY user_id")
sql("issue_stats", "SELECT source, count(*) AS questions, count_if(n_chars < 60) AS high, count_if(n_chars BETWEEN 60 AND 299) AS medium, bool_and(n_chars >= 60) AS passed FROM {documents} GROUP BY source", "SELECT source, count(*) AS questions, CAST(count_if(n_chars < 60) AS BIGINT) AS high, CAST(count_if(n_chars BETWEEN 60 AND 299) AS BIGINT) AS medium, bool_and(n_chars >= 60) AS passed FROM documents GROUP BY source")
sql(
    "validation_issues",
    """SELECT doc_id, issue.type AS type, issue.severity AS severity FROM (SELECT doc_id, explode(array_compact(array(
         CASE WHEN length(split(text, '\\n')[0]) < 40 THEN named_struct('type', 'empty_stem', 'severity', 'high') END,
         CASE WHEN size(split(text, '\\n')) < 5 THEN named_struct('type', 'choices_incomplete', 'severity', 'medium') END,
         CASE WHEN length(split(text, '\\n')[0]) > 600 THEN named_struct('type', 'stem_bogi_merged', 'severity', 'medium') END))) AS issue FROM {documents}) t""",
    """SELECT doc_id, type, CASE WHEN type = 'empty_stem' THEN 'high' ELSE 'medium' END AS severity FROM (SELECT doc_id, unnest([
         CASE WHEN length(string_split(text, chr(10))[1]) < 40 THEN 'empty_stem' END, CASE WHEN len(string_split(text, chr(10))) < 5 THEN 'choices_incomplete' END,
         CASE WHEN length(string_split(text, chr(10))[1]) > 600 THEN 'stem_bogi_merged' END]) AS type FROM documents) t WHERE type IS NOT NULL""",
)
