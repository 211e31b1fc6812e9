"""Elements of nested arrays, bounded searches among numbers, and forms of stems for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import sequences as Q
from ..session import load
from ..sources import tables as T


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of structs, the number of each as a text."""
    li = load(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").cast("string").alias("number"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))


@query("array_element_find", "SELECT l_orderkey AS doc_id, min(l_partkey) AS part FROM lineitem WHERE l_linenumber = 2 GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def array_element_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("doc_id", T.element_of(F.col("items"), "number", F.lit(2))["part"].alias("part"))


@query("kind_filter_exploded", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS number, l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'")
def kind_filter_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("doc_id", F.explode(T.of_kind(F.col("items"), "r")).alias("x")).select("doc_id", "x.number", "x.part")


@query("next_number_within", """WITH n AS (SELECT l_suppkey AS doc_id, CAST(l_orderkey AS INT) AS number, min(l_partkey) AS pos FROM lineitem GROUP BY 1, 2)
  SELECT a.doc_id, a.number, arg_min(b.pos, b.number) AS stop FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.number BETWEEN a.number + 1 AND a.number + 200 AND b.pos > a.pos GROUP BY a.doc_id, a.number""")
def next_number_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").cast("int").alias("number")).agg(F.min("l_partkey").alias("pos"))
    return Q.next_within(n, ["doc_id"], "number", "pos", 200, "stop").select("doc_id", "number", "stop")


_FORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_STEM = "turn + 1 || '.  <u>' || text || '</u>'"


@query("normalise_variants", f"""SELECT conv_id, turn, md5({_FORM.format("regexp_replace(" + _FORM.format(_STEM) + ", '^[0-9]{1,2}\\.\\s*', '')")}) AS with_tags,
  md5({_FORM.format("regexp_replace(" + _FORM.format("regexp_replace(" + _STEM + ", '</?u>', '', 'g')") + ", '^[0-9]{1,2}\\.\\s*', '')")}) AS bare FROM conversations WHERE text IS NOT NULL""")
def normalise_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").where("text is not null")
    stem = F.concat((F.col("turn") + 1).cast("string"), F.lit(".  <u>"), "text", F.lit("</u>"))
    return c.select("conv_id", "turn", F.md5(X.normalised(stem)).alias("with_tags"), F.md5(X.normalised(stem, tags=False)).alias("bare"))
