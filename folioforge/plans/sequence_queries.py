"""Gaps, islands, zones, runs and slices over turns, events and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..operators import sequences as S
from ..session import load
from . import sql


@query(
    "missing_numbers",
    """SELECT l_orderkey, unnest(range(n + 1, nx)) AS missing FROM (SELECT l_orderkey, n, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS nx
       FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem) d) t WHERE nx - n BETWEEN 2 AND 5""",
)
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing_numbers(load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n")), ["l_orderkey"], "n")


@query(
    "islands",
    """WITH d AS (SELECT DISTINCT user_id, event_id FROM events), g AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 300 THEN 1 ELSE 0 END AS nw FROM d),
       i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM g)
       SELECT user_id, CAST(island AS BIGINT) AS island, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island""",
)
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.island_ids(load(spark, sf_dir, "events").select("user_id", "event_id").distinct(), ["user_id"], "event_id", 300)
    return rows.groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query(
    "valid_question_numbers",
    """WITH d AS (SELECT DISTINCT l_orderkey, l_partkey % 45 AS n FROM lineitem), g AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY l_orderkey ORDER BY n) > 2 THEN 1 ELSE 0 END AS nw FROM d),
       i AS (SELECT *, sum(nw) OVER (PARTITION BY l_orderkey ORDER BY n) AS island FROM g), s AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, island) AS sz, count(*) OVER (PARTITION BY l_orderkey) AS total FROM i)
       SELECT l_orderkey, n FROM (SELECT *, max(sz) OVER (PARTITION BY l_orderkey) AS mx FROM s) t WHERE total <= 3 OR sz >= 2 OR mx = 1""",
)
def valid_question_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.valid_numbers(load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 45).alias("n")), ["l_orderkey"], "n")


@query(
    "zones",
    """WITH d AS (SELECT user_id, event_id AS pos FROM events), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) > 800 THEN 1 ELSE 0 END AS nw FROM d),
       i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS z FROM g) SELECT user_id, min(pos) AS start, max(pos) + 100 AS "end" FROM i GROUP BY user_id, z""",
)
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.zones(load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos")), ["user_id"], "pos")


@query(
    "running_gap",
    """WITH b AS (SELECT l_suppkey, l_extendedprice AS y0, l_extendedprice + l_quantity * 20 AS y1 FROM lineitem),
       g AS (SELECT l_suppkey, y0, max(y1) OVER (PARTITION BY l_suppkey ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
       SELECT l_suppkey, before AS gap_start, y0 AS gap_end FROM g WHERE y0 - before >= 45""",
)
def running_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("y0"), (F.col("l_extendedprice") + F.col("l_quantity") * 20).alias("y1"))
    return S.running_gaps(rows, ["l_suppkey"], "y0", "y1", 45)


@query(
    "lead_slice",
    """WITH t AS (SELECT doc_id, text, unnest(list_filter(range(0, CAST(length(text) AS BIGINT)), lambda i: substr(text, i + 1, 1) = chr(10))) AS pos FROM documents)
       SELECT doc_id, pos, md5(substr(text, pos + 1, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) - pos)) AS digest FROM t""",
)
def lead_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_slices(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", F.md5("slice").alias("digest"))


@query("topn_longest_per_group", "SELECT source, doc_id, CAST(rank AS INT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) t WHERE rank <= 12")
def topn_longest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.longest(load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], F.col("n_chars"), "doc_id").select("source", "doc_id", "rank")


@query(
    "run_length_groups",
    """WITH f AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS c FROM conversations),
       r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f) SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS n FROM r GROUP BY conv_id, run""",
)
def run_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.runs(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return rows.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n"))


@query(
    "next_anchor_region",
    """SELECT conv_id, turn, (SELECT min(n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND n.role = 'user') AS bottom FROM conversations c""",
)
def next_anchor_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.next_matching(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "turn", F.col("role") == "user", "bottom").select("conv_id", "turn", "bottom")


@query(
    "label_span_marks",
    """WITH f AS (SELECT conv_id, turn, role, lag(role) OVER w AS pv, lead(role) OVER w AS nx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id, string_agg(CASE WHEN role IS DISTINCT FROM pv THEN '[' || role || ':START]' ELSE '' END || CAST(turn AS VARCHAR) || CASE WHEN role IS DISTINCT FROM nx THEN '[' || role || ':END]' ELSE '' END, chr(10) ORDER BY turn) AS text FROM f GROUP BY conv_id""",
)
def label_span_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("turn").cast("string").alias("t"))
    return S.label_marks(rows, ["conv_id"], "turn", "role", "t")


@query("row_number_ids", "SELECT doc_id, source, concat('p', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS pid FROM documents")
def row_number_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(load(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", "n")
    return rows.select("doc_id", "source", F.concat(F.lit("p"), "n").alias("pid"))


sql("ordinal_relabel", "SELECT conv_id, turn, element_at(array('A', 'B', 'C', 'D', 'E'), CAST(least(rn, 5) AS INT)) AS label FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {conversations}) t", "SELECT conv_id, turn, ['A', 'B', 'C', 'D', 'E'][least(rn, 5)] AS label FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) t")
sql("lag_separator", "SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN '' WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN ' ' WHEN length(text) > 200 THEN '\\n\\n' ELSE '\\n' END AS sep FROM {conversations}", "SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN '' WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN ' ' WHEN length(text) > 200 THEN chr(10) || chr(10) ELSE chr(10) END AS sep FROM conversations")
sql(
    "longest_wins_merge",
    """SELECT conv_id, role, max_by(turn, struct(length(text), -turn)) AS turn, max(length(text)) AS chars FROM {conversations} GROUP BY conv_id, role""",
    """SELECT conv_id, role, arg_max(turn, (length(text), -turn)) AS turn, CAST(max(length(text)) AS INT) AS chars FROM conversations GROUP BY conv_id, role""",
)
