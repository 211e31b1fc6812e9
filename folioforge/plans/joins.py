"""Lookup, range, as-of, interval, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..operators import joins as J
from ..session import load
from . import sql

sql(
    "answer_update_join",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(nullif(k.answer, ''), l.l_returnflag) AS answer FROM {lineitem} l
       LEFT JOIN (SELECT p_partkey, CASE WHEN p_size < 10 THEN '' ELSE p_brand END AS answer FROM {part}) k ON k.p_partkey = l.l_partkey""",
)
sql(
    "multi_lookup_enrich",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(nullif(p.p_size, 0), -1) AS size, coalesce(s.s_name, '') AS supplier, o.o_orderstatus
       FROM {lineitem} l LEFT JOIN {part} p ON p.p_partkey = l.l_partkey LEFT JOIN {supplier} s ON s.s_suppkey = l.l_suppkey LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
)
sql("lookup_match_count", "SELECT o.o_orderpriority, count(*) AS n, count_if(l.l_orderkey IS NOT NULL) AS matched FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 3 GROUP BY o.o_orderpriority", "SELECT o.o_orderpriority, count(*) AS n, CAST(count_if(l.l_orderkey IS NOT NULL) AS BIGINT) AS matched FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 3 GROUP BY o.o_orderpriority")

_RANGES = "SELECT conv_id, turn AS s, turn + 2 AS e, turn AS idx FROM {conversations} WHERE role = 'user'"


@query(
    "range_join_first",
    f"""SELECT q.conv_id, q.turn, min(p.idx) AS passage_idx FROM conversations q LEFT JOIN ({_RANGES.replace('{', '').replace('}', '')}) p
        ON p.conv_id = q.conv_id AND q.turn BETWEEN p.s AND p.e GROUP BY q.conv_id, q.turn""",
)
def range_join_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    ranges = c.where("role = 'user'").select("conv_id", F.col("turn").alias("s"), (F.col("turn") + 2).alias("e"), F.col("turn").alias("idx"))
    return J.range_first(c.select("conv_id", "turn").distinct(), ranges, ["conv_id"], "turn", "s", "e", "idx", "passage_idx")


@query(
    "asof_section",
    """SELECT q.conv_id, q.turn, coalesce(arg_max(s.role, s.turn), 'common') AS section FROM conversations q
       LEFT JOIN (SELECT * FROM conversations WHERE role <> 'user') s ON s.conv_id = q.conv_id AND s.turn <= q.turn WHERE q.role = 'user' GROUP BY q.conv_id, q.turn""",
)
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    rows = c.where("role = 'user'").select("conv_id", "turn")
    return J.as_of(rows, c.where("role <> 'user'").select("conv_id", "turn", "role"), ["conv_id"], "turn", "turn", "role", "section", "common")


@query(
    "asof_page",
    """SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.event_id <= e.event_id) AS page FROM events e WHERE e.event_type = 'error'""",
)
def asof_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    pages = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("start"))
    out = J.as_of(e.where("event_type = 'error'").select("user_id", "event_id"), pages, ["user_id"], "event_id", "event_id", "start", "page", None)
    return out.select("event_id", "page")


@query(
    "interval_overlap_anti",
    """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey FROM lineitem a WHERE a.l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem z WHERE z.l_orderkey = a.l_orderkey AND z.l_returnflag = 'R'
       AND a.l_shipdate < z.l_shipdate + INTERVAL 30 DAY AND z.l_shipdate < a.l_shipdate + INTERVAL 30 DAY)""",
)
def interval_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").withColumn("end", F.expr("l_shipdate + INTERVAL 30 DAYS"))
    out = J.overlap_anti(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), ["l_orderkey"], ("l_shipdate", "end"), ("l_shipdate", "end"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


sql("ghost_semi", "SELECT doc_id, source FROM {documents} WHERE doc_id IN (SELECT doc_id FROM {labels})")
sql("already_judged_anti", "SELECT doc_id, source FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
sql("composite_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} l WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus)")
sql(
    "reviewer_disagreement",
    """SELECT d.doc_id, a.quality, b.toxic, coalesce(a.quality = b.toxic, false) AS disagree FROM {documents} d LEFT JOIN (SELECT doc_id, quality FROM {labels} WHERE quality IS NOT NULL) a ON a.doc_id = d.doc_id
       LEFT JOIN (SELECT doc_id, toxic FROM {labels} WHERE toxic IS NOT NULL) b ON b.doc_id = d.doc_id""",
)
sql(
    "propagate_judgments",
    """SELECT d.doc_id, coalesce(h.quality, CASE WHEN a.toxic = 1 THEN 9 END) AS judgment FROM {documents} d
       LEFT JOIN (SELECT doc_id, quality FROM {labels} WHERE quality = 1) h ON h.doc_id = d.doc_id LEFT JOIN {labels} a ON a.doc_id = d.doc_id""",
)
sql("theta_duplicate_check", "SELECT p.p_partkey, EXISTS (SELECT 1 FROM {nation} n WHERE n.n_nationkey = p.p_size AND contains(p.p_type, substring(n.n_name, 1, 1))) AS is_duplicate FROM {part} p", "SELECT p.p_partkey, EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = p.p_size AND contains(p.p_type, substring(n.n_name, 1, 1))) AS is_duplicate FROM part p")
# a name that pages link to is unused if no page's host has it: both sides are distinct names, so the join is on equality
_LINKED = r"SELECT DISTINCT lower({0}(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1))) AS word FROM {1}"
_HOSTS = "SELECT DISTINCT regexp_extract(url, '^https?://([a-z]+)', 1) AS word FROM {0}"
sql(
    "unused_images_anti",
    f"SELECT w.word FROM ({_LINKED.format('explode', '{pages}')}) w LEFT ANTI JOIN ({_HOSTS.format('{pages}')}) h ON h.word = w.word".replace("lower(explode(", "explode(transform(").replace(", 1))) AS word", ", 1), x -> lower(x))) AS word"),
    f"SELECT word FROM ({_LINKED.format('unnest', 'pages')}) w WHERE word NOT IN ({_HOSTS.format('pages')})",
)


@query("text_membership", "SELECT d.doc_id, count(*) AS items FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def text_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return J.containing(docs, items, "doc_id", "text", "item_id", "item").groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))


sql(
    "positional_lookup",
    """SELECT conv_id, roles[CAST(least(size(roles) - 1, 1) AS INT)] AS second_role, array_contains(roles, 'system') AS any_system
       FROM (SELECT conv_id, transform(array_sort(collect_list(struct(turn, role))), x -> x.role) AS roles FROM {conversations} GROUP BY conv_id) t""",
    """SELECT conv_id, roles[least(len(roles) - 1, 1) + 1] AS second_role, list_contains(roles, 'system') AS any_system FROM (SELECT conv_id, list(role ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id) t""",
)
sql(
    "adjacency_merge",
    """SELECT conv_id, grp, count(*) AS parts, sum(length(text)) AS chars FROM
       (SELECT conv_id, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM {conversations}) t GROUP BY conv_id, grp""",
    """SELECT conv_id, CAST(grp AS BIGINT) AS grp, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS chars FROM
       (SELECT conv_id, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM conversations) t GROUP BY conv_id, grp""",
)
