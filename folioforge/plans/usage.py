"""Usage dashboard and catalog aggregates: totals, groups, rollups, shares, top-k."""

from __future__ import annotations

from . import sql

# events stand for usage rows: event_type is the service, value the cost, user_id the job.
sql(
    "usage_totals",
    """SELECT count(*) AS calls, round(coalesce(sum(value), 0), 2) AS cost, count(DISTINCT user_id) AS jobs,
              coalesce(sum(length(props)), 0) AS prop_chars FROM {events}""",
    """SELECT count(*) AS calls, round(coalesce(sum(value), 0), 2) AS cost, count(DISTINCT user_id) AS jobs,
              CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS prop_chars FROM events""",
)
sql("usage_totals_empty", "SELECT count(*) AS calls, coalesce(sum(value), 0.0) AS cost FROM {events} WHERE event_type = 'no such service'")
sql("usage_by_service", "SELECT event_type, count(*) AS calls, round(sum(value), 2) AS cost FROM {events} GROUP BY event_type")
sql("usage_by_purpose_service", "SELECT user_id % 7 AS purpose, event_type, count(*) AS calls, round(sum(value), 2) AS cost FROM {events} GROUP BY user_id % 7, event_type")
_day = "date_format(ts, 'yyyy-MM-dd')"
sql(
    "usage_daily",
    f"SELECT {_day} AS day, count(*) AS calls, round(sum(value), 2) AS cost FROM {{events}} GROUP BY {_day}",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 2) AS cost FROM events GROUP BY 1",
)
_bar = "SELECT day, cost, CAST(floor(cost / nullif(max(cost) OVER (), 0) * 80) AS INT) AS bar FROM ({}) d"
sql(
    "usage_daily_bar",
    _bar.format(f"SELECT {_day} AS day, round(sum(value), 2) AS cost FROM {{events}} GROUP BY {_day}"),
    _bar.format("SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS cost FROM events GROUP BY 1"),
)
sql("usage_recent_20", "SELECT event_id, event_type, value FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 20")
sql(
    "usage_last_30d",
    "SELECT event_type, count(*) AS calls FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL 30 DAYS GROUP BY event_type",
    "SELECT event_type, count(*) AS calls FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS GROUP BY event_type",
)
sql("usage_top_jobs", "SELECT user_id, count(*) AS calls FROM {events} GROUP BY user_id ORDER BY calls DESC, user_id LIMIT 25")
sql(
    "category_counts_with_zero",
    "SELECT n.n_name, count(c.c_custkey) AS customers FROM {nation} n LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9500 GROUP BY n.n_name",
)
sql(
    "grand_totals_rollup",
    """SELECT coalesce(r_name, 'ALL') AS region, coalesce(c_mktsegment, 'ALL') AS segment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
       FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)""",
)
sql("source_lang_cube", "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM {documents} GROUP BY CUBE (source, lang)", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (source, lang)")
sql("cost_rollup", "SELECT event_type, round(sum(length(props)) * 3 / 1e6 + sum(user_id) * 15 / 1e6, 4) AS usd FROM {events} GROUP BY event_type", "SELECT event_type, round(CAST(sum(length(props)) AS DOUBLE) * 3 / 1e6 + CAST(sum(user_id) AS DOUBLE) * 15 / 1e6, 4) AS usd FROM events GROUP BY event_type")
sql(
    "model_price_lookup",
    """SELECT e.event_type, round(sum(coalesce(p.price, 0) * e.value) / 1e6, 6) AS usd
       FROM {events} e LEFT JOIN (VALUES ('view', 3.0D), ('click', 15.0D), ('purchase', 0.8D)) AS p(model, price) ON e.event_type = p.model GROUP BY e.event_type""",
    """SELECT e.event_type, round(sum(coalesce(p.price, 0) * e.value) / 1e6, 6) AS usd
       FROM events e LEFT JOIN (VALUES ('view', 3.0::DOUBLE), ('click', 15.0::DOUBLE), ('purchase', 0.8::DOUBLE)) AS p(model, price) ON e.event_type = p.model GROUP BY e.event_type""",
)
sql("children_per_parent", "SELECT o.o_orderkey, count(l.l_orderkey) AS lines FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
sql(
    "accuracy_by_paper",
    """SELECT l_orderkey, count(*) AS total, count_if(l_discount = 0) AS zero, CAST(floor((count(*) - count_if(l_discount = 0)) * 1000 / count(*)) AS BIGINT) AS per_mille FROM {lineitem} GROUP BY l_orderkey""",
    """SELECT l_orderkey, count(*) AS total, CAST(count_if(l_discount = 0) AS BIGINT) AS zero, CAST(floor((count(*) - count_if(l_discount = 0)) * 1000.0 / count(*)) AS BIGINT) AS per_mille FROM lineitem GROUP BY l_orderkey""",
)
sql(
    "paper_counts_joined",
    """SELECT q.l_orderkey, q.questions, coalesce(p.parts, 0) AS parts FROM (SELECT l_orderkey, count(*) AS questions FROM {lineitem} GROUP BY l_orderkey) q
       LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM {lineitem} WHERE l_quantity > 40 GROUP BY l_orderkey) p ON p.l_orderkey = q.l_orderkey""",
)
sql("distinct_filter_values", "SELECT DISTINCT year(o_orderdate) AS y, o_orderpriority FROM {orders} WHERE o_orderpriority IS NOT NULL", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
sql("next_number", "SELECT max(o_orderkey) + 1 AS next_number FROM {orders}")
sql("duplicate_text_frequency", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM {documents} GROUP BY md5(text) HAVING count(*) > 1")
sql(
    "bucket_histogram",
    """SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 8 THEN '3-8' ELSE '9+' END AS bucket, count(*) AS papers
       FROM (SELECT o.o_orderkey, count(l.l_orderkey) AS n FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 10 GROUP BY o.o_orderkey) c
       GROUP BY CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 8 THEN '3-8' ELSE '9+' END""",
)
sql(
    "low_percentile_baseline",
    """SELECT l_suppkey, min(l_quantity) AS low FROM (SELECT l_suppkey, l_quantity, sum(c) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS upto, sum(c) OVER (PARTITION BY l_suppkey) AS n
       FROM (SELECT l_suppkey, l_quantity, count(*) AS c FROM {lineitem} GROUP BY l_suppkey, l_quantity) q) r WHERE upto >= n div 10 + 1 GROUP BY l_suppkey""",
    "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 10 + 1] AS low FROM lineitem GROUP BY l_suppkey",
)
sql(
    "average_positive_gap",
    """SELECT user_id, coalesce(round(avg(CASE WHEN gap > 0 AND gap < 5000 THEN gap END), 3), 10.0) AS avg_gap
       FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM {events}) g GROUP BY user_id""",
)
sql("share_of_rows_flag", "SELECT l_orderkey, count(*) >= 3 AND avg(CASE WHEN l_quantity < 0.8 * mx THEN 1.0D ELSE 0.0D END) > 0.55 AS poem FROM (SELECT l_orderkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS mx FROM {lineitem}) t GROUP BY l_orderkey", "SELECT l_orderkey, count(*) >= 3 AND avg(CASE WHEN l_quantity < 0.8 * mx THEN 1.0 ELSE 0.0 END) > 0.55 AS poem FROM (SELECT l_orderkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS mx FROM lineitem) t GROUP BY l_orderkey")
sql("judgment_counts", "SELECT count_if(toxic = 1) AS odam, count_if(toxic = 0) AS real_error, count_if(quality = 1) AS pending, count_if(toxic = 1 AND quality = 1) AS both FROM {labels}", "SELECT CAST(count_if(toxic = 1) AS BIGINT) AS odam, CAST(count_if(toxic = 0) AS BIGINT) AS real_error, CAST(count_if(quality = 1) AS BIGINT) AS pending, CAST(count_if(toxic = 1 AND quality = 1) AS BIGINT) AS both FROM labels")
sql("category_judgment_crosstab", "SELECT d.source, count_if(l.toxic = 1) AS toxic, count_if(l.toxic = 0) AS clean, count(*) AS n FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.source", "SELECT d.source, CAST(count_if(l.toxic = 1) AS BIGINT) AS toxic, CAST(count_if(l.toxic = 0) AS BIGINT) AS clean, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
sql("success_rate", "SELECT d.lang, round(count(l.doc_id) / greatest(count(*), 1), 3) AS rate FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang")
sql("argmax_first_class", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM {lineitem}) t WHERE rn = 1")
# A hot group's list is joined from the lists of ranges of ids: their order is that of the ids, as a part is an id's beginning.
sql("grouped_lists", """SELECT source, lang, sum(n) AS n, array_join(transform(array_sort(collect_list(struct(part, docs))), x -> x.docs), ',') AS docs
  FROM (SELECT source, lang, substring(id, 1, 5) AS part, count(*) AS n, nullif(array_join(array_sort(collect_list(id)), ','), '') AS docs
        FROM (SELECT source, lang, lpad(cast(doc_id AS string), 9, '0') AS id FROM {documents}) d GROUP BY source, lang, substring(id, 1, 5)) p GROUP BY source, lang""", "SELECT source, lang, count(*) AS n, string_agg(lpad(cast(doc_id AS varchar), 9, '0'), ',' ORDER BY lpad(cast(doc_id AS varchar), 9, '0')) AS docs FROM documents GROUP BY source, lang")
sql("issue_counts_pivot", "SELECT * FROM (SELECT user_id % 10 AS file, event_type, event_id FROM {events}) PIVOT (count(event_id) FOR event_type IN ('view' AS n_view, 'click' AS n_click, 'error' AS n_error))", "SELECT user_id % 10 AS file, CAST(nullif(count_if(event_type = 'view'), 0) AS BIGINT) AS n_view, CAST(nullif(count_if(event_type = 'click'), 0) AS BIGINT) AS n_click, CAST(nullif(count_if(event_type = 'error'), 0) AS BIGINT) AS n_error FROM events GROUP BY 1")
