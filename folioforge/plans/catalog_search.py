"""Listing, searching, filtering and paging of a catalog, and set operations on its keys."""

from __future__ import annotations

from . import sql

sql("question_search_or", "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%#12%' OR p_type ILIKE '%econ%'")
sql("question_ilike", "SELECT doc_id, source FROM {documents} WHERE text ILIKE '%THE_ING%'")
sql("prefix_lookup", "SELECT p_partkey, p_name FROM {part} WHERE startswith(p_name, 'red') AND p_size = 11 ORDER BY p_partkey LIMIT 5", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') AND p_size = 11 ORDER BY p_partkey LIMIT 5")
sql("contains_not_contains", "SELECT doc_id FROM {documents} WHERE contains(text, 'que') AND NOT (contains(text, 'Copyright') OR contains(text, '@') OR contains(text, 'ment'))")
sql("optional_filters", "SELECT doc_id, lang, source, n_chars FROM {documents} WHERE ('' = '' OR lang = '') AND ('src3' = '' OR source = 'src3') AND n_chars BETWEEN 100 AND 5000")
sql("not_null_filter", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic IS NULL AND d.text IS NOT NULL")
sql("in_list", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey IN (1, 5, 7, 11, 13, 999999)")
sql("first_match", "SELECT doc_id, source FROM {documents} WHERE source = 'src7' ORDER BY doc_id LIMIT 1")
sql("number_range_guard", "SELECT l_linenumber, CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN 'common' WHEN l_linenumber BETWEEN 4 AND 7 THEN 'selective' END AS track, count(*) AS n FROM {lineitem} WHERE l_linenumber BETWEEN 1 AND 45 GROUP BY l_linenumber")
sql(
    "paged_list_nulls_last",
    """SELECT o_orderkey, o_orderdate, pr FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, nullif(o_orderpriority, '5-LOW') AS pr FROM {orders}) t
       ORDER BY pr DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
sql("page_count", "SELECT o_orderstatus, count(*) AS total, CAST(floor((count(*) - 1) / 20) + 1 AS BIGINT) AS pages FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS total, CAST((count(*) - 1) // 20 + 1 AS BIGINT) AS pages FROM orders GROUP BY o_orderstatus")
sql("page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'F') AS total FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("newest_first", "SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
sql("count_desc_sort", "SELECT source, count(*) AS n FROM {documents} GROUP BY source ORDER BY n DESC, source")
sql("nearest_element", "SELECT target, min_by(p_partkey, struct(abs(p_retailprice - target), p_partkey)) AS part FROM {part} CROSS JOIN (VALUES (905.5D), (950.0D), (1200.0D)) AS t(target) GROUP BY target", "SELECT target, arg_min(p_partkey, (abs(p_retailprice - target), p_partkey)) AS part FROM part CROSS JOIN (VALUES (905.5::DOUBLE), (950.0::DOUBLE), (1200.0::DOUBLE)) AS t(target) GROUP BY target")
sql("reading_order", "SELECT l_orderkey, array_join(transform(array_sort(collect_list(struct(CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END AS side, l_extendedprice AS y, l_partkey AS k))), x -> cast(x.k AS string)), ' ') AS ordered FROM {lineitem} GROUP BY l_orderkey", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END, l_extendedprice, l_partkey) AS ordered FROM lineitem GROUP BY l_orderkey")
sql("ordered_children", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), '>') AS roles FROM {conversations} GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")

sql("key_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
sql("key_difference", "SELECT l_orderkey AS k FROM {lineitem} WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey AS k FROM {lineitem} WHERE l_returnflag = 'A'")
sql("key_intersection", "SELECT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'A'")
sql("ordered_dedupe", "SELECT doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {documents}) t WHERE rn = 1")
sql("concat_parts", "SELECT conv_id, turn, 'common' AS part FROM {conversations} WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'track' AS part FROM {conversations} WHERE role = 'assistant'")
sql("split_two_tracks", "SELECT conv_id, track, count(*) AS n FROM (SELECT conv_id, explode(CASE WHEN role = 'system' THEN array('a', 'b') WHEN turn < 2 THEN array('a') ELSE array('b') END) AS track FROM {conversations}) t GROUP BY conv_id, track", "SELECT conv_id, track, count(*) AS n FROM (SELECT conv_id, unnest(CASE WHEN role = 'system' THEN ['a', 'b'] WHEN turn < 2 THEN ['a'] ELSE ['b'] END) AS track FROM conversations) t GROUP BY conv_id, track")
sql("empty_to_null_cast", "SELECT l_orderkey, l_linenumber, l_partkey, nullif(trim(CASE WHEN l_tax = 0 THEN ' ' ELSE l_returnflag END), '') AS flag, try_cast(CASE WHEN l_tax = 0 THEN 'x1' ELSE cast(l_linenumber AS string) END AS int) AS number FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey, nullif(trim(CASE WHEN l_tax = 0 THEN ' ' ELSE l_returnflag END), '') AS flag, try_cast(CASE WHEN l_tax = 0 THEN 'x1' ELSE cast(l_linenumber AS varchar) END AS int) AS number FROM lineitem")
