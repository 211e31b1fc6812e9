"""Page layouts (boxes made of lineitem numbers, order: page), papers made of conversations' turns as pages, question keys made of
lineitem rows, and writes by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..operators import anchors as A, correct as V, geometry as G, investigate as I, job as J, segment as S, similarity as M
from ..session import load
from ..sources import layout as L, tables as T
from . import sql
from .geometry_queries import _B, _PAGE, _boxes


_U = _B.rstrip() + ", u AS (SELECT doc_id, page_no, box_no, min(x0) AS x0, min(x1) AS x1, min(y0) AS y0, min(y1) AS y1, min(kind) AS kind FROM b GROUP BY doc_id, page_no, box_no) "


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes, one for each number."""
    return _boxes(spark, sf_dir).groupBy("doc_id", "page_no", "box_no").agg(*(F.min(c).alias(c) for c in ("x0", "x1", "y0", "y1", "kind")))


@query("enclosing_box_bottom", _B + f"""SELECT w.page_no, w.box_no, arg_min(r.y1 + 20, r.box_no) AS bottom FROM b w LEFT JOIN b r ON {_PAGE} AND r.kind <> 'N'
  AND r.x0 <= w.x0 + 30 AND r.x1 >= w.x1 - 30 AND r.y0 <= w.y0 + 60 AND r.y1 + 20 >= w.y1 - 20 WHERE w.kind = 'N' GROUP BY w.page_no, w.box_no, w.x0, w.y0""")
def enclosing_box_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return G.enclosing_bottom(b.where("kind = 'N'"), b.where("kind <> 'N'").withColumn("y1", F.col("y1") + 20)).select("page_no", "box_no", "bottom")


@query("border_lines_anti", _U + f"""SELECT page_no, box_no FROM u w WHERE kind = 'N' AND NOT (
  EXISTS (SELECT 1 FROM u r WHERE {_PAGE} AND r.kind <> 'N' AND abs(w.x0 - r.x0) <= 80 AND w.y0 BETWEEN r.y0 - 80 AND r.y1 + 80)
  AND EXISTS (SELECT 1 FROM u r WHERE {_PAGE} AND r.kind <> 'N' AND abs(w.x1 - r.x0) <= 80 AND w.y0 BETWEEN r.y0 - 80 AND r.y1 + 80))""")
def border_lines_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _once(spark, sf_dir).withColumn("line_id", F.col("box_no"))
    return G.not_borders(b.where("kind = 'N'"), b.where("kind <> 'N'"), 80).select("page_no", "box_no")


@query("bracket_ranges", _B + f"""SELECT a.page_no, a.box_no, coalesce(arg_min(r.y0, (abs(a.x0 - r.x0), r.y0, r.y1)) FILTER (r.kind = 'R'), arg_min(r.y0, (least(abs(a.x0 - r.x0), abs(a.x0 - r.x1)), r.y0, r.y1)) FILTER (r.kind = 'A' AND least(abs(a.x0 - r.x0), abs(a.x0 - r.x1)) <= 40), a.ly - 80) AS top,
  coalesce(arg_min(r.y1, (abs(a.x0 - r.x0), r.y0, r.y1)) FILTER (r.kind = 'R'), arg_min(r.y1, (least(abs(a.x0 - r.x0), abs(a.x0 - r.x1)), r.y0, r.y1)) FILTER (r.kind = 'A' AND least(abs(a.x0 - r.x0), abs(a.x0 - r.x1)) <= 40), a.ly + 80) AS bottom
  FROM (SELECT *, (y0 + y1) / 2 AS ly FROM b WHERE kind = 'N') a LEFT JOIN b r ON r.doc_id = a.doc_id AND r.page_no = a.page_no AND r.kind <> 'N' AND a.ly BETWEEN r.y0 - 10 AND r.y1 + 10 GROUP BY a.page_no, a.box_no, a.x0, a.y0, a.ly""")
def bracket_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return G.bracket_ranges(b.where("kind = 'N'"), b.where("kind = 'R'"), b.where("kind = 'A'"), 1000.0).select("page_no", "box_no", "top", "bottom")


@query("clip_text", _B + f"""SELECT r.page_no, r.box_no AS rect_no, string_agg(CAST(w.box_no AS VARCHAR), ' ' ORDER BY w.box_no) AS text FROM b w JOIN b r ON {_PAGE} AND r.kind = 'A'
  AND (w.x0 + w.x1) / 2 BETWEEN r.x0 - 200 AND r.x1 + 200 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 - 200 AND r.y1 + 200 WHERE w.kind <> 'A' GROUP BY r.doc_id, r.page_no, r.box_no""")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    words = b.where("kind <> 'A'").selectExpr("*", "0 AS block_no", "0 AS line_no", "box_no AS word_no", "cast(box_no as string) AS text")
    rects = b.where("kind = 'A'").selectExpr("doc_id", "page_no", "box_no AS rect_no", "x0 - 200 AS x0", "x1 + 200 AS x1", "y0 - 200 AS y0", "y1 + 200 AS y1")
    return G.clip_text(words, rects).select("page_no", "rect_no", "text")


@query("underline_manifest", """WITH b AS (SELECT l_orderkey % 500 AS doc_id, CAST(l_orderkey AS INT) AS page_no, CAST(l_linenumber AS INT) * 100000 + l_partkey AS n, CAST(l_quantity AS DOUBLE) * 4 AS x0, CAST(l_partkey % 60 AS DOUBLE) AS y0, l_returnflag AS kind, CAST(l_discount AS DOUBLE) * 20 AS w FROM lineitem)
  SELECT DISTINCT doc_id, page_no, phrase FROM (SELECT r.doc_id, r.page_no, string_agg('w' || a.n, ' ' ORDER BY a.n) AS phrase FROM b a JOIN (SELECT DISTINCT doc_id, page_no, n, x0, y0, w FROM b WHERE kind <> 'N' AND w < 1) r ON r.doc_id = a.doc_id AND r.page_no = a.page_no
    AND a.x0 + 10 BETWEEN r.x0 AND r.x0 + 120 AND a.y0 + 5 BETWEEN r.y0 - 14 AND r.y0 + 2 WHERE a.kind = 'N' GROUP BY r.doc_id, r.page_no, r.n)""")
def underline_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words and, of another flag, as level lines of a page."""
    b = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 500 AS doc_id", "cast(l_orderkey as int) AS page_no", "cast(l_linenumber as int) * 100000 + l_partkey AS n", "cast(l_quantity as double) * 4 AS x0", "cast(l_partkey % 60 as double) AS y0",
        "l_returnflag AS flag", "cast(l_discount as double) * 20 AS line_width",
    )
    words = b.where("flag = 'N'").selectExpr("*", "x0 + 20 AS x1", "y0 + 10 AS y1", "concat('w', n) AS text", "0 AS block_no", "0 AS line_no", "n AS word_no")
    lines = b.where("flag <> 'N'").selectExpr("doc_id", "page_no", "n AS rect_no", "x0", "x0 + 120 AS x1", "y0", "y0 AS y1", "'line' AS kind", "line_width").distinct()
    return L.underline_manifest(words, lines)


_WORDS = """WITH u AS (SELECT DISTINCT l_orderkey % 500 AS doc_id, CAST(l_orderkey AS INT) AS page_no, CAST(l_linenumber AS INT) * 100000 + l_partkey AS n, CAST(min(l_quantity) AS DOUBLE) * 10 AS x0, CAST(l_partkey % 800 AS DOUBLE) AS y0, 'w' || l_partkey % 5 AS t FROM lineitem GROUP BY 1, 2, 3, 5, 6),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n) AS i FROM u), g AS (SELECT doc_id, page_no, ' ' || string_agg(t, ' ' ORDER BY n) || ' ' AS body FROM k GROUP BY ALL)"""


@query("anchor_regions", _WORDS + """, e AS (SELECT doc_id, page_no, n AS elem_no, CASE n % 3 WHEN 0 THEN 'visual' WHEN 1 THEN 'passage' ELSE 'question' END AS type, t || ' w' || n % 5 || ' w' || n % 4 || ' w1' AS anchor FROM k),
  f AS (SELECT e.*, coalesce(nullif(position(' ' || anchor || ' ' IN body), 0), nullif(position(' ' || array_to_string(string_split(anchor, ' ')[:3], ' ') || ' ' IN body), 0), nullif(position(' ' || array_to_string(string_split(anchor, ' ')[:2], ' ') || ' ' IN body), 0), position(' ' || string_split(anchor, ' ')[1] || ' ' IN body)) AS p, body FROM e JOIN g USING (doc_id, page_no)),
  a AS (SELECT f.doc_id, f.page_no, elem_no, type, k.x0, k.y0, CASE WHEN k.x0 < 260 THEN 'left' ELSE 'right' END AS side FROM f JOIN k ON k.doc_id = f.doc_id AND k.page_no = f.page_no AND k.i = length(left(body, p)) - length(replace(left(body, p), ' ', ''))),
  b AS (SELECT *, (SELECT arg_min(z.y0, (z.y0, z.elem_no)) FROM a z WHERE z.doc_id = a.doc_id AND z.page_no = a.page_no AND z.side = a.side AND z.type <> 'visual' AND (z.y0, z.elem_no) > (a.y0, a.elem_no)) AS nxt FROM a)
  SELECT doc_id, page_no, elem_no, CASE side WHEN 'left' THEN 30.0 ELSE 265.0 END::DOUBLE AS x0, CASE type WHEN 'visual' THEN y0 - 5 ELSE y0 END AS y0, CASE type WHEN 'visual' THEN y0 + 150 ELSE greatest(y0 + 1, coalesce(nxt - 5, 780)) END AS y1,
    CAST(trunc(CASE side WHEN 'left' THEN 255.0 ELSE 490.0 END * 1040 / 520) AS INT) AS px1 FROM b""")
def anchor_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words of a page; each word is also the beginning of an element, with three made words behind it."""
    lines = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_orderkey").cast("int").alias("page_no"), (F.col("l_linenumber").cast("int") * 100000 + F.col("l_partkey")).alias("n"), (F.col("l_partkey") % 800).cast("double").alias("y0"), F.concat(F.lit("w"), F.col("l_partkey") % 5).alias("text"), "l_quantity")
    u = lines.repartition("doc_id", "page_no").groupBy("doc_id", "page_no", "n", "y0", "text").agg((F.min("l_quantity").cast("double") * 10).alias("x0"))
    kind = F.when(F.col("n") % 3 == 0, "visual").when(F.col("n") % 3 == 1, "passage").otherwise("question")
    elements = u.select("doc_id", "page_no", F.col("n").alias("elem_no"), kind.alias("type"), F.concat("text", F.lit(" w"), F.col("n") % 5, F.lit(" w"), F.col("n") % 4, F.lit(" w1")).alias("anchor"))
    pages = u.select("doc_id", "page_no").distinct().selectExpr("*", "520D AS page_w", "830D AS page_h", "1040 AS image_w", "1660 AS image_h")
    return A.anchor_regions(u, elements, pages).select("doc_id", "page_no", "elem_no", "x0", "y0", "y1", "px1")


@query("page_reading_text", _U.rstrip() + """, k AS (SELECT doc_id, page_no, box_no, y0, y1, CASE WHEN x0 < 260 THEN 0 ELSE 1 END AS side FROM u WHERE y0 >= 41.5 AND y1 <= 747),
  g AS (SELECT *, lag(y1) OVER w AS py, lag(side) OVER w AS ps FROM k WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY side, y0, box_no))
  SELECT page_no, string_agg(CASE WHEN ps IS NULL THEN '' WHEN y0 - py > 18 OR ps <> side THEN chr(10) || chr(10) ELSE chr(10) END || CAST(box_no AS VARCHAR), '' ORDER BY side, y0, box_no) AS text FROM g GROUP BY doc_id, page_no""")
def page_reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _once(spark, sf_dir).selectExpr("doc_id", "page_no", "box_no AS block_no", "0 AS kind", "x0", "y0", "x1", "y1", "cast(box_no as string) AS text", "520.0D AS page_w", "830.0D AS page_h")
    return G.page_text(b).select("page_no", "text")


_PAPER = "CASE WHEN role = 'system' THEN '화법과  작문' WHEN role = 'assistant' THEN '언어와 매체' ELSE text END"


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "cast(turn as int) AS page_no", f"{_PAPER} AS text")


@query("section_pages", """SELECT conv_id AS doc_id, CASE role WHEN 'system' THEN 'hwajak' WHEN 'assistant' THEN 'eonmae' ELSE 'common' END AS section, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages FROM conversations GROUP BY 1, 2""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_classes(_papers(spark, sf_dir)).select("doc_id", "section", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("combined_exams", "SELECT conv_id AS doc_id FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND bool_or(role = 'system') AND bool_or(role = 'assistant')")
def combined_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined_exams(_papers(spark, sf_dir), 3)


@query("page_text_join", "SELECT conv_id AS doc_id, md5(string_agg('--- 페이지 ' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY turn, text)) AS digest, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def page_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "cast(turn as int) AS page_no", "text")
    return L.document_text(pages).select("doc_id", F.md5("text").alias("digest"), "n_pages")


sql("parents_with_child", "SELECT count(*) AS n, count_if(EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')) AS n_any FROM {orders} o", "SELECT count(*) AS n, CAST(count_if(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS BIGINT) AS n_any FROM orders")


@query("latest_report_per_file", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_report_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return T.latest_reports(e, "user_id", "at").select("user_id", "event_type", "value")


@query("prefer_answered", """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS number, l_partkey AS pos, l_partkey % 5 + 1 AS correct_answer, l_linenumber % 5 + 1 AS answer FROM lineitem)
  SELECT doc_id, number, coalesce(min(CASE WHEN correct_answer = answer THEN pos END), max(pos)) AS pos FROM r GROUP BY doc_id, number""")
def prefer_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    rows = li.selectExpr("l_orderkey AS doc_id", "l_linenumber AS number", "l_partkey AS pos", "l_partkey % 5 + 1 AS correct_answer")
    return S.prefer_answered(rows, rows.select("doc_id", "number", (F.col("number") % 5 + 1).alias("answer")).distinct()).select("doc_id", "number", "pos")


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: every line is a long question of the text, those of a large quantity have choices, those of a low discount are
    stored, those of a high tax reported."""
    li = load(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey")).withColumn("number", F.col("l_linenumber").cast("int"))
    line = lambda x: F.concat(x["number"].cast("string"), F.lit(". "), F.repeat(x["l_returnflag"], 600), F.when(x["l_quantity"] > 25, "\n① a ② b").otherwise(""))
    # long texts are made behind the shuffle: few bytes are much work there, so its partitions must not be put together
    dealt = li.select("doc_id", "number", "l_returnflag", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    pages = dealt.groupBy("doc_id").agg(F.collect_list(F.struct("number", "l_returnflag", "l_quantity")).alias("lines"))
    pages = pages.select("doc_id", F.array_join(F.sort_array(F.transform("lines", line)), "\n").alias("text"))
    key = ["doc_id", "number"]
    return I.missing_questions(pages, li.where("l_discount < 0.05").select(*key).distinct(), li.where("l_tax > 0.06").select(*key).distinct())


_MISSING = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS number, bool_or(l_tax > 0.06) AS reported, NOT arg_min(l_quantity > 25, (l_returnflag, l_quantity > 25)) AS bare FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_discount < 0.05)"""


@query("missing_investigation", f"SELECT doc_id, number, true AS in_text, reported, concat_ws(',', CASE WHEN bare THEN 'C: no choices' END, CASE WHEN reported THEN 'D: reported although in the text' END) AS causes FROM ({_MISSING}) m")
def missing_investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir).select("doc_id", "number", "in_text", "reported", F.array_join("causes", ",").alias("causes"))


@query("cause_histogram", f"SELECT 'C: no choices' AS cause, count(*) AS count FROM ({_MISSING}) m WHERE bare UNION ALL SELECT 'D: reported although in the text', count(*) FROM ({_MISSING}) m WHERE reported")
def cause_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cause_counts(_missing(spark, sf_dir))


@query("question_compare", """WITH c AS (SELECT conv_id AS doc_id, turn AS number, text, turn % 4 = 0 AS bogi, turn % 2 = 0 AS image FROM conversations WHERE length(text) > 0)
  SELECT doc_id, number, field FROM (SELECT doc_id, number, unnest([CASE WHEN number % 5 = 4 THEN 'missing' END, CASE WHEN number % 5 <> 4 AND number % 3 = 1 THEN 'stem' END,
    CASE WHEN number % 5 <> 4 AND bogi THEN 'bogi' END, CASE WHEN number % 5 <> 4 AND image THEN 'image' END, CASE WHEN number % 5 <> 4 AND number % 7 = 6 THEN 'choices' END]) AS field FROM c) t WHERE field IS NOT NULL""")
def question_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").where("length(text) > 0")
    seen = c.selectExpr("conv_id AS doc_id", "turn AS number", "text AS stem", "turn % 4 = 0 AS has_bogi", "5 AS choice_count", "turn % 2 = 0 AS has_image")
    stored = c.where("turn % 5 <> 4").selectExpr("conv_id AS doc_id", "turn AS number", "CASE WHEN turn % 3 = 1 THEN repeat('7#', 400) ELSE text END AS stem", "'' AS bogi", "CASE WHEN turn % 7 = 6 THEN 4 ELSE 5 END AS choice_count", "text AS content")
    return M.compare_questions(seen, stored)


@query("mean_ratio_gate", """SELECT l_orderkey AS doc_id, l_linenumber AS number, round(avg(CASE WHEN l_discount < 0.03 THEN 1.0 ELSE 0.0 END), 6) AS mean FROM lineitem GROUP BY 1, 2 HAVING avg(CASE WHEN l_discount < 0.03 THEN 1.0 ELSE 0.0 END) < 0.35""")
def mean_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS number", "'abc' AS stored", "CASE WHEN l_discount < 0.03 THEN 'abc' ELSE 'xyz' END AS read")
    return M.skip_questions(rows).withColumn("mean", F.round("mean", 6))


@query("first_free_labels", """WITH RECURSIVE l AS (SELECT l_orderkey AS doc_id, l_partkey * 10 + l_linenumber AS pos, l_returnflag AS label, l_discount >= 0.02 AS found, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 10 + l_linenumber, l_returnflag, l_discount >= 0.02) AS k FROM lineitem),
  u AS (SELECT doc_id, CASE WHEN bool_or(label = 'R') THEN ['R'] ELSE CAST([] AS VARCHAR[]) END AS used FROM l GROUP BY doc_id),
  s AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, used, CAST(NULL AS VARCHAR) AS actual FROM u
    UNION ALL SELECT l.doc_id, l.k, CASE WHEN l.found THEN list_append(s.used, g) ELSE s.used END, CASE WHEN l.found THEN g END
    FROM (SELECT s.doc_id, s.k, s.used FROM s) s JOIN l ON l.doc_id = s.doc_id AND l.k = s.k + 1,
    LATERAL (SELECT CASE WHEN NOT list_contains(s.used, l.label) THEN l.label ELSE (SELECT min(chr(CAST(65 + i AS INT))) FROM range(26) t(i) WHERE NOT list_contains(s.used, chr(CAST(65 + i AS INT)))) END AS g) x)
  SELECT doc_id, pos, label, actual FROM s JOIN l USING (doc_id, k)""")
def first_free_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as ranges of their order, one in five of them not found in its text."""
    li = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey * 10 + l_linenumber AS pos", "l_returnflag AS label", "l_discount >= 0.02 AS found")
    used = li.where("label = 'R'").groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    return V.label_ranges(li, used)


@query("delete_by_ids", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS o_orderkey")
    return T.delete_ids(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), gone, "o_orderkey")


@query("cascade_counts", "SELECT 'lines' AS \"table\", l_orderkey AS key, count(*) AS rows FROM lineitem WHERE l_orderkey % 10 = 3 GROUP BY 2 UNION ALL SELECT 'orders', o_orderkey, count(*) FROM orders WHERE o_orderkey % 10 = 3 GROUP BY 2")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": load(spark, sf_dir, "orders").selectExpr("o_orderkey AS key"), "lines": load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key"), "regions": load(spark, sf_dir, "region")}
    ids = tables["orders"].unionByName(tables["lines"]).where("key % 10 = 3")
    return T.reference_counts(tables, ids, "key")


@query("stale_cache", "SELECT user_id AS file, max(ts) AS modified FROM events GROUP BY user_id HAVING max(ts) > coalesce(max(CASE WHEN event_type = 'view' THEN ts END), TIMESTAMP '1970-01-01')")
def stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    files = e.groupBy(F.col("user_id").alias("file")).agg(F.max("ts").alias("modified"))
    return T.stale(files, e.where("event_type = 'view'").groupBy(F.col("user_id").alias("file")).agg(F.max("ts").alias("cached")))


@query("form_update", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INT) END AS number FROM events")
def form_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    number = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"))).otherwise("n/a")
    return e.select("event_id", T.form_text(name).alias("name"), T.form_int(number).alias("number"))


@query("whole_job")
def whole_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exams through the whole job; the second reading has every third stem with its first word in capitals, every
    fourth conversation none, and every other question an answer."""
    from .segment_queries import _exams

    docs = _exams(spark, sf_dir)
    seen = S.segment_documents(docs.where("doc_id % 4 <> 3"))
    q = seen.select("doc_id", F.explode("questions").alias("q")).select("doc_id", "q.number", "q.stem", "q.bogi", "q.choices")
    questions = q.select("doc_id", "number", F.when(F.col("number") % 3 == 0, F.initcap("stem")).otherwise(F.col("stem")).alias("stem"), F.col("bogi").alias("box"), "choices")
    p = seen.select("doc_id", F.posexplode("passages").alias("seq", "p"))
    pieces = p.select("doc_id", F.lit(1).alias("page_no"), "seq", F.lit(None).cast("string").alias("question_range"), F.initcap("p.content").alias("text"), F.lit(None).cast("string").alias("box"), F.array().cast("array<string>").alias("underlines"), F.array().cast("array<struct<label:string,text:string>>").alias("ranges"))
    answers = q.where("number % 2 = 0").select("doc_id", "number", (F.col("number") % 5 + 1).cast("int").alias("answer"), F.lit("").alias("explanation"))
    return J.run(docs, pieces, questions, answers).summary


@query("job_status", """SELECT user_id AS doc_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'segmenting' WHEN 1 THEN 'qa_checking' WHEN 2 THEN 'verifying' ELSE 'reviewing' END, ts) AS status
  FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) GROUP BY user_id""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of stages by job: of each job the last one."""
    e = load(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    names = F.array(*map(F.lit, (J.SEGMENTING, J.QA, J.VERIFYING, J.REVIEWING)))
    return J.status_of(e.select(F.col("user_id").alias("doc_id"), F.col("ts").alias("seq"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("status")))
