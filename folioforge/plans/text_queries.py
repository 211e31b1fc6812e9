"""Text scalars, JSON, links and metadata over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query
from ..functions import classify, text as tx
from ..sources import html, tables
from ..session import load
from . import sql


@query("tag_strip", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM (SELECT page_id, regexp_replace(html, '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS html FROM pages) p""")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.md5(html.visible_text(F.col("html"))).alias("digest"))


_LINKS = r"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"''#]+)[^>]*>(.*?)</a>', 1) AS h FROM pages),
 l AS (SELECT page_id, unnest(range(0, len(h))) AS pos, host, h FROM a), c AS (SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN starts_with(h[pos + 1], '/') THEN host || h[pos + 1] ELSE h[pos + 1] END AS href FROM l)"""


@query("crawl_links", _LINKS + " SELECT page_id, pos, href FROM c")
def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(load(spark, sf_dir, "pages")).select("page_id", "pos", "href")


@query("crawl_dedup", _LINKS + " SELECT href, page_id FROM (SELECT href, page_id, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS rn FROM c) t WHERE rn = 1")
def crawl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.first_links(html.links(load(spark, sf_dir, "pages"))).select("href", "page_id")


@query("html_sanitize")
def html_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", html.sanitise("html").alias("clean"))


@query(
    "metadata_extract",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
        CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' ELSE 'plain' END AS kind FROM pages""",
)
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    kind = classify.cases([(u.contains("?"), "query"), (u.contains("#"), "fragment")], "plain")
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, "/(en|de|fr|es)/", 1).alias("lang"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), kind.alias("kind"))


@query("whitespace_normalise", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("digest"))


@query("clamp_and_inline", r"SELECT doc_id, md5(regexp_replace(trim(text, ' ' || chr(10)), '\s*\n\s*', ' ', 'g')) AS digest FROM documents")
def clamp_and_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(tx.inline(tx.clamp_blank_lines(F.col("text")))).alias("digest"))


@query("first_last_marks", """SELECT doc_id, CAST(least(CASE WHEN instr(text, ',') > 0 THEN instr(text, ',') ELSE 1000000 END, CASE WHEN instr(text, '.') > 0 THEN instr(text, '.') ELSE 1000000 END) - 1 AS INT) AS first,
  CAST(length(text) - least(CASE WHEN instr(reverse(text), ',') > 0 THEN instr(reverse(text), ',') ELSE 1000000 END, CASE WHEN instr(reverse(text), '.') > 0 THEN instr(reverse(text), '.') ELSE 1000000 END) AS INT) AS last
  FROM documents WHERE contains(text, ',') OR contains(text, '.')""")
def first_last_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").where(t.contains(",") | t.contains(".")).select("doc_id", tx.first_of(t, [",", "."]).cast("int").alias("first"), tx.last_of(t, [",", "."]).cast("int").alias("last"))


@query("fingerprint_keys", "SELECT doc_id, substring(md5(concat_ws('|', source, lang, substring(text, 1, 80))), 1, 12) AS fingerprint, lang || '|||' || substring(text, 1, 80) AS key FROM documents")
def fingerprint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"), tx.key_of(F.col("lang"), F.col("text")).alias("key"))


@query("context_window", "SELECT doc_id, substring(text, greatest(instr(text, 'que') - 1 - 30, 0) + 1, 60) AS context FROM documents WHERE contains(text, 'que')")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").where(t.contains("que")).select("doc_id", tx.around(t, F.instr(t, F.lit("que")) - 1).alias("context"))


@query("quoted_text", r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '["“‘'']([^"”’'']+)["”’'']', 1), ''), nullif(trim(regexp_extract(text, '(?s):\s*(.+)$', 1)), ''), '') AS quoted FROM documents""")
def quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.quoted(F.col("text")).alias("quoted"))


@query("scan_gating", "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) / (len(string_split(text, chr(10)))) >= 80 AS digital, length(text) >= 100 AND (length(text) - length(replace(text, ' ', ''))) / length(text) < 0.03 AS low_quality FROM documents")
def scan_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", classify.digital_pages(t, F.size(F.split(t, "\n"))).alias("digital"), classify.low_quality(t).alias("low_quality"))


sql("json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")


@query("json_double_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS number FROM events")
def json_double_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every other event's questions are a JSON text within the JSON
    inner = F.concat(F.lit('[{"number":'), F.get_json_object("props", "$.k"), F.lit("}]"))
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"questions":'), inner, F.lit("}"))).otherwise(F.to_json(F.struct(inner.alias("questions"))))
    return load(spark, sf_dir, "events").select("event_id", tables.questions_of(doc)[0]["number"].alias("number"))


sql("char_range_scan", r"SELECT source, sum(regexp_count(text, '[^\\x00-\\x7F]')) AS n FROM {documents} GROUP BY source HAVING n > 0", "SELECT source, count(*) AS n FROM (SELECT source, unnest(string_split(text, '')) AS c FROM documents) t WHERE unicode(c) > 127 GROUP BY source")
sql("age_parse", "SELECT event_id, date_diff(DAY, ts, timestamp'2024-03-01 00:00:00') > 20 AS stale FROM {events}", "SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT) > 20 AS stale FROM events")
sql("coordinate_scale", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 1700 / 1000 AS INT) AS x, CAST(l_discount * 2200 AS INT) AS y, CASE WHEN l_quantity < 25 THEN 'left' ELSE 'right' END AS side, greatest(0, least(100, CAST(l_tax * 2000 AS INT) - 20)) AS clamped FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_quantity * 1700 / 1000) AS INT) AS x, CAST(trunc(l_discount * 2200) AS INT) AS y, CASE WHEN l_quantity < 25 THEN 'left' ELSE 'right' END AS side, greatest(0, least(100, CAST(trunc(l_tax * 2000) AS INT) - 20)) AS clamped FROM lineitem")
sql("file_class", "SELECT page_id, CASE WHEN regexp_like(url, '[?]page=') THEN 'listing' WHEN regexp_like(url, '/[0-9]+$') THEN 'post' WHEN endswith(url, '.pdf') THEN 'file' ELSE 'other' END AS kind FROM {pages}", "SELECT page_id, CASE WHEN regexp_matches(url, '[?]page=') THEN 'listing' WHEN regexp_matches(url, '/[0-9]+$') THEN 'post' WHEN ends_with(url, '.pdf') THEN 'file' ELSE 'other' END AS kind FROM pages")
sql("filename_rewrite", "SELECT page_id, regexp_replace(url, '/(en|fr|de|es)/', '/[$1]/') AS url FROM {pages}", r"SELECT page_id, regexp_replace(url, '/(en|fr|de|es)/', '/[\1]/') AS url FROM pages")
