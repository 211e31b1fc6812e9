"""HTML pages: links, file blocks, crawling by frontier, and an allow-list sanitiser.

Links and tags are found by native expressions; only the sanitiser, which rewrites attribute by attribute, is a pandas UDF.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import classify, text as tx
from ..operators.rows import kept

ANCHOR = r"""(?is)<a\s[^>]*href\s*=\s*["']([^"'#]+)[^>]*>(.*?)</a>"""

# Tags that are kept, and the attributes of each.
ALLOWED = {
    "b": (), "i": (), "u": (), "strong": (), "em": (), "br": (), "p": ("style",), "span": ("class", "style", "data-label"), "img": ("src", "alt", "style"), "sup": (),
}
SOURCES = ("/static/", "/uploads/")
STYLES = re.compile(r"^(text-align|font-weight|text-decoration|color|width|height|max-width)\s*:\s*[\w\s%#.\-]+$")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"([a-zA-Z\-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def links(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, pos, href, title) of every link; hrefs that start with a slash are taken from the page's host."""
    host = F.regexp_extract(url, r"^(https?://[^/]+)", 1)
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(body, F.lit(ANCHOR), 2).alias("title"))
    out = pages.select(page_id, host.alias("host"), F.posexplode(pairs).alias("pos", "a"))
    href = F.when(F.col("a.href").startswith("/"), F.concat("host", F.col("a.href"))).otherwise(F.col("a.href"))
    return out.select(page_id, "pos", href.alias("href"), tx.squeeze(tx.drop_tags(F.col("a.title"))).alias("title"))


def first_links(found: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The first occurrence of each href, by page and place."""
    w = Window.partitionBy("href").orderBy(page_id, "pos")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def posts(found: DataFrame) -> DataFrame:
    """Links to numbered posts with titles of five characters or more, with year and exam of the title."""
    own = found.where(F.col("href").rlike(r"/\d+/?$") & (F.length("title") >= 5))
    return own.withColumn("year", classify.exam_year(F.col("title"))).withColumn("exam_type", classify.exam_type(F.col("title")))


def files(found: DataFrame, extension: str = "pdf") -> DataFrame:
    """Links to files, with a name: the title, or else the last part of the address."""
    rows = found.where(F.lower(F.col("href")).rlike(rf"\.{extension}(\?|$)"))
    last = F.url_decode(F.regexp_extract("href", r"([^/?]+)(?:\?.*)?$", 1))
    return rows.withColumn("filename", F.when(F.length("title") > 0, F.col("title")).otherwise(last)).withColumn("file_type", classify.file_type(F.col("filename")))


def crawl(found: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(href, depth) of what is reached from start (href) over links (src, href): each address once, at its least depth.

    Every frontier is written before the next is looked for, so that a level doesn't work out those before it again; it ends with
    the first that is empty.
    """
    edges = found.select("src", "href").distinct()
    seen = front = kept(start.select("href", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        nxt = front.select(F.col("href").alias("src")).join(edges, "src").select("href").distinct()
        front = kept(nxt.join(seen.select("href"), "href", "left_anti").select("href", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


PAGE = r"[?&]page=(\d+)"


def listing_pages(pages: DataFrame) -> DataFrame:
    """Of listing pages (url, html), those that a reader comes to who asks for ?page=1, 2, ... of each listing until one has no posts:
    their columns, listing and page_no. A page without a number is the first; of several with one number the least url counts."""
    no = F.coalesce(F.nullif(F.regexp_extract("url", PAGE, 1), F.lit("")).cast("int"), F.lit(1))
    base = F.regexp_replace(F.regexp_replace("url", PAGE, ""), r"[?&]$", "")
    rows = pages.withColumn("listing", base).withColumn("page_no", no)
    rows = rows.withColumn("rn_", F.row_number().over(Window.partitionBy("listing", "page_no").orderBy("url"))).where("rn_ = 1").drop("rn_")
    some = F.size(F.filter(F.regexp_extract_all("html", F.lit(ANCHOR), 1), lambda h: h.rlike(r"/\d+/?$"))) > 0
    there = rows.where(some).withColumn("rn_", F.row_number().over(Window.partitionBy("listing").orderBy("page_no")))
    return there.where("rn_ = page_no").drop("rn_")


def site(pages: DataFrame, listings: DataFrame) -> DataFrame:
    """(listing, post, href, filename, file_type): the files of the posts of all pages of the listings (url). pages (url, html) holds
    what was fetched; a post or file that several pages link to counts once, by its first listing."""
    start = pages.join(listings.select(F.col("url").alias("listing_")).distinct(), F.regexp_replace(F.regexp_replace("url", PAGE, ""), r"[?&]$", "") == F.col("listing_"), "left_semi")
    found = listing_pages(start)
    own = posts(links(found.withColumn("page_id", F.struct("listing", "page_no")))).select(F.col("page_id.listing").alias("listing"), "href")
    post = kept(own.groupBy("href").agg(F.min("listing").alias("listing")).withColumnRenamed("href", "post"))
    body = pages.join(post, F.col("url") == F.col("post")).select(F.struct("listing", "post").alias("page_id"), "url", "html")
    got = files(links(body))
    return got.groupBy("href").agg(F.min(F.struct("page_id", "filename", "file_type")).alias("f")).select(F.col("f.page_id.listing").alias("listing"), F.col("f.page_id.post").alias("post"), "href", "f.filename", "f.file_type")


def _sanitise(text: str | None) -> str | None:
    if text is None:
        return None

    def tag(m: re.Match) -> str:
        close, name, rest = m[1], m[2].lower(), m[3]
        if name not in ALLOWED:
            return ""
        if close:
            return "" if name in ("br", "img") else f"</{name}>"
        kept = []
        for k, v in _ATTR.findall(rest):
            k, v = k.lower(), html.unescape(v[1:-1]).strip()
            if k not in ALLOWED[name] or (k == "src" and not v.startswith(SOURCES)):
                continue
            if k == "style":
                v = "; ".join(x for x in (y.strip() for y in v.split(";")) if STYLES.match(x))
                if not v:
                    continue
            kept.append(f' {k}="{html.escape(v)}"')
        if name == "img" and not any(x.startswith(" src=") for x in kept):
            return ""
        return f"<{name}{''.join(kept)}>"

    return _TAG.sub(tag, re.sub(r"(?s)<!--.*?-->", "", text))


@F.pandas_udf(T.StringType())
def sanitise(col: pd.Series) -> pd.Series:
    """Markup with only the allowed tags, attributes, styles and picture sources; the text of dropped tags stays."""
    return col.map(_sanitise, na_action="ignore")


def visible_text(body: Column) -> Column:
    return tx.squeeze(tx.chain(body, (r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"<[^>]+>", " ")))
