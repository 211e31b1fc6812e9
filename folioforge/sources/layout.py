"""Layout files as tables. A layout file has one JSON object a line for each page: page_no, width, height, and the page's blocks, words
and drawings.

No PDF library is assumed: whatever decodes a PDF writes such files, and everything downstream works on these tables. Spark's
JSON reader splits a file by byte range, reads only the record kinds that are asked for, and drops pages by a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.geometry import PAGE, clip_text

BOX = "box: array<double>"
PAGES = (
    f"page_no int, width double, height double, blocks array<struct<{BOX},text:string,kind:int>>, words array<struct<{BOX},text:string,block:int,line:int,word:int>>, "
    f"drawings array<struct<{BOX},width:double,kind:string>>"
)


def layout_pages(spark: SparkSession, paths: list[str], pages: Column | None = None) -> DataFrame:
    """doc_id (the file's name up to the first dot) and PAGES of layout files; a broken line is no page. pages is a condition on page_no."""
    rows = spark.read.schema(PAGES).option("mode", "DROPMALFORMED").json(paths)
    rows = rows.where(F.col("page_no").isNotNull() if pages is None else pages)
    return rows.select(F.split_part(F.col("_metadata.file_name"), F.lit("."), F.lit(1)).alias("doc_id"), "*")


def _boxed(pages: DataFrame, kind: str, number: str, *columns: Column) -> DataFrame:
    """A row for each record of a kind, with its number on the page and the corners of its box."""
    rows = pages.select("doc_id", "page_no", "width", "height", F.posexplode(kind).alias(number, "r"))
    corners = [F.get("r.box", k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("doc_id", "page_no", number, *corners, *columns)


def layout_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no, x0, y0, x1, y1, kind (0 text, 1 picture), text, page_w, page_h."""
    return _boxed(pages, "blocks", "block_no", F.coalesce("r.kind", F.lit(0)).alias("kind"), F.coalesce("r.text", F.lit("")).alias("text"), F.col("width").alias("page_w"), F.col("height").alias("page_h"))


def layout_words(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, n, x0, y0, x1, y1, text, block_no, line_no, word_no."""
    return _boxed(pages, "words", "n", F.col("r.text").alias("text"), F.col("r.block").alias("block_no"), F.col("r.line").alias("line_no"), F.col("r.word").alias("word_no"))


def layout_drawings(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, rect_no, x0, y0, x1, y1, kind, line_width (1 where none is given)."""
    return _boxed(pages, "drawings", "rect_no", F.col("r.kind").alias("kind"), F.coalesce("r.width", F.lit(1.0)).alias("line_width"))


def underline_manifest(words: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page_no, phrase): the distinct texts over thin level lines of 20 to 500, from 14 above a line to 2 below. Signs, form
    labels, page numbers and texts of fewer than three characters are none."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    lines = drawings.where((F.col("kind") == "line") & (F.col("line_width") < 1.0) & (dy < 2) & dx.between(20, 500))
    rects = lines.select(*PAGE, "rect_no", F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), (F.col("y0") - 14).alias("y0"), (F.col("y0") + 2).alias("y1"))
    phrase = clip_text(words, rects).select(*PAGE, tx.strip(F.col("text")).alias("phrase"))
    return phrase.where((F.length("phrase") >= 3) & ~tx.noise_mark(F.col("phrase")) & ~F.col("phrase").rlike(r"^\d+\s\d+$")).distinct()


def read_layout(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The blocks of layout files."""
    return layout_blocks(layout_pages(spark, paths))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text, n_pages) of pages (doc_id, page_no, text): pages in order, each behind its mark."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("--- 페이지 "), p["page_no"].cast("string"), F.lit(" ---\n"), p["text"])), "\n")
    return pages.groupBy("doc_id").agg(text.alias("text"), F.count(F.lit(1)).alias("n_pages"))


def columns_of(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def combined_exams(pages: DataFrame, least: int = 12) -> DataFrame:
    """doc_id of papers with `least` pages or more on which both optional sections are named."""
    has = lambda p: F.max(F.col("text").rlike(p).cast("int"))
    agg = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), has(r"화법과\s*작문").alias("a"), has(r"언어와\s*매체").alias("b"))
    return agg.where((F.col("n") >= least) & (F.col("a") == 1) & (F.col("b") == 1)).select("doc_id")


def page_classes(pages: DataFrame) -> DataFrame:
    """(doc_id, section, pages): which pages name which optional section; other pages are common."""
    section = F.when(F.col("text").rlike(r"화법과\s*작문"), "hwajak").when(F.col("text").rlike(r"언어와\s*매체"), "eonmae").otherwise("common")
    return pages.groupBy("doc_id", section.alias("section")).agg(F.array_sort(F.collect_list("page_no")).alias("pages"))
