"""Layout geometry: words, lines and boxes of a page. Every join is on the page first; nearest is one aggregate, not a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify, text as tx
from .joins import by_key_or_bin

PAGE = ["doc_id", "page_no"]


def _on(a: str, b: str, *more):
    return [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in PAGE] + list(more)


def underlined(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words with an underline: x ranges meet, and the line is from 4 above to under 16 below the word's text line."""
    low = F.max("y1").over(Window.partitionBy(*PAGE, "block_no", "line_no"))
    w, u = words.withColumn("line_y", low).alias("w"), lines.alias("u")
    dy = F.col("u.y0") - F.col("w.line_y")
    return w.join(u, _on("w", "u", F.col("w.x0") < F.col("u.x1"), F.col("u.x0") < F.col("w.x1"), dy >= -4, dy < 16), "left_semi")


def inner_items(blocks: DataFrame, boxes: DataFrame, slack: float = 10) -> DataFrame:
    """Each block whose centre is in a box (with slack), with the first such box: the block's columns and box_no."""
    x, y = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    inside = [x.between(F.col("b.x0") - slack, F.col("b.x1") + slack), y.between(F.col("b.y0") - slack, F.col("b.y1") + slack)]

    def joined(a: DataFrame, b: DataFrame, more: list) -> DataFrame:
        hit = a.alias("a").join(b.alias("b"), _on("a", "b", *inside, *more))
        return hit.groupBy(*(F.col(f"a.{c}") for c in blocks.columns)).agg(F.min("b.box_no").alias("box_no"))

    centre = (F.col("y0") + F.col("y1")) / 2
    return by_key_or_bin(blocks, boxes, PAGE, (centre, centre), (F.col("y0") - slack, F.col("y1") + slack), joined)


def not_borders(lines: DataFrame, verticals: DataFrame, slack: float = 8) -> DataFrame:
    """Horizontal lines without a vertical line at both of their ends."""
    h, v = lines.alias("h"), verticals.alias("v")
    at = lambda end: _on("h", "v", F.abs(F.col(f"h.{end}") - F.col("v.x0")) <= slack, F.col("h.y0").between(F.col("v.y0") - slack, F.col("v.y1") + slack))
    borders = h.join(v, at("x0"), "left_semi").alias("h").join(v, at("x1"), "left_semi")
    return lines.join(borders.select(*PAGE, "line_id"), [*PAGE, "line_id"], "left_anti")


def nearest_below(labels: DataFrame, lines: DataFrame, reach: float = 35) -> DataFrame:
    """Each label with the y of the nearest line below it, at most `reach` away, that its x range meets; or null."""
    dy = F.col("b.y0") - F.col("a.y1")

    def joined(a: DataFrame, b: DataFrame, more: list) -> DataFrame:
        hit = a.alias("a").join(b.alias("b"), _on("a", "b", F.col("a.x0") < F.col("b.x1"), F.col("b.x0") < F.col("a.x1"), dy > 0, dy <= reach, *more), "left")
        return hit.groupBy(*(F.col(f"a.{c}") for c in labels.columns)).agg(F.min("b.y0").alias("below"))

    return by_key_or_bin(labels, lines, PAGE, (F.col("y1"), F.col("y1") + reach), (F.col("y0"), F.col("y0")), joined)


def bracket_ranges(labels: DataFrame, verticals: DataFrame, boxes: DataFrame, page_height: float, slack: float = 10) -> DataFrame:
    """Each label with the y range it stands for: of the nearest upright line that holds its height and is shorter than 60 % of
    the page, else of the nearest box edge within 40, else 80 to either side."""
    a = labels.withColumn("ly", (F.col("y0") + F.col("y1")) / 2)
    keys = a.columns
    cols = [F.col(f"a.{c}") for c in keys]
    v = verticals.where(F.col("y1") - F.col("y0") < 0.6 * page_height).alias("v")
    near = F.struct(F.abs(F.col("a.x0") - F.col("v.x0")).alias("d"), F.col("v.y0").alias("y0"), F.col("v.y1").alias("y1"))
    one = a.alias("a").join(v, _on("a", "v", F.col("a.ly").between(F.col("v.y0") - slack, F.col("v.y1") + slack)), "left").groupBy(*cols).agg(F.min(F.when(F.col("v.y0").isNotNull(), near)).alias("line"))
    b = boxes.alias("b")
    edge = F.least(F.abs(F.col("a.x0") - F.col("b.x0")), F.abs(F.col("a.x0") - F.col("b.x1")))
    box = F.struct(edge.alias("d"), F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1"))
    out = one.alias("a").join(b, _on("a", "b", edge <= 40, F.col("a.ly").between(F.col("b.y0") - slack, F.col("b.y1") + slack)), "left").groupBy(*(F.col(f"a.{c}") for c in [*keys, "line"])).agg(F.min(F.when(F.col("b.y0").isNotNull(), box)).alias("box"))
    return out.select(*keys, F.coalesce("line.y0", "box.y0", F.col("ly") - 80).alias("top"), F.coalesce("line.y1", "box.y1", F.col("ly") + 80).alias("bottom")).drop("ly")


def distinct_boxes(boxes: DataFrame, slack: float = 5) -> DataFrame:
    """Boxes without an earlier one whose corner is nearer than the slack in x and in y."""
    a, e = boxes.alias("a"), boxes.alias("e")
    near = (F.abs(F.col("a.x0") - F.col("e.x0")) < slack) & (F.abs(F.col("a.y0") - F.col("e.y0")) < slack)
    return a.join(e, _on("a", "e", F.col("e.box_no") < F.col("a.box_no"), near), "left_anti")


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks within the page body: from 5 % to 90 % of its height."""
    return blocks.where((F.col("y0") >= 0.05 * F.col("page_h")) & (F.col("y1") <= 0.90 * F.col("page_h")))


def page_text(blocks: DataFrame) -> DataFrame:
    """Text of each page in reading order: left column first, then down; a blank line where the gap is wide."""
    side = F.when(F.col("x0") < 0.5 * F.col("page_w"), 0).otherwise(1)
    w = Window.partitionBy(*PAGE).orderBy("side", "y0", "block_no")
    rows = body_blocks(blocks).where("kind = 0").withColumn("side", side)
    gap = F.col("y0") - F.lag("y1").over(w)
    sep = F.when(F.lag("side").over(w).isNull(), "").when((gap > 18) | (F.lag("side").over(w) != F.col("side")), "\n\n").otherwise("\n")
    rows = rows.withColumn("t", F.concat(sep, F.trim("text")))
    parts = F.array_sort(F.collect_list(F.struct("side", "y0", "block_no", "t")))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


# Share of a page that makes a block one over both columns, how far in an indent is, and gaps that end a line.
FULL_WIDTH, INDENT, SHORT_LINE, POEM, WIDE_GAP = 0.55, 6, 0.80, 0.55, 15
LABEL_BLOCK, QUESTION_HEAD = r"^\[[A-E]\]$", r"^\d{1,2}[.．。]\s"


def block_texts(blocks: DataFrame, words: DataFrame, lines: DataFrame) -> DataFrame:
    """blocks with `text` on one line; where words of a block (block_no, line_no, word_no) are underlined by one of the lines, from its
    words, with <u> around each run of underlined ones within a line."""
    key = [*PAGE, "block_no", "line_no", "word_no"]
    under = underlined(words, lines).select(*key).distinct().withColumn("u", F.lit(True))
    flagged = words.join(under, key, "left").select(*PAGE, "block_no", F.struct("line_no", "word_no", "text", F.coalesce("u", F.lit(False)).alias("u")).alias("w"))
    own = flagged.groupBy(*PAGE, "block_no").agg(F.array_sort(F.collect_list("w")).alias("w")).where(F.exists("w", lambda w: w["u"]))
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("u"))
    mark = lambda on, tag: F.when(on, tag).otherwise("")

    def step(a, w):
        goes_on = a["line"].eqNullSafe(w["line_no"].cast("int")) & (a["u"] == w["u"])
        out = F.when(a["line"].isNull(), F.concat(mark(w["u"], "<u>"), w["text"])).when(goes_on, F.concat(a["out"], F.lit(" "), w["text"])).otherwise(F.concat(a["out"], mark(a["u"], "</u>"), F.lit(" "), mark(w["u"], "<u>"), w["text"]))
        return F.struct(out.alias("out"), w["line_no"].cast("int").alias("line"), w["u"].alias("u"))

    built = own.select(*PAGE, "block_no", F.aggregate("w", start, step, lambda a: F.concat(a["out"], mark(a["u"], "</u>"))).alias("built"))
    return blocks.join(built, [*PAGE, "block_no"], "left").withColumn("text", F.coalesce("built", tx.squeeze(F.coalesce("text", F.lit(""))))).drop("built")


def marked_page_text(blocks: DataFrame, words: DataFrame, lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): each page as it is read, with underlines, indents and range marks.

    Blocks over both columns come first, then the left and the right column. blocks: see page_text; words and lines: see underlined;
    ranges: doc_id, page_no, label, top, bottom (see bracket_ranges). A block that is a range's label, boilerplate or empty is
    left out, one that is set in by 6 or more starts with a wide space. Behind a block stands a blank line before a question, a
    line break before an indent, a wide gap, or where the lines of a poem end, else a blank. A block within 5 of a range belongs
    to it, to the first by label of several. A page without text has no row.
    """
    body = block_texts(blocks.where((F.col("kind") == 0) & (F.col("y1") <= 0.90 * F.col("page_h"))), words, lines)
    body = body.where((F.col("text") != "") & ~F.col("text").rlike(LABEL_BLOCK) & ~tx.boilerplate(F.col("text")))
    mid = F.col("page_w") * 0.5
    side = F.when((F.col("x0") + F.col("x1")) / 2 < mid, 1).otherwise(2)
    low = column_baselines(blocks.where((F.col("kind") == 0) & (F.col("y0") >= 0.05 * F.col("page_h")) & (F.col("y1") <= 0.92 * F.col("page_h")) & (F.length(F.trim("text")) >= 5)))
    low = low.select(*PAGE, F.when(F.col("side") == "left", 1).otherwise(2).alias("half"), "baseline")
    body = body.withColumn("half", side).join(low, [*PAGE, "half"], "left")
    body = body.withColumn("text", F.when(F.col("x0") - F.col("baseline") >= INDENT, F.concat(F.lit("　"), "text")).otherwise(F.col("text")))
    body = body.withColumn("part", F.when(F.col("x1") - F.col("x0") > FULL_WIDTH * F.col("page_w"), 0).when(F.col("x0") < mid, 1).otherwise(2))

    r = ranges.select(*PAGE, "label", F.col("top").alias("r0"), F.col("bottom").alias("r1"))
    near = body.select(*PAGE, "block_no", "y0", "y1").join(r, PAGE).where((F.col("r0") - 5 <= F.col("y1")) & (F.col("r1") + 5 >= F.col("y0")))
    body = body.join(near.groupBy(*PAGE, "block_no").agg(F.min("label").alias("label")), [*PAGE, "block_no"], "left").withColumn("label", F.when(F.col("part") > 0, F.col("label")))

    column = Window.partitionBy(*PAGE, "part")
    order = column.orderBy("y0", "block_no")
    before = lambda c: F.lag(c).over(order)
    body = body.withColumn("gap", F.col("y0") - before("y1")).withColumn("right", F.max("x1").over(column)).withColumn("n", F.count(F.lit(1)).over(column))
    short = F.col("x1") < F.col("right") * SHORT_LINE
    poem = (F.col("n") >= 3) & (F.count_if(short).over(column) / F.col("n") > POEM)
    usual = F.coalesce(F.avg(F.when((F.col("gap") > 0) & (F.col("gap") < 50), F.col("gap"))).over(column), F.lit(10.0))
    wide = ((F.col("gap") > usual * 1.8) & (F.col("gap") > 8)) | (F.col("gap") > WIDE_GAP)
    sep = F.when(F.col("part") == 0, "\n\n").when(F.col("text").rlike(QUESTION_HEAD), "\n\n").when(F.col("text").startswith("　"), "\n").when(wide, "\n").when(poem & before(short), "\n").otherwise(" ")
    was, last = before("label"), F.lead("block_no").over(order).isNull()
    changes = ~was.eqNullSafe(F.col("label"))
    tag = lambda c, what: F.concat(F.lit("["), c, F.lit(f":{what}]"))
    piece = F.concat(
        F.when(was.isNotNull() & changes, tag(was, "END")).otherwise(""), F.when(before("block_no").isNull(), "").otherwise(sep), F.when(F.col("label").isNotNull() & changes, F.concat(tag(F.col("label"), "START"), F.lit("\n"))).otherwise(""),
        F.col("text"), F.when(last & F.col("label").isNotNull(), tag(F.col("label"), "END")).otherwise(""),
    )
    pieces = body.select(*PAGE, "part", "y0", "block_no", piece.alias("t"))
    parts = pieces.groupBy(*PAGE, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "block_no", "t"))), lambda p: p["t"]), "").alias("t"))
    return parts.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda p: p["t"]), "\n\n").alias("text"))


def column_baselines(blocks: DataFrame) -> DataFrame:
    """The x0 a tenth of the way up the sorted x0 of each column: its indent baseline."""
    side = F.when(F.col("x0") < 0.5 * F.col("page_w"), "left").otherwise("right")
    return blocks.groupBy(*PAGE, side.alias("side")).agg(F.element_at(F.array_sort(F.collect_list("x0")), (F.floor(F.count(F.lit(1)) / 10) + 1).cast("int")).alias("baseline"))


def clip_text(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words within each rectangle, in order, as one text."""
    x, y = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2

    def joined(a: DataFrame, b: DataFrame, more: list) -> DataFrame:
        hit = a.alias("a").join(b.alias("b"), _on("a", "b", x.between(F.col("b.x0"), F.col("b.x1")), y.between(F.col("b.y0"), F.col("b.y1")), *more))
        parts = F.array_sort(F.collect_list(F.struct("a.block_no", "a.line_no", "a.word_no", "a.text")))
        return hit.groupBy(*(F.col(f"b.{k}") for k in [*PAGE, "rect_no"])).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))

    centre = (F.col("y0") + F.col("y1")) / 2
    return by_key_or_bin(words, rects, PAGE, (centre, centre), (F.col("y0"), F.col("y1")), joined)


def enclosing_bottom(labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each label with the bottom of the first box around it (null without one): at most 30 narrower to either side, from at most 60
    below its top to at most 20 above its bottom, and more than 50 wide and 30 high."""
    boxes = boxes.where((F.col("x1") - F.col("x0") > 50) & (F.col("y1") - F.col("y0") > 30))
    around = [F.col("b.x0") <= F.col("a.x0") + 30, F.col("b.x1") >= F.col("a.x1") - 30, F.col("b.y0") <= F.col("a.y0") + 60, F.col("b.y1") >= F.col("a.y1") - 20]

    def joined(a: DataFrame, b: DataFrame, more: list) -> DataFrame:
        hit = a.alias("a").join(b.alias("b"), _on("a", "b", *around, *more), "left")
        return hit.groupBy(*(F.col(f"a.{c}") for c in labels.columns)).agg(F.min_by("b.y1", "b.box_no").alias("bottom"))

    return by_key_or_bin(labels, boxes, PAGE, (F.col("y0"), F.col("y1")), (F.col("y0") - 60, F.col("y1") + 20), joined)


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the page body that aren't boilerplate."""
    return body_blocks(blocks).where(~tx.boilerplate(F.coalesce("text", F.lit(""))))


def estimate_run(files: DataFrame) -> DataFrame:
    """(doc_id, pages, est_tokens, est_usd) of files (doc_id, pages) before they are read."""
    return files.select("doc_id", "pages", classify.estimate(F.col("pages")).alias("e")).select("doc_id", "pages", F.col("e.tokens").alias("est_tokens"), F.col("e.usd").alias("est_usd"))
