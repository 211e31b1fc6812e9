"""Regions of a page's elements by the words that each begins with.

A reading names passages, questions and pictures of a page by their first words; the page's own words have boxes. Runs of words are
joined by their text, whole beginnings first, then of three, two and one word, and a found beginning grows to a region: down its
column to the next one that isn't a picture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .geometry import PAGE

# Words of a beginning that are looked for if the whole isn't there, margins, and a picture's height.
FALLBACKS = (3, 2, 1)
MARGIN, GUTTER, LEAD, FOOT, PICTURE = 30, 5, 5, 50, 150
VISUAL = "visual"


def _placed(words: DataFrame, elements: DataFrame, *more: str) -> DataFrame:
    """Every element (doc_id, page_no, elem_no, more) with the place of its beginning (x0, y0, n_words), null if it isn't found.

    Words and elements go to their page together, and nothing is sent on from there: runs of one text meet by sorting within the page.
    """
    tokens = F.filter(F.split(F.lower(F.trim("anchor")), r"\s+"), lambda t: t != "")
    tiers = lambda t: F.array_distinct(F.concat(F.array(F.size(t)), F.filter(F.array(*map(F.lit, FALLBACKS)), lambda k: k < F.size(t))))
    asked = elements.select(tokens.alias("t")).where(F.size("t") > 0).select(F.explode(tiers("t")).alias("k"))
    lengths = sorted(r["k"] for r in asked.distinct().collect()) or [1]  # numbers of words of a beginning
    both = words.select(*PAGE, F.lit(True).alias("word"), "n", "x0", "y0", F.lower("text").alias("text")).unionByName(elements.select(*PAGE, F.lit(False).alias("word"), "elem_no", *more, "anchor"), True).where("doc_id is not null and page_no is not null")
    ahead = Window.partitionBy(*PAGE).orderBy("word", "n").rowsBetween(0, lengths[-1] - 1)
    both = both.withColumn("w", F.when(F.col("word"), F.collect_list("text").over(ahead)).otherwise(tokens))
    some = F.when(F.col("word"), F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.size("w"))).when(F.size("w") > 0, tiers("w"))
    runs = both.select(*PAGE, "word", "n", "x0", "y0", "elem_no", *more, "w", F.posexplode_outer(some).alias("tier", "k")).withColumn("run", F.array_join(F.slice("w", 1, F.coalesce("k", F.lit(0))), " ")).drop("w")
    at = F.min(F.when(F.col("word"), F.struct("n", "x0", "y0"))).over(Window.partitionBy(*PAGE, "k", "run"))
    hit = runs.withColumn("at", F.when(F.col("k").isNotNull(), at)).where("not word")
    best = hit.groupBy(*PAGE, "elem_no", *more).agg(F.min(F.when(F.col("at").isNotNull(), F.struct("tier", "k", "at"))).alias("b"))
    return best.select(*PAGE, "elem_no", *more, F.col("b.at.x0").alias("x0"), F.col("b.at.y0").alias("y0"), F.col("b.k").alias("n_words"))


def anchor_places(words: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, elem_no, x0, y0, n_words): the first place on its page of each element's beginning, by all of its words or by as
    many as are found (n_words), in any case; elements that aren't found are left out.

    words: doc_id, page_no, n (reading order), x0, y0, text. elements: doc_id, page_no, elem_no, anchor. Every word is the beginning
    of one run of each length that is asked for, so nothing is compared but by equal text.
    """
    return _placed(words, elements).where("n_words is not null")


def anchor_regions(words: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, elem_no, type, found, side, x0, y0, x1, y1 (on the page), px0, py0, px1, py1 (in its image) of every element.

    elements has type besides; pages: doc_id, page_no, page_w, page_h, image_w, image_h. A region reaches down its column to the
    next beginning in it that isn't a picture's, or to the foot of the page; a picture has a fixed height. Of beginnings at one
    height the lesser elem_no comes first. An element that isn't found has no box.
    """
    rows = _placed(words, elements, "type").join(pages, PAGE)
    rows = rows.withColumn("found", F.col("y0").isNotNull()).withColumn("side", F.when(F.col("found"), F.when(F.col("x0") < F.col("page_w") * 0.5, "left").otherwise("right")))
    w = Window.partitionBy(*PAGE, "side").orderBy("y0", "elem_no").rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.col("type") != VISUAL, F.col("y0")), ignorenulls=True).over(w)
    mid = F.col("page_w") * 0.5
    left, picture = F.col("side") == "left", F.col("type") == VISUAL
    rows = rows.withColumn("after", after)
    box = F.when(F.col("found"), F.struct(
        F.when(left, F.lit(float(MARGIN))).otherwise(mid + GUTTER).alias("x0"), F.when(picture, F.col("y0") - LEAD).otherwise(F.col("y0")).alias("y0"), F.when(left, mid - GUTTER).otherwise(F.col("page_w") - MARGIN).alias("x1"),
        F.when(picture, F.col("y0") + PICTURE).otherwise(F.greatest(F.col("y0") + 1, F.coalesce(F.col("after") - LEAD, F.col("page_h") - FOOT))).alias("y1"),
    ))
    rows = rows.withColumn("b", box)
    pixel = lambda c, size, image: (F.col(f"b.{c}") * F.col(image) / F.col(size)).cast("int").alias(f"p{c}")
    return rows.select(
        *PAGE, "elem_no", "type", "found", "side", "b.x0", "b.y0", "b.x1", "b.y1",
        pixel("x0", "page_w", "image_w"), pixel("y0", "page_h", "image_h"), pixel("x1", "page_w", "image_w"), pixel("y1", "page_h", "image_h"),
    )


def anchor_rates(regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, rate): the share of a page's elements that were found."""
    return regions.groupBy(*PAGE).agg(F.round(F.count_if("found") / F.count(F.lit(1)), 3).alias("rate"))
