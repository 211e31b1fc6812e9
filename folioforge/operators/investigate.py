"""Why questions are missing: numbers in the text against numbers stored, with context and likely causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

# A question's number, any number that begins a line, and the places where a text is parted: before numbers that begin one after a break.
HEAD, NUMBERED, BEFORE_HEAD = r"^\d{1,2}[.．。][ \t\n]", r"(?m)^[ \t]*(-?\d+[.．。][ \t\n]?)", r"(?<=\n)(?=[ \t]*\d{1,2}[.．。][ \t\n])"


def missing_questions(pages: DataFrame, stored: DataFrame, reported: DataFrame) -> DataFrame:
    """(doc_id, number, in_text, reported, context, causes): numbers of the text (doc_id, text; a row each document) that aren't stored
    (doc_id, number), and reported ones that aren't. A text is parted at its numbers once and stays where it is: what is joined are
    numbers and what was read where each stands first."""
    key, part = ["doc_id", "number"], F.col("p.part")
    parts = pages.select("doc_id", "text", F.split("text", BEFORE_HEAD).alias("parts"))
    starts = F.aggregate("parts", F.array(F.lit(0)), lambda n, x: F.concat(n, F.array(F.element_at(n, -1) + F.length(x))))
    parts = parts.select("doc_id", "text", F.explode(F.arrays_zip(F.col("parts").alias("part"), starts.alias("start"))).alias("p")).where("p.part is not null")
    heads = parts.select("*", F.explode(F.array_distinct(F.regexp_extract_all(part, F.lit(NUMBERED), 1))).alias("h"))
    heads = heads.withColumn("digits", F.regexp_extract("h", r"^-?\d+", 0)).withColumn("number", F.col("digits").try_cast("int")).where("number is not null")
    itself = F.col("digits") == F.col("number").cast("string")  # 07. is question 7, but isn't found by 7.
    heads = heads.withColumn("here", F.when(itself, F.regexp_instr(part, F.concat(F.lit(r"(?m)^[ \t]*"), F.col("digits"), F.lit(r"[.．。]")))))
    heads = heads.withColumn("at", F.col("p.start").cast("long") + F.col("here")).withColumn("context", F.when(itself, tx.around(F.col("text"), F.col("at").cast("int") - 1)))
    bare, admin = ~F.substring(part, F.col("here") + 1, F.length(part)).rlike("[①-⑤]"), F.col("context").rlike("페이지|교시|수험번호|성명")
    heads = heads.select(*key, (F.col("h").rlike(HEAD) & F.col("number").between(1, 45)).alias("t"), "at", "context", (F.col("at") * 4 + bare.cast("int") * 2 + admin.cast("int")).alias("seen"))
    read = heads.groupBy(*key).agg(F.max("t").alias("t"), F.min("seen").alias("seen"), F.min_by("context", "at").alias("context"))
    want = read.join(reported.select(*key).distinct().withColumn("r", F.lit(True)), key, "full_outer").where("t or r")
    gone = want.join(stored.select(*key), key, "left_anti")
    found = F.col("seen").isNotNull()
    causes = F.array_compact(F.array(
        F.when(~found, "A: not in the text"), F.when(F.col("seen") % 2 == 1, "B: administrative line"),
        F.when(F.col("seen") % 4 > 1, "C: no choices"), F.when(found & F.col("r"), "D: reported although in the text"),
    ))
    return gone.select("doc_id", "number", F.coalesce("t", F.lit(False)).alias("in_text"), F.coalesce("r", F.lit(False)).alias("reported"), "context", causes.alias("causes"))


def cause_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("causes").alias("cause")).groupBy("cause").count()


def evidence(category, message):
    """What a judge is shown for a warning, by its category."""
    q = tx.quoted(message)
    return (
        F.when(category.startswith("밑줄"), F.concat(F.lit("밑줄 구절: "), q))
        .when(category.startswith("bracket"), F.concat(F.lit("범위: "), F.regexp_extract(message, r"(\[[A-E]\])", 1)))
        .when(category.startswith("img") | category.startswith("이미지"), F.concat(F.lit("그림: "), message))
        .otherwise(F.substring(message, 1, 200))
    )
