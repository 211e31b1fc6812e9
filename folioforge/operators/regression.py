"""Quality regression: categorised, fingerprinted warnings of two snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, text as tx
from .joins import anti_both_ways

# Page header words that must not stand in answers, and a header pair in underlined text.
HEADER = "국어영역|고3|고등학교|홀수형|짝수형|이 문제지에 관한 저작권"
HEADER_PAIR = r"<u>[^<]*국어영역[^<]*</u>\s*<u>[^<]*고3?[^<]*</u>|<u>[^<]*고3?[^<]*</u>\s*<u>[^<]*국어영역[^<]*</u>"


def snapshot(warnings: DataFrame, category: Column | None = None) -> DataFrame:
    """Warnings (filename, location, message) with category and fingerprint, one row for each fingerprint of a file."""
    cat = classify.message_category(F.col("message")) if category is None else category
    rows = warnings.select("filename", "location", "message", cat.alias("category"), tx.fingerprint(F.col("filename"), F.col("location"), F.col("message")).alias("fingerprint"))
    return rows.dropDuplicates(["filename", "fingerprint"])


def counts(snap: DataFrame) -> DataFrame:
    """Warnings by file and category, by file (category ALL), and in all."""
    out = snap.rollup("filename", "category").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("filename", F.lit("ALL")).alias("filename"), F.coalesce("category", F.lit("ALL")).alias("category"), "n")


def changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Fingerprints of a file that are new or gone."""
    keys = ["filename", "fingerprint"]
    return anti_both_ways(current.select(*keys, "category"), baseline.select(*keys, "category"), keys)


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each file of either snapshot: totals, delta, new and gone fingerprints, and its status."""
    total = lambda d, name: d.groupBy("filename").agg(F.count(F.lit(1)).alias(name))
    moved = changes(current, baseline).groupBy("filename").agg(F.count_if(F.col("change") == "new").alias("n_new"), F.count_if(F.col("change") == "gone").alias("n_gone"))
    out = total(current, "now").join(total(baseline, "before"), "filename", "full_outer").join(moved, "filename", "left")
    delta = F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))
    status = F.when(F.col("before").isNull(), "NEW").when(F.col("now").isNull(), "REMOVED").otherwise(classify.severity_of_change(F.col("before"), F.col("now")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("filename", zero("before"), zero("now"), delta.cast("long").alias("delta"), zero("n_new"), zero("n_gone"), status.alias("status"))


def bleed_in(choices: Column) -> Column:
    """Number of choices with a header word in them."""
    return F.size(F.filter(choices, lambda c: c.rlike(HEADER)))


def bleed_in_passage(content: Column) -> Column:
    return F.regexp_count(content, F.lit(HEADER_PAIR))


def assert_segments(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings FAIL or WARN per file and question: (filename, number, severity, reason).

    Both sides: filename, number, stem_length, choices_count. A question that is gone, a stem that fell under five
    characters, or fewer choices fail; a stem whose length changed by half or more warns.
    """
    b = baseline.select("filename", "number", F.col("stem_length").alias("b_stem"), F.col("choices_count").alias("b_choices"))
    both = b.join(current.select("filename", "number", "stem_length", "choices_count"), ["filename", "number"], "full_outer")
    fail = (
        F.when(F.col("stem_length").isNull(), "question lost")
        .when((F.col("b_stem") > 5) & (F.col("stem_length") < 5), "stem emptied")
        .when(F.col("choices_count") < F.col("b_choices"), "choices lost")
    )
    warn = F.when((F.col("b_stem") > 0) & (F.abs(F.col("stem_length") - F.col("b_stem")) >= 0.5 * F.col("b_stem")), "stem length")
    out = both.where("b_stem is not null").withColumn("reason", F.coalesce(fail, warn))
    return out.where("reason is not null").select("filename", "number", F.when(fail.isNotNull(), "FAIL").otherwise("WARN").alias("severity"), "reason")
