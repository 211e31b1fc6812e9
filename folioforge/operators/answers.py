"""Answer tables and explanations of exam keys, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import classify, text as tx
from ..sources.versions import Versioned

# Section heads, rows with a head, and rows of two lines each.
SECTION = r"■\s*\[(?:공통|선택)\s*:\s*([^\]]+)\]"
ROW = r"(\d{1,2})\.\s+([①②③④⑤])"
PAIR = r"(?m)^(\d{1,2})\n([①②③④⑤])$"


def _pairs(block, pattern: str):
    return F.arrays_zip(F.regexp_extract_all(block, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(block, F.lit(pattern), 2).alias("a"))


def _behind(text: str, head: str):
    """What stands behind each head, up to the next."""
    return F.filter(F.split(text, head), lambda _, i: i > 0)


def answer_table(docs: DataFrame) -> DataFrame:
    """(doc_id, subject, number, answer) of texts with section heads, or of texts in which numbers and answers take turns.

    With heads, the text is split at them and each block's rows are its section's. Without, a section starts where its name
    first stands; the nearest one before a row counts, and 공통 before all. Numbers are 1 to 45; the first row of a number
    in a section stands.
    """
    headed = docs.where(F.col("text").rlike(SECTION))
    blocks = F.arrays_zip(F.regexp_extract_all("text", F.lit(SECTION), 1).alias("label"), _behind("text", SECTION).alias("body"))
    a = headed.select("doc_id", F.posexplode(blocks).alias("s", "b")).select("doc_id", "s", classify.subject_track(F.col("b.label")).alias("subject"), F.posexplode(_pairs(F.col("b.body"), ROW)).alias("pos", "r"))
    plain = docs.where(~F.col("text").rlike(SECTION))
    # name each section's start in the text, so that rows and starts come out of one split in order
    named = tx.chain(F.col("text"), (r"(?m)^(\d{1,2})\n([①②③④⑤])$", "\u0001$1|$2\u0001"), (r"화법과\s*작문", "\u0001#화법과작문\u0001"), (r"언어와\s*매체", "\u0001#언어와매체\u0001"))
    parts = plain.select("doc_id", F.posexplode(F.split(named, "\u0001")).alias("pos", "t")).where(F.col("t").rlike(r"^(#.*|\d{1,2}\|[①②③④⑤])$"))
    first = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("pos"))
    head = F.when(F.col("t").startswith("#") & (first == 1), F.substring("t", 2, 20))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = parts.withColumn("head", head).withColumn("subject", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("공통"))).where(~F.col("t").startswith("#"))
    b = b.select("doc_id", F.lit(0).alias("s"), "subject", "pos", F.struct(F.split_part("t", F.lit("|"), F.lit(1)).alias("n"), F.split_part("t", F.lit("|"), F.lit(2)).alias("a")).alias("r"))
    rows = a.unionByName(b).select("doc_id", "subject", F.col("r.n").cast("int").alias("number"), tx.circled(F.col("r.a")).alias("answer"), "s", "pos").where("number between 1 and 45")
    w = Window.partitionBy("doc_id", "subject", "number").orderBy("s", "pos")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "s", "pos")


def passage_heads(docs: DataFrame) -> DataFrame:
    """(doc_id, range_start, range_end, domain) of range headers in an explanation text."""
    pattern = r"\[(\d{1,2})\s*[~～]\s*(\d{1,2})\]\s+(독서|문학|화법과 작문|언어와 매체|화법|작문|언어|매체)"
    parts = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), k).alias(n) for k, n in ((1, "s"), (2, "e"), (3, "d"))))
    return docs.select("doc_id", F.explode(parts).alias("p")).select("doc_id", F.col("p.s").cast("int").alias("range_start"), F.col("p.e").cast("int").alias("range_end"), F.col("p.d").alias("domain"))


def explanations(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, number, correct_answer, explanation, wrong_answers): blocks that begin with `N. 정답` or `N번`."""
    head = r"(?m)^\s*(\d{1,2})\s*(?:번|[.．])\s*(?:정답\s*[:：]?\s*)?([①②③④⑤])"
    blocks = F.arrays_zip(F.regexp_extract_all("text", F.lit(head), 1).alias("n"), F.regexp_extract_all("text", F.lit(head), 2).alias("a"), _behind("text", head).alias("body"))
    rows = docs.select("doc_id", F.posexplode(blocks).alias("pos", "b"))
    wrong = r"(?m)^\s*([①②③④⑤])\s*([^\n①②③④⑤]+)"
    entries = F.arrays_zip(F.regexp_extract_all("b.body", F.lit(wrong), 1).alias("m"), F.regexp_extract_all("b.body", F.lit(wrong), 2).alias("t"))
    pairs = F.transform(entries, lambda e: F.struct(F.instr(F.lit(tx.CIRCLED), e["m"]).alias("k"), F.trim(e["t"]).alias("v")))
    return rows.select("doc_id", "pos", F.col("b.n").cast("int").alias("number"), tx.circled(F.col("b.a")).alias("correct_answer"), tx.strip(F.regexp_replace("b.body", F.lit(r"(?s)\n\s*[①②③④⑤].*$"), F.lit(""))).alias("explanation"), F.to_json(F.map_from_entries(F.filter(pairs, lambda p: p["k"] > 0))).alias("wrong_answers"))


ANSWERS = "doc_id string, subject string, number int, answer int, explanation string, wrong_answers string, domain string"
ANSWER_KEY = ["doc_id", "subject", "number"]


def answer_rows(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """ANSWERS of answer keys and of explanation texts (both doc_id, text): the answer of the key, else of the explanation; the domain
    of the first range header that holds the number. Explanations belong to the subject whose key has the number, the first by
    name of several, and to 공통 without one."""
    key = answer_table(keys).withColumn("doc_id", F.col("doc_id").cast("string"))
    e = explanations(texts).withColumn("doc_id", F.col("doc_id").cast("string"))
    said = e.groupBy("doc_id", "number").agg(F.min_by(F.struct("correct_answer", "explanation", "wrong_answers"), "pos").alias("e"))
    of = key.groupBy("doc_id", "number").agg(F.min("subject").alias("of"))
    said = said.join(of, ["doc_id", "number"], "left").select("doc_id", F.coalesce("of", F.lit("공통")).alias("subject"), "number", "e")
    heads = passage_heads(texts).withColumn("doc_id", F.col("doc_id").cast("string"))
    both = key.join(said, ANSWER_KEY, "full")
    h = heads.alias("h")
    held = both.alias("b").join(h, (F.col("b.doc_id") == F.col("h.doc_id")) & F.col("b.number").between(F.col("h.range_start"), F.col("h.range_end")), "left")
    domain = held.groupBy(*(F.col(f"b.{k}") for k in ANSWER_KEY)).agg(F.min_by("h.domain", "h.range_start").alias("domain"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return both.join(domain, ANSWER_KEY, "left").select(
        *ANSWER_KEY, F.coalesce("answer", "e.correct_answer").cast("int").alias("answer"), blank("e.explanation").alias("explanation"), F.nullif(F.col("e.wrong_answers"), F.lit("{}")).alias("wrong_answers"), "domain",
    )


def store_answers(keys: DataFrame, texts: DataFrame, table: Versioned) -> int:
    """The answers merged into their table: rows of known keys are updated where something new is known, others are put in. Running
    it again makes no new version."""
    return table.merge(answer_rows(keys, texts))
