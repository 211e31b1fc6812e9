"""The whole job of a set of documents: segments, repair, validation, verification, answers, and a status from the log of stages.

Nothing is updated in place. Each stage is a table by document; what a job has gone through is a log of events, and its status is
the last of them, in a batch or in a stream of events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import correct as C, segment as S, verify as V
from .rows import kept

# The statuses of a job, in order, and those it may end with.
ANALYZING, VISION, SEGMENTING, QA, TAGGING, VERIFYING, ANSWERS = "analyzing", "vision", "segmenting", "qa_checking", "tagging", "verifying", "parsing answers"
REVIEWING, PATCHED, ATTENTION, ERROR = "reviewing", "reviewing (auto-patched)", "needs_attention", "error"

PIECES = "doc_id string, page_no int, seq int, question_range string, text string, box string, underlines array<string>, ranges array<struct<label:string,text:string>>"
QUESTIONS = "doc_id string, number int, stem string, box string, choices map<string,string>"
KEY = "doc_id string, number int, answer int, explanation string"
STRUCTURE = "doc_id string, phrases array<string>, ranges array<struct<label:string,start:string,end:string>>"


@dataclass
class Job:
    """passages: doc_id, passage_id, question_range, content. questions: doc_id, number, passage_idx, stem, bogi, choices, answer,
    explanation. corrections: see verify.corrections; those of passages are in their content, those of questions are for a reviewer. events: doc_id, seq, status. summary: a row a document."""

    passages: DataFrame
    questions: DataFrame
    corrections: DataFrame
    events: DataFrame
    summary: DataFrame


def _event(seq: int, status: str | Column, happened: Column) -> Column:
    text = F.lit(status) if isinstance(status, str) else status
    return F.when(happened, F.struct(F.lit(seq).alias("seq"), text.alias("status")))


def event_log(results: DataFrame) -> DataFrame:
    """(doc_id, seq, status): what each job has gone through. results: doc_id, readable, structured, verified, keyed, patched, passed. A
    text that can't be read ends in an error; a job that doesn't pass needs attention, patched or not."""
    ok = F.col("readable")
    end = F.when(~F.col("passed"), ATTENTION).when(F.col("patched"), PATCHED).otherwise(REVIEWING)
    events = F.array(
        _event(0, ANALYZING, F.lit(True)), _event(1, ERROR, ~ok), _event(1, VISION, ok & F.col("structured")), _event(2, SEGMENTING, ok), _event(3, QA, ok), _event(4, TAGGING, ok),
        _event(5, VERIFYING, ok & F.col("verified")), _event(6, ANSWERS, ok & F.col("keyed")), _event(7, end, ok),
    )
    return results.select("doc_id", F.explode(F.array_compact(events)).alias("e")).select("doc_id", "e.*")


def status_of(events: DataFrame) -> DataFrame:
    """(doc_id, status): the last event of each job, of a table or of a stream of them (then in update mode); events that come late
    or twice change nothing."""
    return events.groupBy("doc_id").agg(F.max(F.struct("seq", "status")).alias("last")).select("doc_id", F.col("last.status").alias("status"))


def _present(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("doc_id").distinct().withColumn(name, F.lit(True))


def run(docs: DataFrame, pieces: DataFrame, questions: DataFrame, answers: DataFrame, structure: DataFrame | None = None, clips: DataFrame | None = None) -> Job:
    """The job of docs (doc_id, text): marks of the page structure are put into the text, it is segmented, repaired by its own
    text, validated, verified by a second reading (pieces of passages, questions) and given its answers.

    See PIECES, QUESTIONS, KEY and STRUCTURE for the tables. A document that a table doesn't have skips that stage. Of answers of one
    number the first counts by its text. A null text has no passages and no questions, and its job ends in an error; ids are
    unique in docs. Empty tables give empty tables.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    raw = docs
    if structure is not None:
        raw = C.structured(docs.join(structure.select("doc_id", "phrases", "ranges"), "doc_id", "left")).select("doc_id", "text")
    cut = kept(S.segment_documents(raw))
    mended = S.patch_documents(cut, raw)
    whole = kept(S.finished(cut.drop("questions").join(mended, "doc_id")))
    stats = S.issue_stats(whole, S.issues(whole))

    stored = whole.select("doc_id", F.posexplode("passages").alias("idx", "p")).select("doc_id", "idx", F.col("p.id").alias("passage_id"), "p.question_range", "p.content")
    asked = whole.select("doc_id", F.explode("questions").alias("q")).select("doc_id", "q.number", "q.stem", "q.bogi", "q.choices", "q.has_choices")
    seen_p, seen_q = _present(pieces, "there"), _present(questions, "there")
    checked = kept(V.verify_passages(stored.join(seen_p, "doc_id", "left_semi").drop("idx"), pieces, clips))
    answered = kept(V.verify_questions(asked.join(seen_q, "doc_id", "left_semi"), questions))
    fixes = V.corrections(checked, answered)

    passages = stored.join(checked.select("doc_id", "passage_id", F.col("content").alias("better")), ["doc_id", "passage_id"], "left").select("doc_id", "passage_id", "question_range", F.coalesce("better", "content").alias("content"))
    key = answers.groupBy("doc_id", "number").agg(F.min(F.struct("answer", "explanation")).alias("k"))
    belongs = S.attach_passages(whole)
    done = asked.join(belongs, ["doc_id", "number"], "left").join(key, ["doc_id", "number"], "left")
    done = done.select("doc_id", "number", "passage_idx", "stem", "bogi", "choices", F.col("k.answer").alias("answer"), F.nullif(F.col("k.explanation"), F.lit("")).alias("explanation"))

    n_patched = F.size(F.filter("patch_log", lambda x: x["patched"])).alias("n_patched")
    size = whole.select("doc_id", F.size("passages").alias("n_passages"), n_patched).join(stats, "doc_id")
    size = size.join(docs.select("doc_id", F.col("text").isNotNull().alias("readable")), "doc_id")
    verified = _present(pieces.select("doc_id").unionByName(questions.select("doc_id")), "verified")
    flags = size.join(verified, "doc_id", "left").join(_present(answers, "keyed"), "doc_id", "left")
    flags = flags.join(_present(structure, "structured"), "doc_id", "left") if structure is not None else flags.withColumn("structured", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    events = event_log(flags.select("doc_id", "readable", yes("structured"), yes("verified"), yes("keyed"), (F.col("n_patched") > 0).alias("patched"), "passed"))

    count = fixes.groupBy("doc_id").agg(F.count_if(F.col("kind") == "FIXED").alias("fixed"), F.count_if(F.col("kind") == "WARNING").alias("open"))
    given = done.groupBy("doc_id").agg(F.count("answer").alias("n_answers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    summary = size.join(count, "doc_id", "left").join(given, "doc_id", "left").join(status_of(events), "doc_id", "left").select(
        "doc_id", "status", "n_passages", F.col("question_count").alias("n_questions"), "n_patched", F.col("issue_count").alias("n_issues"), "passed", zero("fixed"), zero("open"), zero("n_answers"),
    )
    return Job(passages, done, fixes, events, summary)
