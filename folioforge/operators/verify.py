"""Verification of stored passages and questions against a second reading, and all corrections that follow, in one table.

Texts are compared as clean texts; range marks, underlines, boxes and pictures are places beside them (see standoff), so that text
corrections and new marks compose. A passage's corrections are arrays of its own row: matching is the only join, and nothing is
shuffled behind it. Python computes sequence-matcher ratios and blocks, one call a row.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx
from . import similarity as M, standoff as O
from .rows import added

CORRECTION = "struct<kind:string,field:string,message:string,original:string,corrected:string>"
# The labels of ranges, and signs that stand for them.
LABELS = "ABCDE"
LABEL_SIGNS, LABEL_OF_SIGN = "ⒶⒷⒸⒹⒺ@abcde", "ABCDEAABCDE"
PASSAGE_FIXED, STEM_FIXED, BOX_FIXED, RANGE_SAME, PASSAGE_BOX_SAME, BOX_SAME, PICTURE_SAME, SURE = 0.70, 0.80, 0.85, 0.7, 0.8, 0.85, 0.5, 0.75
CHOICES_SAME, CHOICE_OK, CHOICE_LIKE, CHOICE_JUNK = 0.35, 0.85, 0.6, 0.4


def correction(kind: Column | str, field: Column | str, message: Column, original: Column | None = None, corrected: Column | None = None) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else F.lit(None).cast("string") if c is None else c
    return F.struct(text(kind).alias("kind"), text(field).alias("field"), message.alias("message"), text(original).alias("original"), text(corrected).alias("corrected"))


def _some(*corrections: Column) -> Column:
    """The corrections that there are, as an array."""
    return F.array_compact(F.array(*corrections))


def _percent(ratio: Column) -> Column:
    return F.format_string("%.0f%%", ratio * 100)


def _given(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) > 0


# --- the second reading ---


def merged_passages(read: DataFrame) -> DataFrame:
    """Read passages of a document as they belong together: doc_id, read_id, question_range, text, box, underlines, ranges.

    read: doc_id, page_no, seq, question_range, text, box, underlines (array of strings), ranges (array of label, text). Pieces of one
    range are one passage, over all pages. A piece without a range continues the last one with a range if that stands on the
    same page, else it is a passage of its own. Texts are joined in order, those that the text so far holds left out.
    """
    norm = F.regexp_replace(F.regexp_replace(F.coalesce("question_range", F.lit("")), r"(?U)\s", ""), "[～∼〜\\-]", "~")
    order = Window.partitionBy("doc_id").orderBy("page_no", "seq")
    r = read.withColumn("r_", norm).withColumn("id_", F.struct("page_no", "seq"))
    last = F.last(F.when(F.col("r_") != "", F.struct("r_", "page_no")), ignorenulls=True).over(order)
    r = r.withColumn("last_", last)
    own = F.concat(F.lit("#"), F.col("page_no"), F.lit("."), F.col("seq"))
    r = r.withColumn("key_", F.when(F.col("r_") != "", F.col("r_")).when(F.col("last_.page_no") == F.col("page_no"), F.col("last_.r_")).otherwise(own))
    piece = F.struct("id_", (F.col("r_") != "").alias("named"), F.coalesce("text", F.lit("")).alias("text"), "box", "underlines", "ranges")
    g = r.groupBy("doc_id", "key_").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min("id_").alias("id_"), F.max("question_range").alias("question_range"))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("u"), F.array().cast("array<struct<label:string,text:string>>").alias("g"))

    def add(a: Column, p: Column) -> Column:
        new = (F.length(p["text"]) > 0) & ~F.contains(a["text"], p["text"])
        text = F.when(~new, a["text"]).when(F.length(a["text"]) == 0, p["text"]).otherwise(F.concat(a["text"], F.lit("\n"), p["text"]))
        marks = p["named"] | new
        more = lambda old, c, kind: F.when(marks, F.concat(old, F.coalesce(c.cast(kind), F.array().cast(kind)))).otherwise(old)
        return F.struct(text.alias("text"), more(a["u"], p["underlines"], "array<string>").alias("u"), more(a["g"], p["ranges"], "array<struct<label:string,text:string>>").alias("g"))

    boxes = F.filter(F.transform("p", lambda p: F.when(p["named"] | (F.size("p") == 1), p["box"])), _given)
    g = g.withColumn("m", F.aggregate("p", start, add))
    return g.select("doc_id", F.concat_ws(".", "id_.page_no", "id_.seq").alias("read_id"), "question_range", F.col("m.text").alias("text"), F.try_element_at(boxes, F.lit(1)).alias("box"), F.col("m.u").alias("underlines"), F.col("m.g").alias("ranges"))


# --- passages ---


def relabel(content: str | None) -> tuple[str | None, str]:
    """A text whose range marks have a label twice, with labels in order of their starts, and what changed."""
    text = content or ""
    starts = [(m.start(), m[1]) for m in re.finditer(r"\[([A-E]):START\]", text)]
    if len({x for _, x in starts}) == len(starts):
        return content, ""
    out, notes = list(text), []
    taken = set()
    for (at, old), new in zip(starts, LABELS, strict=False):
        if old == new:
            continue
        out[at + 1] = new  # labels are of one letter, so places stay
        end = next((m.start() for m in re.finditer(rf"\[{old}:END\]", text) if m.start() > at and m.start() not in taken), None)
        if end is not None:
            taken.add(end)
            out[end + 1] = new
        notes.append(f"[{old}]→[{new}]")
    return "".join(out), ", ".join(notes)


def _relabelled(content: str | None) -> dict:
    return dict(zip(("text", "note"), relabel(content), strict=True))


NAMED = T.StructType([T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])


def _text_correction(field: str, least: float) -> Column:
    """Of columns clean, other, like, changes and next: the correction of the text itself, or null."""
    ratio = F.col("like.ratio")
    fixed = correction("FIXED", field, F.concat(F.lit("텍스트 교정 (유사도 "), _percent(ratio), F.lit("): "), O.summary(F.col("changes"), F.col("base"), F.col("target"))), F.col("text_before"), F.col("text_after"))
    unsure = correction("WARNING", field, F.concat(F.lit("텍스트 불일치 (유사도 "), _percent(ratio), F.lit(") — 수동 확인 필요: "), O.summary(O.gaps(F.col("like.blocks"), F.col("base"), F.col("target")), F.col("base"), F.col("target"))), F.col("text_before"), F.col("other_text"))
    unlike = correction("SKIPPED", field, F.concat(F.lit("유사도 낮음("), _percent(ratio), F.lit(") — 자동 교정 건너뜀 (다른 지문과 혼동 가능성)")))
    made = F.col("text_after") != F.col("text_before")
    return (
        F.when((F.length("clean") == 0) | (F.length("other") == 0) | (F.col("clean") == F.col("other")), None)
        .when(ratio >= least, F.when(made, fixed)).when(ratio >= 0.5, F.when(F.col("like.bare") < least, unsure)).otherwise(unlike)
    )


def _compared(rows: DataFrame, text: str, other: str, least: float, references: bool = False) -> DataFrame:
    """rows with `clean` and `marks` of column `text` as they are after its correction by column `other`, and what led to it."""
    apart = rows.withColumn("apart", O.taken_apart(F.coalesce(F.col(text), F.lit("")))).withColumn("other", O.taken_apart(F.coalesce(F.col(other), F.lit("")))["clean"])
    apart = apart.withColumn("bare", O.taken_apart(tx.drop_header(F.coalesce(F.col(text), F.lit("")), keep_images=True))).withColumn("clean", F.col("apart.clean"))
    like = O.likeness(apart.withColumn("clean_headless", F.col("bare.clean")), "clean", "clean_headless", "other", references)
    # what is corrected: the text, or the text without its header where that is more alike
    headless = F.col("like.headless") & (F.col("like.ratio") >= least)
    like = like.withColumn("base", F.when(F.col("like.headless"), F.col("bare.clean")).otherwise(F.col("clean"))).withColumn("target", F.when(F.col("like.headless"), F.col("other_headless")).otherwise(F.col("other")))
    like = like.withColumn("kept", F.when(headless, F.col("bare.marks")).otherwise(F.col("apart.marks")))
    change = F.filter(O.gaps(F.col("like.blocks"), F.col("base"), F.col("target")), lambda g: O.trusted(g, F.col("base"), F.col("target"), F.col("kept")))
    like = like.withColumn("changes", F.when(F.col("like.ratio") >= least, change).otherwise(F.array().cast("array<struct<a0:int,a1:int,b0:int,b1:int>>")))
    like = like.withColumn("before", F.when(headless, F.col("base")).otherwise(F.col("clean")))
    like = like.withColumn("after", F.when(F.size("changes") > 0, O.patched(F.col("base"), F.col("target"), F.col("changes"))).otherwise(F.col("before")))
    like = like.withColumn("marks", O.carried(F.col("kept"), F.col("changes")))
    return like.withColumn("text_before", F.coalesce(F.col(text), F.lit(""))).withColumn("text_after", O.put_together(F.col("after"), F.col("marks"))).withColumn("other_text", F.col(other))


RANGES = "array<struct<label:string,text:string,there:boolean,inner:string,s:int,e:int>>"


def _ranges() -> Column:
    """Of columns after, marks, ranges, clips: what is known of each label that the reading has, the first of each label."""
    label = lambda g: F.translate(F.trim(g["label"]), LABEL_SIGNS, LABEL_OF_SIGN)
    flat = lambda c: tx.squeeze(c)
    clip = lambda x: F.try_element_at(F.filter("clips", lambda c: (c["label"] == x) & (F.length(flat(F.substring(c["text"], 1, 25))) > 0) & F.contains(flat(F.col("after")), flat(F.substring(c["text"], 1, 25)))), F.lit(1))["text"]
    at = lambda x, what: F.try_element_at(F.filter("marks", lambda m: m["mark"].startswith(F.concat(F.lit("["), x, F.lit(f":{what}]")))), F.lit(1))["at"]

    def known(g: Column, x: Column, text: Column, start: Column, end: Column) -> Column:
        inner = F.when(end > start, tx.strip(F.substring(F.col("after"), start + 1, end - start)))
        return O.let(O.place_of_range(F.col("after"), text), lambda span: F.struct(x.alias("label"), text.alias("text"), (start.isNotNull() & end.isNotNull()).alias("there"), inner.alias("inner"), span["s"].alias("s"), span["e"].alias("e")))

    own = lambda g, x: F.coalesce(F.nullif(tx.strip(g["text"]), F.lit("")), clip(x), F.lit(""))
    one = lambda g: O.let(label(g), lambda x: O.let(own(g, x), lambda t: O.let(at(x, "START"), lambda a: O.let(at(x, "END"), lambda b: known(g, x, t, a, b)))))
    first = F.filter("ranges", lambda g, i: label(g).rlike(f"^[{LABELS}]$") & ~F.exists(F.slice("ranges", 1, i), lambda h: label(h) == label(g)))
    return F.transform(first, one).cast(RANGES)


def _range_correction(g: Column, ratio: Column, pictures: Column) -> Column:
    """struct(fix, set) of one label: its correction, and whether its marks are to be put (anew) at s and e."""
    mark = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    field = mark("brackets.", g["label"])
    found, off = g["e"] > g["s"], ratio < RANGE_SAME
    moved = correction("FIXED", field, mark("[", g["label"], "] 범위 마커 위치 재조정 (기존 유사도 ", _percent(ratio), ")"), F.substring(g["inner"], 1, 80), F.substring(g["text"], 1, 80))
    differs = correction("WARNING", field, mark("[", g["label"], "] 범위 내 텍스트 불일치 — 수동 확인 필요"), F.substring(g["inner"], 1, 80), F.substring(g["text"], 1, 80))
    unknown = correction("WARNING", field, mark("PDF에 [", g["label"], "] 범위 존재하나 범위 내 텍스트 미확인 — 수동 삽입 필요"))
    put = correction("FIXED", field, mark("[", g["label"], "] 범위 마커 자동 삽입"), F.lit("(없음)"), mark("[", g["label"], ":START]...[", g["label"], ":END]"))
    endless = correction("WARNING", field, mark("[", g["label"], "] 시작 위치는 찾았으나 끝 위치 특정 불가 — 수동 삽입 필요"))
    lost = correction(F.when(pictures, "INFO").otherwise("WARNING"), field, F.when(pictures, mark("[", g["label"], "] 범위 내 텍스트를 지문에서 찾지 못했습니다 — 이미지 범위 가능성")).otherwise(mark("[", g["label"], "] 범위 내 텍스트를 지문에서 찾지 못했습니다 — 수동 확인 필요")), F.lit(""), F.substring(g["text"], 1, 30))
    fix = (
        F.when(g["there"], F.when(_given(g["text"]) & _given(g["inner"]) & off, F.when(found, moved).otherwise(differs)))
        .when(~_given(g["text"]), unknown).when(found, put).when(g["s"].isNotNull(), endless).otherwise(lost)
    )
    set_ = F.coalesce(found, F.lit(False)) & F.when(g["there"], _given(g["inner"]) & off).otherwise(_given(g["text"]))
    return F.struct(fix.alias("fix"), F.coalesce(set_, F.lit(False)).alias("set"), g["label"].alias("label"), g["s"].alias("s"), g["e"].alias("e"))


def confirmed(spans: list[str] | None, phrases: list[str] | None) -> list[bool] | None:
    """Whether each underlined span is among the phrases read: one holds the other's beginning, or they are alike; a span of several
    lines also if more than half of its lines are."""
    lead = re.compile(r"^[①-⑳ⓐ-ⓩ㉠-㉿]+\s*")
    norm = lambda s: " ".join(s.split())
    forms = lambda s: [x for x in dict.fromkeys([norm(s), norm(lead.sub("", s.strip()))]) if x]

    def like(a: str, b: str) -> bool:
        if a[:20] in b or b[:20] in a or (len(a) >= 5 and a[:10] in b) or (len(b) >= 5 and b[:10] in a):
            return True
        n = min(len(a), len(b), 50)
        return n >= 3 and difflib.SequenceMatcher(None, a[:n], b[:n]).ratio() >= (0.6 if n >= 20 else 0.7)

    def one(span: str, read: list[str]) -> bool:
        if len(span.strip()) < 2 or any(like(a, b) for a in forms(span) for p in read for b in forms(p)):
            return True
        lines = [x for x in map(norm, span.strip().split("\n")) if len(x) >= 4] if "\n" in span.strip() else []
        hit = sum(any(x[:10] in norm(p) or norm(p)[:10] in x for p in read) for x in lines)
        return bool(lines) and hit >= len(lines) // 2 + 1

    return None if spans is None else [one(x, phrases or []) for x in spans]


LINES = "array<struct<phrase:string,s:int,e:int,state:string>>"
# Signs that underlined texts are compared without, and what others become.
UNDERLINE_SIGNS = r"[　㈀-㋿①-⓿]"


def _lines() -> Column:
    """Of columns after, marks, underlines: each phrase with its place, or the state that it is in without one."""
    text = F.col("after")
    plain = lambda c: F.translate(tx.chain(c, (UNDERLINE_SIGNS, ""), (r"(?U)\s+", ""), ("…", "...")), "｣｢』『“”‘’·", "」「」「\"\"''·")
    opened = lambda at: F.size(F.filter("marks", lambda m: (m["mark"] == "<u>") & (m["at"] <= at))) > F.size(F.filter("marks", lambda m: (m["mark"] == "</u>") & (m["at"] <= at)))

    def state(p: Column, head: Column, solid: Column, at: Column, span: Column) -> Column:
        noise = (F.length(p) == 0) | tx.noise_underline(p) | tx.noise_mark(p)
        often = (F.length(solid) <= 4) & ((F.length(text) - F.length(F.replace(text, p, F.lit("")))) / F.length(p) > 1)
        there = F.exists("marks", lambda m: (m["mark"] == "<u>") & (F.substring(text, m["at"] + 1, F.length(head)) == head)) | F.coalesce(opened(at), F.lit(False))
        spaced = O.let(plain(p), lambda x: (F.length(x) > 0) & F.contains(plain(text), x))
        return F.when(noise | often, "noise").when(there, "there").when(span.isNotNull(), "put").when(F.length(solid) <= 5, "noise").when(spaced, "spaced").otherwise("lost")

    out = lambda p, span, s: F.struct(p.alias("phrase"), span["s"].alias("s"), span["e"].alias("e"), s.alias("state"))
    solid = lambda p: F.regexp_replace(p, F.lit(r"(?U)\s"), F.lit(""))
    known = lambda p, head: O.let(solid(p), lambda c: O.let(O.place_of_line(text, head)["s"], lambda at: O.let(O.place_of_line(text, p), lambda span: out(p, span, state(p, head, c, at, span)))))
    return F.transform("underlines", lambda u: O.let(tx.strip(u), lambda p: O.let(F.substring(p, 1, 20), lambda head: known(p, head)))).cast(LINES)


def _apart_lines(lines: Column) -> Column:
    """The lines to put, in order, without those that meet an earlier one."""
    put = F.filter(lines, lambda x: x["state"] == "put")
    start = F.array().cast(LINES)
    return F.aggregate(put, start, lambda a, x: F.when(F.exists(a, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), a).otherwise(F.concat(a, F.array(x))))


def _line_correction(x: Column) -> Column:
    head = F.substring(x["phrase"], 1, 40)
    text = _text_of(x)
    return (
        F.when(x["state"] == "put", correction("FIXED", "underlines", F.concat(F.lit("밑줄 <u> 태그 자동 삽입: '"), F.substring(text, 1, 40), F.lit("'")), text, F.concat(F.lit("<u>"), text, F.lit("</u>"))))
        .when(x["state"] == "spaced", correction("INFO", "underlines", F.concat(F.lit("PDF 밑줄 텍스트를 지문에서 찾지 못함(공백·특수문자 차이): '"), head, F.lit("'"))))
        .when(x["state"] == "lost", correction("WARNING", "underlines", F.concat(F.lit("PDF 밑줄 텍스트를 지문에서 찾지 못함: '"), head, F.lit("'"))))
    )


def _text_of(x: Column) -> Column:
    return F.substring(F.col("after"), x["s"] + 1, x["e"] - x["s"])


def _underlined() -> Column:
    """The underlined spans of a text that may be doubted: six characters or more, and no header or note."""
    close = lambda at: F.array_min(F.transform(F.filter("marks", lambda n: (n["mark"] == "</u>") & (n["at"] >= at)), lambda n: n["at"]))
    spans = F.transform(F.filter("marks", lambda m: m["mark"] == "<u>"), lambda m: tx.strip(F.substring(F.col("after"), m["at"] + 1, close(m["at"]) - m["at"])))
    return F.filter(spans, lambda s: (F.length(F.regexp_replace(s, F.lit(r"(?U)\s"), F.lit(""))) >= 6) & ~tx.noise_underline(s))


def _pictures(marks: Column, sign: str) -> Column:
    return F.filter(marks, lambda m: m["mark"].startswith(sign))


def _contexts(text: Column, pictures: Column) -> Column:
    """The 15 characters ahead of each picture."""
    return F.transform(pictures, lambda m: F.right(tx.squeeze(F.substring(text, F.greatest(m["at"] - 20, F.lit(0)) + 1, F.least(m["at"], F.lit(20)))), F.lit(15)))


def _picture_corrections(ratio: Column) -> Column:
    """Of columns pictures, signs, contexts: by their numbers, else by what stands ahead of each."""
    n, k = F.size("pictures"), F.size("signs")
    note = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    kind = (
        F.when((n == 0) & (k > 0), correction("WARNING", "images", note("Gemini가 [그림] ", k, "개를 감지했으나 JSON에 <img> 없음 — 이미지 삽입 누락 확인 필요")))
        .when((n > 0) & (k == 0), correction("INFO", "images", note("JSON에 <img> ", n, "개 존재하나 Gemini가 [그림]을 감지하지 못함 — 재추출 시 확인")))
        .when(n > k, correction("INFO", "images", note("이미지 개수 차이: JSON ", n, "개 > PDF ", k, "개 — Gemini 다중 페이지 분산 가능성")))
        .when(n < k, correction("WARNING", "images", note("이미지 개수 불일치: JSON ", n, "개 vs PDF ", k, "개 — 수동 확인 필요")))
    )
    pairs = F.zip_with("contexts", ratio, lambda c, r: F.struct(c.alias("c"), r.alias("r")))
    wrong = F.filter(F.transform(pairs, lambda p, i: F.when((F.length(p["c"]["a"]) > 0) & (F.length(p["c"]["b"]) > 0) & (p["r"] < PICTURE_SAME), correction("WARNING", "images", note("이미지 ", i + 1, "번 위치 불일치 — JSON: '...", p["c"]["a"], "[img]', PDF: '...", p["c"]["b"], "[그림]'")))), lambda x: x.isNotNull())
    return F.when(n == k, wrong).otherwise(_some(kind))


PAIRS = "array<struct<a:string,b:string>>"
RATIOS = T.ArrayType(T.DoubleType())


def verify_passages(stored: DataFrame, read: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """doc_id, passage_id, content (corrected), corrections (an array) of every stored passage.

    stored: doc_id, passage_id, question_range, content. read: pieces by page, see merged_passages(). clips: doc_id, label, text of the
    ranges that a page's layout gives, used where the reading has a label without its text. Corrections come in this order: labels
    twice, text, ranges, underlines, box, pictures. A passage that nothing read matches only has a warning; null texts are empty.
    """
    whole = merged_passages(read)
    found = M.match_passages(stored.select("doc_id", "passage_id", "question_range", F.coalesce("content", F.lit("")).alias("content")), whole.select("doc_id", "read_id", "question_range", "text"))
    rows = stored.select("doc_id", "passage_id", "content").join(found.select("doc_id", "passage_id", "read_id"), ["doc_id", "passage_id"], "left").join(whole.drop("question_range"), ["doc_id", "read_id"], "left")
    if clips is None:
        rows = rows.withColumn("clips", F.array().cast("array<struct<label:string,text:string>>"))
    else:
        rows = rows.join(clips.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "text"))).alias("clips")), "doc_id", "left").withColumn("clips", F.coalesce("clips", F.array().cast("array<struct<label:string,text:string>>")))

    rows = added(rows, "named", NAMED, _relabelled, "content").withColumn("content_", F.col("named.text"))
    rows = _compared(rows, "content_", "text", PASSAGE_FIXED)
    rows = rows.withColumn("range_", _ranges()).withColumn("line_", _lines()).withColumn("doubted", _underlined())
    signs = O.taken_apart(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("signs_", signs).withColumn("pictures", _pictures(F.col("marks"), "<img")).withColumn("signs", _pictures(F.col("signs_.marks"), "[그림]"))
    contexts = F.zip_with(_contexts(F.col("after"), F.col("pictures")), _contexts(F.col("signs_.clean"), F.col("signs")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("contexts", F.when(F.size("pictures") == F.size("signs"), contexts).otherwise(F.array().cast(PAIRS)))
    # the box of the text: what stands behind its sign, up to a numbered line
    box_at = F.try_element_at(F.filter("marks", lambda m: m["mark"] == "<보기>"), F.lit(1))["at"]
    behind = F.regexp_extract(F.substring(F.col("after"), box_at + 1, F.length("after")), r"(?s)^\s*(.*?)(?=\n\d+\.|\z)", 1)
    rows = rows.withColumn("box_now", F.when(box_at.isNotNull(), tx.strip(behind)))
    pairs = F.concat(
        F.transform("range_", lambda g: F.struct(F.when(g["there"] & _given(g["text"]), F.nullif(g["inner"], F.lit(""))).alias("a"), g["text"].alias("b"))),
        F.array(F.struct(F.when(_given(F.col("box")), F.col("box_now")).alias("a"), tx.strip(F.col("box")).alias("b"))),
        F.transform("contexts", lambda c: F.struct(F.nullif(c["a"], F.lit("")).alias("a"), F.nullif(c["b"], F.lit("")).alias("b"))),
    )
    rows = added(rows.withColumn("pairs_", pairs.cast(PAIRS)), "r", RATIOS, O.ratio_of_pairs, "pairs_").drop("pairs_")
    rows = added(rows, "sure", T.ArrayType(T.BooleanType()), confirmed, "doubted", "underlines")
    n = F.size("range_")
    rows = rows.withColumn("range_", F.zip_with("range_", F.slice("r", 1, n), lambda g, r: _range_correction(g, r, F.size("pictures") > 0)))
    put = F.filter("range_", lambda g: g["set"])
    rows = rows.withColumn("put", put).withColumn("line_put", _apart_lines(F.col("line_")))

    kept = F.filter("marks", lambda m: ~F.exists("put", lambda g: m["mark"].rlike(r"^\[[A-E]:") & (F.substring(m["mark"], 2, 1) == g["label"])))
    marks = F.concat(
        kept, F.transform("put", lambda g: O.mark(g["s"], O.OPEN_RANGE, 0, F.concat(F.lit("["), g["label"], F.lit(":START]\n")))), F.transform("put", lambda g: O.mark(g["e"], O.CLOSE_RANGE, 0, F.concat(F.lit("\n["), g["label"], F.lit(":END]")))),
        F.transform("line_put", lambda x: O.mark(x["s"], O.OPEN_LINE, 0, F.lit("<u>"))), F.transform("line_put", lambda x: O.mark(x["e"], O.CLOSE_LINE, 0, F.lit("</u>"))),
    )
    no_box = _given(F.col("box")) & F.col("box_now").isNull()
    content = F.concat(O.put_together(F.col("after"), marks.cast(O.MARKS)), F.when(no_box, F.concat(F.lit("\n<보기>\n"), F.col("box"))).otherwise(""))
    box_ratio = F.get("r", n)
    box = F.when(no_box, correction("FIXED", "bogi", F.lit("지문 내 <보기> 자동 추가"), F.lit("(없음)"), F.substring("box", 1, 60))).when(
        box_ratio < PASSAGE_BOX_SAME, correction("WARNING", "bogi", F.concat(F.lit("<보기> 내용 불일치 (유사도 "), _percent(box_ratio), F.lit(") — 수동 확인")), F.substring("box_now", 1, 80), F.substring("box", 1, 80))
    )
    twice = F.when(_given(F.col("named.note")), correction("FIXED", "brackets", F.concat(F.lit("중복 bracket 레이블 재할당: "), F.col("named.note")), F.substring(F.col("content"), 1, 40), F.substring(F.col("content_"), 1, 40)))
    doubt = F.filter(F.zip_with("doubted", "sure", lambda s, ok: F.when(~ok, correction("SKIPPED", "underlines", F.concat(F.lit("JSON의 <u> 태그가 PDF에서 미확인 (오탐 가능): '"), F.substring(s, 1, 40), F.lit("'"))))), lambda x: x.isNotNull())
    put_or_told = F.filter("line_", lambda x: (x["state"] != "put") | F.exists("line_put", lambda y: (y["phrase"] == x["phrase"]) & (y["s"] == x["s"])))
    lines = F.filter(F.transform(F.array_distinct(put_or_told), _line_correction), lambda x: x.isNotNull())
    doubt = F.when((F.size("underlines") > 0) & (F.col("like.plain") >= SURE), doubt).otherwise(F.array().cast(f"array<{CORRECTION}>"))
    all_ = F.concat(
        _some(twice, _text_correction("content", PASSAGE_FIXED)), F.filter(F.transform("range_", lambda g: g["fix"]), lambda x: x.isNotNull()), lines, doubt, _some(box), _picture_corrections(F.slice("r", n + 2, F.size("contexts"))),
    )
    lost = _some(correction("WARNING", "content", F.lit("대응하는 PDF 지문을 찾지 못했습니다. 수동 확인 필요")))
    matched = F.col("read_id").isNotNull()
    return rows.select("doc_id", "passage_id", F.when(matched, content).otherwise(F.col("content")).alias("content"), F.when(matched, all_).otherwise(lost).cast(f"array<{CORRECTION}>").alias("corrections"))


# --- questions ---


def clean_choice(choice: Column) -> Column:
    """A choice without its mark, and without what follows it from a picture, range mark or box on."""
    cut = tx.chain(choice, (r"(?s)\n{1,2}<img\b[^>]*>.*", ""), (r"(?s)\n{1,2}\[[A-E]:(?:START|END)\].*", ""), (r"(?s)\n{1,2}<보기>.*", ""))
    return tx.strip(tx.chain(tx.strip(cut), (r"^[①②③④⑤⑥⑦⑧⑨⑩]\s*", "")))


def trailing_junk(choice: Column) -> Column:
    return choice.rlike(r"\n{1,2}(<img\b|\[[A-E]:(?:START|END)\]|<보기>)")


CHOICES = "array<struct<k:string,now:string,read:string,a:string,b:string,junk:boolean>>"


def _choice_corrections() -> tuple[Column, Column]:
    """Of columns choices and pairs (with their ratios cr): the corrections, and the choices as they are after these."""
    both = F.zip_with("pairs", "cr", lambda p, r: F.struct(p.alias("p"), r.alias("r")))
    known = F.filter("cr", lambda r: r.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, r: a + r) / F.nullif(F.size(known), F.lit(0))
    field = lambda p: F.concat(F.lit("choices."), p["k"])
    said = lambda p, what: F.concat(F.lit("선택지 "), p["k"], F.lit("번 "), *what)

    def verdict(x: Column) -> Column:
        p, r = x["p"], x["r"]
        pct = _percent(r)
        return (
            F.when(r.isNull(), F.struct(correction("FIXED", field(p), said(p, [F.lit("추가")]), F.lit("(없음)"), F.substring(p["read"], 1, 60)).alias("fix"), p["read"].alias("v")))
            .when(r >= CHOICE_OK, F.struct(F.lit(None).cast(CORRECTION).alias("fix"), p["now"].alias("v")))
            .when(r >= CHOICE_LIKE, F.struct(correction("FIXED", field(p), said(p, [F.lit("교정 (유사도 "), pct, F.lit(")")]), F.substring(p["a"], 1, 60), F.substring(p["b"], 1, 60)).alias("fix"), p["read"].alias("v")))
            .when((r >= CHOICE_JUNK) & _given(p["a"]) & p["junk"], F.struct(correction("FIXED", field(p), said(p, [F.lit("후행 내용 제거 (유사도 "), pct, F.lit(")")]), F.substring(p["now"], 1, 60), F.substring(p["a"], 1, 60)).alias("fix"), p["a"].alias("v")))
            .otherwise(F.struct(correction("WARNING", field(p), said(p, [F.lit("불일치 (유사도 "), pct, F.lit(") — 수동 확인")]), F.substring(p["a"], 1, 80), F.substring(p["b"], 1, 80)).alias("fix"), p["now"].alias("v")))
        )

    judged = F.transform(both, lambda x: F.struct(x["p"]["k"].alias("k"), verdict(x).alias("o")))
    none = F.size(F.coalesce("choices", F.create_map().cast("map<string,string>"))) == 0
    skipped = F.col("stem_fix.kind") == "SKIPPED"
    pictured = none & ~F.coalesce("has_choices", F.lit(True))
    other = F.coalesce(mean < CHOICES_SAME, F.lit(False))
    fixes = (
        F.when(F.size("pairs") == 0, _nothing()).when(skipped, _some(correction("SKIPPED", "choices", F.lit("발문 유사도 낮음 → 선택지 검증 건너뜀"))))
        .when(pictured, _some(correction("SKIPPED", "choices", F.lit("이미지 선택지 문항 — 자동 검증 생략"))))
        .when(none, _some(correction("FIXED", "choices", F.lit("선택지 자동 추가 (JSON에 없었음)"))))
        .when(other, _some(correction("SKIPPED", "choices", F.concat(F.lit("선택지 전체 유사도 낮음 ("), _percent(mean), F.lit(") — PDF 문항 번호 불일치 가능성, 수동 확인")))))
        .otherwise(F.filter(F.transform(judged, lambda x: x["o"]["fix"]), lambda x: x.isNotNull()))
    )
    applies = ~F.coalesce(skipped, F.lit(False)) & ~pictured & ~other & (F.size("pairs") > 0)
    new = F.map_from_entries(F.transform(judged, lambda x: F.struct(x["k"].alias("key"), x["o"]["v"].alias("value"))))
    old = F.coalesce("choices", F.create_map().cast("map<string,string>"))
    after = F.when(applies, F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)).otherwise(F.col("choices"))
    return fixes, after


def _nothing() -> Column:
    return F.array().cast(f"array<{CORRECTION}>")


def verify_questions(stored: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id, number, stem, bogi, choices (corrected) and corrections (an array) of every stored question.

    stored: doc_id, number, stem, bogi, choices (a map), has_choices. read: doc_id, number, stem, box, choices, one row a number (see
    segment.merge_extracts). A question meets the read one of its number, else of the most alike stem of its document; corrections
    come in the order stem, choices, box. Null texts and maps count as empty; a stem without letters is only INFO when lost.
    """
    found = M.match_questions(stored, read)
    r = read.select("doc_id", F.col("number").alias("read_number"), F.col("stem").alias("r_stem"), F.col("box").alias("r_box"), F.col("choices").alias("r_choices"))
    rows = stored.join(found.select("doc_id", "number", "read_number"), ["doc_id", "number"], "left").join(r, ["doc_id", "read_number"], "left")
    rows = _compared(rows, "stem", "r_stem", STEM_FIXED, references=True).withColumn("stem_fix", _text_correction("stem", STEM_FIXED))
    rows = rows.withColumn("stem_now", F.when(F.col("stem_fix.kind") == "FIXED", F.col("text_after")).otherwise(F.col("stem")))
    rows = rows.select("doc_id", "number", "read_number", "stem", "stem_now", "stem_fix", "bogi", "choices", "has_choices", "r_choices", "r_box")
    entries = F.array_sort(F.map_entries(F.coalesce("r_choices", F.create_map().cast("map<string,string>"))))
    now = lambda k: F.nullif(F.try_element_at(F.coalesce("choices", F.create_map().cast("map<string,string>")), k), F.lit(""))
    pair = lambda e: F.struct(e["key"].alias("k"), now(e["key"]).alias("now"), e["value"].alias("read"), clean_choice(now(e["key"])).alias("a"), clean_choice(e["value"]).alias("b"), trailing_junk(now(e["key"])).alias("junk"))
    rows = added(rows.withColumn("pairs", F.transform(entries, pair).cast(CHOICES)), "cr", RATIOS, O.ratio_of_pairs, "pairs")
    fixes, choices = _choice_corrections()
    rows = rows.withColumn("choice_fixes", fixes).withColumn("choices_now", choices).withColumn("bogi_", tx.strip(F.coalesce("bogi", F.lit("")))).withColumn("box_", tx.strip(F.coalesce("r_box", F.lit(""))))
    rows = _compared(rows.drop("stem_before"), "bogi_", "box_", BOX_FIXED)
    new_box = correction("FIXED", "bogi", F.lit("문항 <보기> 자동 추가"), F.lit("(없음)"), F.substring("box_", 1, 60))
    box = F.when(~_given(F.col("box_")), None).when(~_given(F.col("bogi_")), new_box).when(F.col("like.plain") < BOX_SAME, _text_correction("bogi", BOX_FIXED))
    bogi = F.when(box["kind"] == "FIXED", F.when(_given(F.col("bogi_")), F.col("text_after")).otherwise(F.col("box_"))).otherwise(F.col("bogi"))
    short = F.length(F.regexp_replace(F.coalesce("stem", F.lit("")), F.lit(r"(?U)\s"), F.lit(""))) <= 5
    lost = _some(correction(F.when(short, "INFO").otherwise("WARNING"), "stem", F.when(short, "PDF에서 해당 문항을 찾지 못했습니다. stem 부족으로 PDF 비교 불가").otherwise("PDF에서 해당 문항을 찾지 못했습니다. 수동 확인 필요")))
    matched = F.col("read_number").isNotNull()
    all_ = F.concat(_some(F.col("stem_fix")), F.col("choice_fixes"), _some(box))
    pick = lambda new, old: F.when(matched, new).otherwise(F.col(old)).alias(old)
    return rows.select("doc_id", "number", pick(F.col("stem_now"), "stem"), pick(bogi, "bogi"), pick(F.col("choices_now"), "choices"), F.when(matched, all_).otherwise(lost).cast(f"array<{CORRECTION}>").alias("corrections"))


def corrections(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """doc_id, location, seq, kind, field, message, original, corrected: the one table of all corrections of verified passages and
    questions; seq is a correction's place among those of its location."""
    of = lambda rows, name, key: rows.select("doc_id", F.concat(F.lit(name), F.col(key).cast("string")).alias("location"), F.posexplode("corrections").alias("seq", "c")).select("doc_id", "location", "seq", "c.*")
    return of(passages, "지문", "passage_id").unionByName(of(questions, "문항", "number"))
