"""Anchors, underlines, labelled ranges and picture places of single texts, and which corrections are accepted."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from . import similarity as M
from .rows import added

def anchor(text: str | None, phrase: str | None) -> int:
    """Place of a phrase in a text, or -1: as it is, with any white space between its parts, without a leading quote, and at
    last with anything but letters between its first 20 characters."""
    if not text or not (p := (phrase or "").strip()):
        return -1
    bare = p.lstrip("\"'“‘「『")
    loose = lambda s: r"\s*".join(map(re.escape, s.split()))
    chars = [c for c in bare if not c.isspace()][:20]
    patterns = [re.escape(p), loose(p), loose(bare) if bare else None, r"[\W_]*".join(map(re.escape, chars)) if len(chars) >= 6 else None]
    for pattern in filter(None, patterns):
        if m := re.search(pattern, text):
            return m.start()
    return -1


@F.pandas_udf(T.IntegerType())
def find_anchor(text: pd.Series, phrase: pd.Series) -> pd.Series:
    return text.combine(phrase, anchor)


def loosely(phrase: str, most: int) -> re.Pattern | None:
    """A pattern of the first `most` characters of a phrase, with any white space between its words."""
    words = phrase.strip()[:most].split()
    return re.compile(r"\s+".join(map(re.escape, words))) if words else None


def underline(text: str | None, phrases: list[str] | None) -> str | None:
    """Text with <u> around the first place of each phrase (its first 25 characters, with any white space) that isn't underlined yet,
    which its first 10 characters tell."""
    for p in phrases if phrases is not None else []:
        p = (p or "").strip()
        if not text or len(p) < 2 or re.search(rf"<u>[^<]*{re.escape(p[:10])}[^<]*</u>", text):
            continue
        if m := loosely(p, 25).search(text):
            text = f"{text[: m.start()]}<u>{m[0]}</u>{text[m.end() :]}"
    return text


@F.pandas_udf(T.StringType())
def underlined(text: pd.Series, phrases: pd.Series) -> pd.Series:
    return text.combine(phrases, underline)


def underline_state(text: Column, phrase: Column, similarity: Column) -> Column:
    """CONFIRMED if the phrase stands in an underlined part or is like one, MISSING if only in the text, else ABSENT."""
    bare = tx.drop_tags(text)
    return F.when(text.contains(F.concat(F.lit("<u>"), phrase)) | (similarity >= 0.7), "CONFIRMED").when(bare.contains(phrase), "MISSING").otherwise("ABSENT")


def page_underlines(passages: DataFrame, marks: DataFrame) -> DataFrame:
    """Underlines (doc_id, page_no, phrase) of the passages (doc_id, page_no, passage_id, content) they stand in, by the whole
    phrase, or by its first 15 characters if it has eight or more."""
    p, m = passages.alias("p"), marks.alias("m")
    head = F.substring("m.phrase", 1, 15)
    stands = F.col("p.content").contains(F.col("m.phrase")) | ((F.length("m.phrase") >= 8) & F.col("p.content").contains(head))
    return p.join(m, (F.col("p.doc_id") == F.col("m.doc_id")) & (F.col("p.page_no") == F.col("m.page_no")) & stands).select("p.doc_id", "p.passage_id", "m.phrase")


def accept(corrections: DataFrame) -> DataFrame:
    """Corrections with the reason to refuse them, if there is one."""
    return corrections.withColumn("refused", F.when(F.col("corrected").isNotNull(), tx.acceptance(F.col("original"), F.col("corrected"))))


LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def free_labels(used: list[str], proposed: list[str], set_: list[bool] | None = None) -> list[str | None]:
    """The label each range gets, in order: the one proposed if none has it yet, else the first that is free, else none. What is no
    letter counts as A. A label is taken once its range is set; set_ tells which are (all without it)."""
    taken, out = set(used), []
    for k, p in enumerate(proposed):
        want = (p or "").strip().upper()[:1]
        want = want if want and want in LABELS else "A"
        got = want if want not in taken else next((c for c in LABELS if c not in taken), None)
        if set_ is None or set_[k]:
            taken.add(got)
        out.append(got)
    return out


def label_ranges(ranges: DataFrame, used: DataFrame) -> DataFrame:
    """ranges (doc_id, pos, label, and perhaps `found`: whether the range is in the text) with `actual`, null for a range that isn't;
    used has doc_id and labels, those that a text has already. A document's ranges are gone through in order, by one small list."""
    found = F.coalesce("found", F.lit(False)) if "found" in ranges.columns else F.lit(True)
    rows = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", found.alias("found")))).alias("r")).join(used, "doc_id", "left")

    def actual(r: list[dict], own: list[str] | None) -> list[str | None]:
        there = [x["found"] for x in r]
        return [g if ok else None for g, ok in zip(free_labels(own or [], [x["label"] for x in r], there), there, strict=True)]

    named = added(rows, "a", T.ArrayType(T.StringType()), actual, "r", "labels")
    return named.select("doc_id", F.explode(F.arrays_zip("r", "a")).alias("z")).select("doc_id", "z.r.pos", "z.r.label", F.col("z.a").alias("actual"))


#: Choice marks up to so many characters apart are one zone, which reaches so far behind the last.
ZONE_GAP, ZONE_TAIL = 800, 100


def choice_zones(text: str) -> list[tuple[int, int]]:
    zones: list[list[int]] = []
    for m in re.finditer("[①②③④⑤]", text):
        if zones and m.start() - zones[-1][1] <= ZONE_GAP:
            zones[-1][1] = m.start()
        else:
            zones.append([m.start(), m.start()])
    return [(a, b + ZONE_TAIL) for a, b in zones]


def range_span(text: str | None, start: str | None, end: str | None, zones: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The span from the first place of `start` (20 characters) to the end of the first place of `end` (its last 20), white space
    loosely; none if either isn't there, or the span is empty, meets a zone, or is more than half of the text."""
    a, b = loosely(start or "", 20), loosely((end or "").strip()[-20:], 20)
    x, y = (p.search(text or "") if p else None for p in (a, b))
    if not x or not y or x.start() >= y.end():
        return None
    span = x.start(), y.end()
    meets = any(p < span[1] and span[0] < q for p, q in zones)
    return None if meets or span[1] - span[0] > len(text) * 0.5 else span


def mark_ranges(text: str | None, ranges: list[dict] | None) -> str | None:
    """text with the marks of each labelled range (label, start, end) whose span is found, in order; zones are those of the text
    as it came."""
    if not text:
        return text
    zones, used = choice_zones(text), set(re.findall(r"\[([A-Z]):START\]", text))
    for r in ranges if ranges is not None else []:
        (name,), span = free_labels(sorted(used), [r["label"]]), range_span(text, r["start"], r["end"], zones)
        if name and span:
            a, b = span
            text = f"{text[:a]}[{name}:START]\n{text[a:b]}\n[{name}:END]{text[b:]}"
            used.add(name)
    return text


def structured(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, phrases, ranges: array of label, start, end) with underlines, then range marks, put into the text."""
    put = lambda text, phrases, ranges: mark_ranges(underline(text, phrases), ranges)
    return added(rows, "text_", T.StringType(), put, "text", "phrases", "ranges").withColumn("text", F.col("text_")).drop("text_")


def image_places(stored: DataFrame, read: DataFrame) -> DataFrame:
    """(doc_id, passage_id, n, before, read_before, similarity) of pictures whose context, the 15 characters before them, differs:
    stored has <img> tags in content, read has [그림] signs in text; both have doc_id and passage_id. Passages with different
    numbers of pictures are image_verdict's."""
    cut = lambda c, sign: F.transform(F.slice(F.split(tx.unify_marks(c), sign), 1, F.greatest(F.size(F.split(c, sign)) - 1, F.lit(0))), lambda p: F.right(tx.squeeze(F.right(p, F.lit(20))), F.lit(15)))
    a, b = cut(F.col("content"), r"<img\b[^>]*/?\s*>"), cut(F.col("text"), r"\[그림\]")
    both = stored.select("doc_id", "passage_id", a.alias("a")).join(read.select("doc_id", "passage_id", b.alias("b")), ["doc_id", "passage_id"]).where(F.size("a") == F.size("b"))
    each = both.select("doc_id", "passage_id", F.posexplode(F.arrays_zip("a", "b")).alias("n", "z")).where("z.a <> '' and z.b <> ''")
    return each.select("doc_id", "passage_id", (F.col("n") + 1).alias("n"), F.col("z.a").alias("before"), F.col("z.b").alias("read_before"), M.seq_ratio(F.col("z.a"), F.col("z.b")).alias("similarity")).where("similarity < 0.5")


def tiered_ratio(stored: Column, read: Column) -> Column:
    """The greatest ratio of two texts as they are, without passage headers, and in the form for comparison of either."""
    bare = lambda c: tx.squeeze(tx.drop_structure(c))
    forms = [bare, lambda c: bare(tx.drop_header(c)), lambda c: tx.comparable(bare(c)), lambda c: tx.comparable(bare(tx.drop_header(c)))]
    return F.greatest(*(M.seq_ratio(f(stored), f(read)) for f in forms))
