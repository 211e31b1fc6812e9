"""Marked texts as clean text and marks beside it, and positions that move with corrections.

A text with range marks, underlines, boxes and pictures is a pair: the text without them, and an array of marks with the place
each stands at in it. Two readings are then compared as clean texts only; what a correction replaces moves the places behind it,
and new marks are put at places of the clean text, so that corrections of any order compose. One difflib run a pair of texts
gives the blocks that both share, and everything else is read off the blocks by expressions.
"""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from .rows import added

#: What marks a text beside its words.
MARK = r"\[[A-E]:(?:START|END)\]\n?|</?u>|<보기>|<img\b[^>]*/?\s*>\n?|\[그림\]\n?"
MARKS = "array<struct<at:int,rank:int,i:int,mark:string>>"
BLOCKS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "n")]))
LIKE = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("plain", T.DoubleType()), T.StructField("headless", T.BooleanType()), T.StructField("bare", T.DoubleType()), T.StructField("blocks", BLOCKS)])

# Where several marks stand at one place: what closes, then those that stood there, then what opens.
CLOSE_LINE, CLOSE_RANGE, THERE, OPEN_RANGE, OPEN_LINE = range(-2, 3)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def taken_apart(text: Column) -> Column:
    """struct(clean, marks) of a marked text; put_together() gives the text again."""
    ahead = lambda pieces, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda n, p: n + F.length(p))
    found = lambda t: F.regexp_extract_all(t, F.lit(f"({MARK})"), 1)
    both = lambda t, pieces: F.struct(F.array_join(pieces, "").alias("clean"), F.transform(found(t), lambda m, i: mark(ahead(pieces, i), THERE, i, m)).cast(MARKS).alias("marks"))
    return let(text, lambda t: let(F.split(t, MARK, -1), lambda pieces: both(t, pieces)))


def mark(at: Column, rank: int, i: Column | int, text: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), F.lit(rank).alias("rank"), (i if isinstance(i, Column) else F.lit(i)).cast("int").alias("i"), text.alias("mark"))


def put_together(clean: Column, marks: Column) -> Column:
    """The clean text with the marks at their places."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, m: F.struct(F.concat(a["out"], F.substring(clean, a["at"] + 1, m["at"] - a["at"]), m["mark"]).alias("out"), m["at"].alias("at"))
    return F.aggregate(F.array_sort(marks), start, step, lambda a: F.concat(a["out"], F.substring(clean, a["at"] + 1, F.length(clean))))


def _pair(a: str, b: str) -> tuple[float, difflib.SequenceMatcher]:
    m = difflib.SequenceMatcher(None, a, b)
    return m.ratio(), m


def _alike(forms: dict) -> dict | None:
    """The greatest ratio of two texts as they are, without passage headers and in the form for comparison; whether headers were
    left out for it, the ratio without references, and the blocks."""
    (a, b), (ha, hb), (na, nb), (nha, nhb), (ra, rb) = (forms[k] for k in range(5))
    if a is None or b is None:
        return None
    if a == b:
        return {"ratio": 1.0, "plain": 1.0, "headless": False, "bare": 1.0, "blocks": [{"a": 0, "b": 0, "n": len(a)}] if a else []}
    plain, m = _pair(a, b)
    best, headless = plain, False
    if (ha, hb) != (a, b):
        r, other = _pair(ha, hb)
        if r > best:
            best, m, headless = r, other, True
    shown = (nha, nhb) if headless else (na, nb)
    if shown != ((ha, hb) if headless else (a, b)) and difflib.SequenceMatcher(None, *shown).quick_ratio() > best:
        best = max(best, _pair(*shown)[0])
    bare = _pair(ra, rb)[0] if ra is not None else best
    return {"ratio": best, "plain": plain, "headless": headless, "bare": bare, "blocks": [{"a": x.a, "b": x.b, "n": x.size} for x in m.get_matching_blocks() if x.size]}


def likeness(rows: DataFrame, clean: str, headless: str, other: str, references: bool = False) -> DataFrame:
    """rows with `like`, struct(ratio, plain, headless, bare, blocks) of a clean text and another reading of it. `headless` is the
    clean text without passage headers; with references, `bare` is the ratio without [A] to [E]."""
    no = lambda c: tx.chain(c, (r"\[[A-E]\]", "")) if references else F.lit(None).cast("string")
    a, h, b = F.col(clean), F.col(headless), F.col(other)
    forms = rows.withColumn("other_headless", tx.drop_header(b))
    hb = F.col("other_headless")
    pair = lambda x, y: F.array(x, y)
    forms = forms.withColumn("forms_", F.array(pair(a, b), pair(h, hb), pair(tx.comparable(a), tx.comparable(b)), pair(tx.comparable(h), tx.comparable(hb)), pair(no(a), no(b))))
    return added(forms, "like", LIKE, _alike, "forms_").drop("forms_")


def ratio_of_pairs(pairs: list[dict] | None) -> list[float | None] | None:
    """Ratio of each pair (a, b) of an array; null for a null."""
    one = lambda p: None if p["a"] is None or p["b"] is None else difflib.SequenceMatcher(None, p["a"], p["b"]).ratio()
    return None if pairs is None else [one(p) for p in pairs]


def gaps(blocks: Column, a: Column, b: Column) -> Column:
    """struct(a0, a1, b0, b1) of each stretch of a and b between the blocks that both share."""
    ends = F.concat(blocks, F.array(F.struct(F.length(a).alias("a"), F.length(b).alias("b"), F.lit(0).alias("n"))))
    before = F.concat(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))), blocks)
    between = F.zip_with(before, ends, lambda p, q: F.struct((p["a"] + p["n"]).alias("a0"), q["a"].alias("a1"), (p["b"] + p["n"]).alias("b0"), q["b"].alias("b1")))
    return F.filter(between, lambda g: (g["a0"] < g["a1"]) | (g["b0"] < g["b1"]))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


# Circled signs, and corner brackets of either kind, that a reading takes for each other.
CIRCLED_DIGIT, CIRCLED_LETTER, CIRCLED_ANY = "[①-⑳]", "[㉠-㉿]", "[ⓐ-ⓩ㉠-㉿①-⑳]"
CORNERS = ("[『』]", "[「」]")


def trusted(gap: Column, a: Column, b: Column, marks: Column) -> Column:
    """Whether a stretch of a may be replaced by that of b: not if b only adds, takes circled signs or corner brackets for others, or
    has a picture within or at 10 characters with all of its tag."""
    old, new = _cut(a, gap["a0"], gap["a1"]), _cut(b, gap["b0"], gap["b1"])
    size = lambda m: F.length(F.rtrim(m["mark"], F.lit("\n")))
    near = lambda m: ((m["at"] > gap["a0"]) & (m["at"] < gap["a1"])) | (F.greatest(gap["a0"] - m["at"], m["at"] - gap["a1"]) + size(m) <= 10)
    misread = (
        (new.contains("@") & old.rlike(CIRCLED_ANY)) | (new.rlike(CIRCLED_DIGIT) & old.rlike(CIRCLED_LETTER) & ~old.rlike(CIRCLED_DIGIT))
        | (old.rlike(CORNERS[0]) & new.rlike(CORNERS[1])) | (old.rlike(CORNERS[1]) & new.rlike(CORNERS[0]))
    )
    return (gap["a0"] < gap["a1"]) & ~misread & ~F.exists(marks, lambda m: m["mark"].startswith("<img") & near(m))


def patched(a: Column, b: Column, changes: Column) -> Column:
    """a with the stretches of `changes` (of gaps()) as they are in b."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, g: F.struct(F.concat(s["out"], _cut(a, s["at"], g["a0"]), _cut(b, g["b0"], g["b1"])).alias("out"), g["a1"].alias("at"))
    return F.aggregate(changes, start, step, lambda s: F.concat(s["out"], F.substring(a, s["at"] + 1, F.length(a))))


def moved(at: Column, changes: Column) -> Column:
    """Where a place of a is once the changes are made; a place within a change stays within what replaces it."""
    size = lambda g: g["b1"] - g["b0"]
    behind = F.aggregate(F.filter(changes, lambda g: g["a1"] <= at), F.lit(0), lambda n, g: n + size(g) - (g["a1"] - g["a0"]))
    inside = F.filter(changes, lambda g: (g["a0"] < at) & (at < g["a1"]))
    short = F.aggregate(inside, F.lit(0), lambda n, g: n + F.greatest(F.lit(0), at - g["a0"] - size(g)))
    return at + behind - short


def carried(marks: Column, changes: Column) -> Column:
    return F.transform(marks, lambda m: m.withField("at", moved(m["at"], changes).cast("int")))


def summary(changes: Column, a: Column, b: Column, most: int = 80) -> Column:
    """`'old' → 'new'` of each change, until these are `most` characters or more."""
    one = lambda g: F.when(g["a0"] == g["a1"], F.concat(F.lit("삽입 '"), _cut(b, g["b0"], g["b1"]), F.lit("'"))).otherwise(F.concat(F.lit("'"), _cut(a, g["a0"], g["a1"]), F.lit("' → '"), _cut(b, g["b0"], g["b1"]), F.lit("'")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    join = lambda s, x: F.struct(F.concat(s["out"], F.when(s["n"] > 0, " | ").otherwise(""), x).alias("out"), (s["n"] + F.length(x)).alias("n"))
    more = lambda s: F.struct(F.when(s["out"].endswith("…"), s["out"]).otherwise(F.concat(s["out"], F.lit(" | …"))).alias("out"), s["n"].alias("n"))
    out = F.aggregate(F.transform(changes, one), start, lambda s, x: F.when(s["n"] > most, more(s)).otherwise(join(s, x)))
    return F.when(F.size(changes) == 0, "(동일)").otherwise(out["out"])


# --- places of phrases ---


def _escaped(phrase: Column) -> Column:
    return F.regexp_replace(phrase, F.lit(r"([\\.\[\]{}()*+?^$|])"), F.lit(r"\\$1"))


def loosely(phrase: Column) -> Column:
    """A pattern of the phrase with any white space for its own."""
    return F.regexp_replace(_escaped(tx.strip(phrase)), F.lit(r"(?U)\s+"), F.lit(r"(?U:\\s)+"))


def _corners(phrase: Column) -> Column:
    return F.translate(phrase, "｣｢『』", "」「「」")


def _span(text: Column, pattern: Column) -> Column:
    found = lambda at, p: F.when(at > 0, F.struct((at - 1).cast("int").alias("s"), (at - 1 + F.length(F.regexp_substr(text, p))).cast("int").alias("e")))
    return let(pattern, lambda p: let(F.regexp_instr(text, p), lambda at: found(at, p)))


def exactly(text: Column, phrase: Column) -> Column:
    found = lambda at: F.when((at > 0) & (F.length(phrase) > 0), F.struct((at - 1).cast("int").alias("s"), (at - 1 + F.length(phrase)).cast("int").alias("e")))
    return let(F.instr(text, phrase), found)


def place(text: Column, phrase: Column) -> Column:
    """struct(s, e) of a phrase in a text, or null: as it is, with any white space and one kind of corner brackets, without a leading
    bracket, and at last its first 20 characters with white space anywhere, if it has six."""
    some = lambda c, pattern: F.when(F.length(c) > 0, _span(text, pattern))
    headless = lambda flat: F.regexp_replace(flat, F.lit(r"^[「『]\s*"), F.lit(""))
    solid = lambda flat: F.regexp_replace(flat, F.lit(r"(?U)\s"), F.lit(""))
    spaced = lambda c: F.array_join(F.transform(F.split(F.substring(c, 1, 20), ""), _escaped), r"\s*")
    tiers = lambda p, flat: F.coalesce(
        exactly(text, p), some(flat, loosely(flat)), let(headless(flat), lambda h: some(h, loosely(h))), let(solid(flat), lambda c: F.when(F.length(c) >= 6, _span(text, spaced(c))))
    )
    return let(tx.strip(phrase), lambda p: let(_corners(p), lambda flat: tiers(p, flat)))


def place_of_range(text: Column, phrase: Column) -> Column:
    """struct(s, e) of a long phrase by its first 30 characters (or 15) and, behind these, its last 30; `e` is null if only the
    beginning is found."""
    head = lambda p: F.coalesce(place(text, F.substring(p, 1, 30)), place(text, F.substring(p, 1, 15)))
    tail = lambda p: F.when(F.length(p) > 30, F.right(p, F.lit(30))).otherwise(p)
    end = lambda p, at: let(F.substring(text, at + 1, F.length(text)), lambda rest: place(rest, tail(p)))
    both = lambda p, h: F.when(h.isNotNull(), let(end(p, h["s"]), lambda e: F.struct(h["s"].alias("s"), (h["s"] + e["e"]).alias("e"))))
    return let(tx.strip(phrase), lambda p: let(head(p), lambda h: both(p, h)))


def place_of_line(text: Column, phrase: Column) -> Column:
    """struct(s, e) of an underlined phrase: as it is, loosely, or by its first 20 characters, then of its own length."""
    start = lambda h: F.coalesce(exactly(text, h), _span(text, loosely(h)))
    by_head = lambda p: let(start(F.substring(p, 1, 20)), lambda x: F.when(x.isNotNull(), F.struct(x["s"].alias("s"), F.least(x["s"] + F.length(p), F.length(text)).alias("e"))))
    return let(tx.strip(phrase), lambda p: F.coalesce(exactly(text, p), _span(text, loosely(_corners(p))), by_head(p)))
