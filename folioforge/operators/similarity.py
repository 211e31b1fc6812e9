"""Fuzzy reconciliation of two readings of the same document.

The ratio is twice the matched characters over both lengths, by longest common blocks with popular characters left out of
long texts: order of arguments matters. No expression computes it, so it is an Arrow UDF over the standard library; pairs
are made within a block, and passages are compared on their first 500 characters; where nothing says which texts belong
together, a stated table of items is compared with every text, in blocks. A ratio is only worked out as far as it may matter.
"""

from __future__ import annotations

import difflib
import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..session import ship
from . import ratios as R
from .rows import added

PREFIX = 500


def ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a.combine(b, ratio)


def _patch(original: str | None, better: str | None) -> str | None:
    """original with the changes that lead to `better`, but none that touch a picture, drop a choice mark or empty a line."""
    if not original or not better:
        return original
    out = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, original, better).get_opcodes():
        old, new = original[a:b], better[c:d]
        guarded = op != "equal" and ("<img" in old or "[[IMG:" in old or any(m in old and m not in new for m in "①②③④⑤") or (old.strip() and not new.strip() and len(old) > 20))
        out.append(old if op == "equal" or guarded else new)
    return "".join(out)


@F.pandas_udf(T.StringType())
def patched(original: pd.Series, better: pd.Series) -> pd.Series:
    return original.combine(better, _patch)


@F.pandas_udf(T.StringType())
def changes(a: pd.Series, b: pd.Series) -> pd.Series:
    """`old → new` of each difference, 80 characters in all."""

    def one(x: str | None, y: str | None) -> str:
        x, y = x or "", y or ""
        ops = difflib.SequenceMatcher(None, x, y).get_opcodes()
        return "; ".join(f"{x[i:j]} → {y[k:m]}" for op, i, j, k, m in ops if op != "equal")[:80]

    return a.combine(b, one)


#: Classes of letters that a text's signature counts; items and lines that are compared in one group.
CLASSES, BLOCK_ITEMS, BLOCK_LINES = 64, 1024, 4096


class Bounds:
    """Lower and upper bounds of difflib's ratio of two texts, narrowed block by block until they say what is asked."""

    def __init__(self) -> None:
        self.matcher = difflib.SequenceMatcher()

    def second(self, text: str) -> None:
        self.matcher.set_seq2(text)

    def narrow(self, text: str, enough: Callable[[float, float], bool]) -> tuple[float, float]:
        """Bounds of the ratio of `text` and the second text that are enough, or the ratio, twice. The longest common block of a
        stretch parts it in two; stretches are looked at in the order of what they may hold, the length of their shorter side."""
        m = self.matcher
        m.set_seq1(text)
        size, same = len(m.a) + len(m.b), 0
        if not size:
            return 1.0, 1.0
        rest = min(len(m.a), len(m.b))
        heap = [(-rest, 0, len(m.a), 0, len(m.b))] if rest else []
        while True:
            low, high = 2.0 * same / size, 2.0 * (same + rest) / size
            if not heap or enough(low, high):
                return low, high
            most, alo, ahi, blo, bhi = heapq.heappop(heap)
            rest += most
            i, j, n = m.find_longest_match(alo, ahi, blo, bhi)
            same += n
            for part in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)) if n else ():
                if (k := min(part[1] - part[0], part[3] - part[2])) > 0:
                    heapq.heappush(heap, (-k, *part))
                    rest += k

    def ratio(self, text: str, least: float) -> float | None:
        """The ratio, or null as soon as it is known to be below `least`."""
        low, high = self.narrow(text, lambda _, most: most < least)
        return low if low == high and high >= least else None

    def within(self, text: str, cuts: list[float]) -> float:
        """A number between the same two cuts as the ratio (a cut belongs to what is above it)."""
        return self.narrow(text, lambda low, high: not any(low < c <= high for c in cuts))[0]


def _signature(text: str | None) -> list[int] | None:
    if text is None:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(codes % CLASSES, minlength=CLASSES).tolist()


def upper_bound(a: Column, b: Column, size: Column) -> Column:
    """No ratio of texts with these signatures is above it; size is that of both texts."""
    return F.coalesce(2.0 * F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x) / F.nullif(size, F.lit(0)), F.lit(1.0))


def best_match(left: DataFrame, right: DataFrame, block: list[str], left_text: str, right_text: str, left_id: str, right_id: str, least: float, prefix: int | None = None, inclusive: bool = False) -> DataFrame:
    """left_id, right_id, similarity: the most similar right text within the block, if more alike than `least` (or as alike, if
    inclusive); ties go to the least id. Whole texts are compared, or their first `prefix` characters.

    Pairs of a block whose letters alone rule them out are dropped by an expression. The others of one left text are gone
    through in falling order of that bound with the best ratio so far, and the ratio is only worked out as far as it may win.
    """
    cut = lambda c: F.coalesce(F.col(c) if prefix is None else F.substring(c, 1, prefix), F.lit(""))
    signed = lambda rows, text, n: added(rows.withColumnRenamed(text, n), f"{n}s", T.ArrayType(T.IntegerType()), _signature, n)
    a = signed(left.select(*block, left_id, cut(left_text).alias("__t")), "__t", "__a")
    b = signed(right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(block)), right_id, cut(right_text).alias("__t")), "__t", "__b")
    bound = upper_bound(F.col("__as"), F.col("__bs"), F.length("__a") + F.length("__b"))
    pairs = a.join(b, [a[k] == b[f"__k{i}"] for i, k in enumerate(block)]).select(left_id, right_id, "__a", "__b", bound.alias("__most"))
    pairs = pairs.where(F.col("__most") >= least if inclusive else F.col("__most") > least).sortWithinPartitions(left_id, F.desc("__most"), right_id)
    schema = T.StructType([left.schema[left_id], right.schema[right_id], T.StructField("similarity", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, top, held, out = None, None, 0.0, Bounds(), []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out.clear()

        for batch in batches:
            for i, j, x, y, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at[0] != i:
                    if found is not None:
                        out.append((at[0], found[0], top))
                    at, found, top = (i,), None, least
                wins = lambda r: r > top or (r == top and (inclusive if found is None else j < found[0]))  # noqa: B023, E731
                if not wins(most):
                    continue
                held.second(y)
                if (r := held.ratio(x, top)) is not None and wins(r):
                    found, top = (j,), r
            yield from flush()
        if found is not None:
            out.append((at[0], found[0], top))
        yield from flush()

    ship(left.sparkSession)
    best = pairs.mapInArrow(run, schema)  # a left text may stand in several tasks, where a hot block was split
    one = best.groupBy(left_id).agg(F.min(F.struct((-F.col("similarity")).alias("d"), F.col(right_id).alias("j"))).alias("b"))
    return one.select(left_id, F.col("b.j").alias(right_id), (-F.col("b.d")).alias("similarity"))


class _Items:
    """First texts, compared with many others: short ones are scored side by side, of longer ones those alone that a bound leaves."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.first, self.exact = texts, R.Firsts(texts), Bounds()
        self.rare = R.Rare(self.first)

    def _parted(self, lines: list[str]) -> tuple[list[np.ndarray], list[int], list[int]]:
        coded = [self.first.coded(R.codes(x)) for x in lines]
        return coded, [k for k, x in enumerate(coded) if len(x) < R.SHORT], [k for k, x in enumerate(coded) if len(x) >= R.SHORT]

    def short(self, lines: list[str], least: Callable[[], np.ndarray | float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, lines, ratios) of all pairs with lines of fewer than SHORT characters whose ratio may be `least` (asked again and again)."""
        coded, few, _ = self._parted(lines)
        for batch in R.batches(self.first, [coded[k] for k in few]):
            at = np.array(few)[batch]
            most = np.stack([self.first.most(coded[k]) for k in at], axis=1)
            may = most >= np.reshape(least(), (-1, 1))
            seconds = R.Seconds(self.first, [coded[x] for x in at]) if may.any() else None
            step = max(1, R.PAIRS // len(at))
            for lo in range(0, len(may), step):
                i, j = np.nonzero(may[lo : lo + step])
                if len(i):
                    i += lo
                    both = self.first.size[i] + seconds.size[j]
                    yield i, at[j], np.where(both > 0, 2.0 * seconds.matched(i, j) / np.maximum(both, 1), 1.0)

    def long(self, lines: list[str], least: Callable[[], np.ndarray | float]) -> Iterator[tuple[int, np.ndarray]]:
        """(line, items) of the other pairs whose ratio may be `least`; the line is the second text of `exact` then."""
        coded, _, many = self._parted(lines)
        for k in many:
            both, n = self.first.size + len(coded[k]), least()
            if (2.0 * np.minimum(self.first.size, len(coded[k])) / both >= n).any():
                most = 2.0 * self.rare.most(coded[k]) / both
                if len(near := np.flatnonzero(most >= n)):
                    self.exact.second(lines[k])
                    yield k, near[np.argsort(-most[near], kind="stable")]


def _in_blocks(items: DataFrame, lines: DataFrame) -> tuple:
    """Every block of items with every part of the lines, grouped: each pair of both meets once, in groups of BLOCK_ITEMS and
    BLOCK_LINES rows or so. The items are what is asked for, in blocks; each of them is sent once to every part."""
    ship(lines.sparkSession)
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    parts = max(4 * lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // BLOCK_LINES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = items.withColumn("__block", F.pmod(F.xxhash64(*items.columns), F.lit(blocks))).withColumn("__part", every(parts))
    b = lines.withColumn("__part", F.pmod(F.xxhash64(*lines.columns), F.lit(parts))).withColumn("__block", every(blocks))
    # so many partitions as there are parts: few bytes are much work here, so they must not be put together
    deal = lambda rows: rows.repartition(parts, "__block", "__part").groupBy("__block", "__part")
    return deal(a).cogroup(deal(b))


def best_of_all(items: DataFrame, lines: DataFrame, item_text: str, line_text: str, item_id: str, line_id: str, least: float) -> DataFrame:
    """item_id, line_id, similarity: of all lines the most similar to each item, whole texts, if more alike than `least`; ties
    go to the least id. Items are compared in blocks, and each group gives one row an item at most. Null texts match none."""
    schema = T.StructType([items.schema[item_id], lines.schema[line_id], T.StructField("similarity", T.DoubleType())])

    def best(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        few = few.iloc[few["__t"].str.len().argsort(kind="stable")]  # those that are worked on together are of like length
        held, ids, lines, at = _Items(few["__t"].tolist()), few["__i"].tolist(), many["__t"].tolist(), many["__i"].tolist()
        top, found = np.full(len(ids), least), [None] * len(ids)

        def offer(k: int, r: float, line: object) -> None:
            if r > top[k] or (r == top[k] and found[k] is not None and line < found[k]):
                top[k], found[k] = r, line

        for items_, lines_, r in held.short(lines, lambda: top):
            for x in np.flatnonzero(r >= top[items_]):
                offer(items_[x], r[x], at[lines_[x]])
        for n, near in held.long(lines, lambda: top):
            for k in near:
                if (r := held.exact.ratio(held.texts[k], top[k])) is not None:
                    offer(k, r, at[n])
        got = [k for k in range(len(ids)) if found[k] is not None]
        return pd.DataFrame({item_id: [ids[k] for k in got], line_id: [found[k] for k in got], "similarity": [float(top[k]) for k in got]}, columns=schema.names)

    few = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("__i"), F.col(item_text).alias("__t"))
    once = lines.where(F.col(line_text).isNotNull()).groupBy(F.col(line_text).alias("__t")).agg(F.min(line_id).alias("__i"))
    each = _in_blocks(few, once).applyInPandas(best, schema)
    one = each.groupBy(item_id).agg(F.min(F.struct((-F.col("similarity")).alias("d"), F.col(line_id).alias("j"))).alias("b"))
    return one.select(item_id, F.col("b.j").alias(line_id), (-F.col("b.d")).alias("similarity"))


def reclassified(items: DataFrame, lines: DataFrame, item_text: str, line_text: str, cuts: dict[float, str]) -> DataFrame:
    """before, after, count: the classes of the ratio of every item and every line, as they are and in lower case. cuts names the
    class from each ratio on; from 0.0 on there must be one. A ratio of a long line is worked out as far as its class needs."""
    edges = sorted(cuts)
    above = [c for c in edges if c > 0]

    def kinds(texts: list[str], lines: list[str]) -> np.ndarray:
        """The number of the class of each text and line."""
        held, out = _Items(texts), np.zeros((len(texts), len(lines)), dtype=np.int16)
        first = above[0] if above else 2.0
        for i, j, r in held.short(lines, lambda: first):
            out[i, j] = np.searchsorted(above, r, side="right")
        for n, near in held.long(lines, lambda: first):
            out[near, n] = np.searchsorted(above, [held.exact.within(texts[k], above) for k in near], side="right")
        return out

    def count(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        few = few.iloc[few["__t"].str.len().argsort(kind="stable")]
        texts, lines, n = few["__t"].tolist(), many["__t"].tolist(), Counter()
        before, after = kinds(texts, lines), kinds([t.lower() for t in texts], [t.lower() for t in lines])
        pair, times = before * np.int64(len(edges)) + after, many["__n"].to_numpy(np.int64)
        for k, m in enumerate(few["__n"]):
            for x in np.unique(pair[k]):
                n[cuts[edges[x // len(edges)]], cuts[edges[x % len(edges)]]] += int(times[pair[k] == x].sum()) * int(m)
        return pd.DataFrame([(*pair, v) for pair, v in n.items()], columns=["before", "after", "n"])

    once = lambda rows, text: rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    return _in_blocks(once(items, item_text), once(lines, line_text)).applyInPandas(count, "before string, after string, n long").groupBy("before", "after").agg(F.sum("n").alias("count"))


def match_passages(stored: DataFrame, read: DataFrame, least: float = 0.3) -> DataFrame:
    """Stored passages (doc_id, passage_id, question_range, content) with the read one (read_id, question_range, text) of the
    same range, else with the most alike of the document: doc_id, passage_id, read_id, similarity (null if by range)."""
    norm = F.regexp_replace(F.regexp_replace("question_range", r"\s", ""), "[～∼〜\\-]", "~")
    s, r = stored.withColumn("__r", norm), read.withColumn("__r", norm)
    exact = s.where("__r is not null and __r <> ''").join(r.select("doc_id", "__r", "read_id"), ["doc_id", "__r"]).groupBy("doc_id", "passage_id").agg(F.min("read_id").alias("read_id"))
    rest = s.join(exact, ["doc_id", "passage_id"], "left_anti").withColumn("__key", F.struct("doc_id", "passage_id"))
    bare = lambda c: tx.drop_structure(tx.drop_header(F.col(c)))
    fuzzy = best_match(rest.withColumn("content", bare("content")), r.withColumn("text", bare("text")), ["doc_id"], "content", "text", "__key", "read_id", least, PREFIX)
    return exact.withColumn("similarity", F.lit(None).cast("double")).unionByName(fuzzy.select("__key.doc_id", "__key.passage_id", "read_id", "similarity"))


def match_questions(stored: DataFrame, read: DataFrame, least: float = 0.55) -> DataFrame:
    """Stored questions (doc_id, number, stem) with the read question of that number, else of the most alike stem: `how` tells;
    a stem of five characters or fewer without a match is only INFO."""
    s, r = stored.select("doc_id", "number", "stem"), read.select("doc_id", F.col("number").alias("read_number"), F.col("stem").alias("read_stem"))
    same = s.join(r, (s["doc_id"] == r["doc_id"]) & (s["number"] == r["read_number"])).select(s["doc_id"], "number", "read_number", F.lit("number").alias("how"))
    rest = s.join(same, ["doc_id", "number"], "left_anti").withColumn("__key", F.struct("doc_id", "number"))
    fuzzy = best_match(rest, r, ["doc_id"], "stem", "read_stem", "__key", "read_number", least, inclusive=True).select("__key.doc_id", "__key.number", "read_number", F.lit("stem").alias("how"))
    none = rest.join(fuzzy, ["doc_id", "number"], "left_anti").select("doc_id", "number", F.lit(None).cast("int").alias("read_number"), F.when(F.length("stem") <= 5, "INFO").otherwise("WARNING").alias("how"))
    return same.unionByName(fuzzy).unionByName(none)


def text_verdict(original: Column, other: Column, similarity: Column, fixed: float = 0.7, removed: Column | None = None) -> Column:
    """NONE for equal texts, FIXED from the `fixed` ratio, WARNING from 0.5 unless references were taken out, else SKIPPED."""
    gone = F.lit(False) if removed is None else removed
    return F.when(original == other, "NONE").when(similarity >= fixed, "FIXED").when((similarity >= 0.5) & ~gone, "WARNING").otherwise("SKIPPED")


def choice_verdict(similarity: Column, junk: Column) -> Column:
    return F.when(similarity >= 0.85, "OK").when(similarity >= 0.6, "REPLACE").when((similarity >= 0.4) & junk, "TRIM").otherwise("WARNING")


def box_verdict(stored: Column, read: Column, similarity: Column) -> Column:
    return F.when(F.coalesce(F.length(stored), F.lit(0)) == 0, F.when(F.length(read) > 0, "APPEND")).when(similarity >= 0.85, "OK").when(similarity >= 0.8, "CORRECT").otherwise("WARNING")


def image_verdict(tags: Column, signs: Column) -> Column:
    """By the number of <img> tags stored and of picture signs read: too few signs may be the reading's fault, too few tags are ours."""
    return F.when((tags == 0) & (signs == 0), "NONE").when(tags == signs, "OK").when(tags > signs, "INFO").otherwise("WARNING")


def compare_questions(seen: DataFrame, stored: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, number, field): every difference between seen and stored questions.

    seen: doc_id, number, stem, has_bogi, choice_count, has_image; stored: doc_id, number, stem, bogi, choice_count, content.
    """
    d = stored.select("doc_id", "number", F.col("stem").alias("d_stem"), (F.length(F.coalesce("bogi", F.lit(""))) > 0).alias("d_bogi"), F.col("choice_count").alias("d_choices"), F.col("content").alias("d_content"), F.lit(True).alias("there"))
    both = seen.join(d, ["doc_id", "number"], "left").withColumn("sim", F.when(F.col("there"), seq_ratio(tx.comparable(F.col("stem")), tx.comparable(F.col("d_stem")))))
    there = F.coalesce("there", F.lit(False))
    rules = F.array(
        F.when(~there, "missing"), F.when(there & (F.col("sim") < least), "stem"), F.when(there & (F.col("has_bogi") != F.col("d_bogi")), "bogi"),
        F.when(there & F.col("has_image") & ~F.coalesce(F.col("d_content").contains("<img"), F.lit(False)), "image"), F.when(there & (F.col("choice_count") != F.col("d_choices")), "choices"),
    )
    return both.select("doc_id", "number", F.explode(F.array_compact(rules)).alias("field"))


def skip_questions(choices: DataFrame, least: float = 0.35) -> DataFrame:
    """Questions whose choices, compared pairwise, are too unlike on average to be the same question: (doc_id, number, mean)."""
    scored = choices.withColumn("ratio", seq_ratio("stored", "read"))
    return scored.groupBy("doc_id", "number").agg(F.avg("ratio").alias("mean")).where(F.col("mean") < least)
