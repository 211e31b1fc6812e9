"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words (A-Z in lower case); the edit is one of a word (replaced, put in or left out). The
edit bound is a function of a line's length: edits(n) is 1 from `near_words` words on and 0 below, where an edit would change
too much of the line; near_words=1 bounds all lines by 1, near_words=None all by 0. Two lines are alike if their edit distance
is within the bound of the shorter. Every line with an earlier line like it goes, judged on the input. Earlier is by doc_id,
then by line number.

Distinct lines emit the hashes of themselves and of all variants with one word left out, lines that share one meet, and
their edit distance is verified. A variant is keyed with the place left out, or as a whole line: lines under one place key
are all within an edit of each other, and under a line key the line itself is of all others. So each key only has to
name its earliest line, and no pairs are made within a group. Before that, lines that share neither half of their words
with another line are set aside: an edit leaves one half as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, free, join_hot, others, small, spread

#: Words from which on the edit bound of a line is 1.
NEAR_WORDS = 8
_LAST = 2**63 - 1
_U = np.uint64
_TAG = tk.mix(np.arange(5000, 5016, dtype=_U))


def _line_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset at which each line starts, first line of each document); an empty document has one empty line."""
    breaks = np.flatnonzero(buf == 10) + 1
    starts = np.concatenate([off[:-1], breaks])
    kind = np.concatenate([np.zeros(len(off) - 1, np.int8), np.ones(len(breaks), np.int8)])
    # a break at the very end of a document starts a line of that document, before the next document starts
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off[1:], breaks, "left")])
    order = np.lexsort((kind, starts, doc))
    starts, doc = starts[order], doc[order]
    return starts, np.searchsorted(doc, np.arange(len(off)))


class Lines:
    """Word hashes of a chunk of texts by line: words at[j]:at[j+1] are those of line j, first[d]:first[d+1] the lines of document d."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        starts, self.first = _line_bounds(buf, off)
        w = tk.Words(buf, off)
        self.words = w.hashes()
        self.at = np.append(np.searchsorted(w.starts, starts), len(w))
        self.size = np.diff(self.at)
        self.starts = starts
        up, down = tk._pows(len(self.words) + 1)
        self.down, self.sums = down, []
        for t in (_TAG[0], _TAG[1]):
            s = np.zeros(len(self.words) + 1, _U)
            np.cumsum(tk.mix(self.words ^ t) * up[: len(self.words)], out=s[1:])
            self.sums.append(s)

    def hash(self, a: np.ndarray, b: np.ndarray, tag: int, which: int = 0) -> np.ndarray:
        """Hash of the words a:b of each row."""
        s = self.sums[which]
        return tk.mix((s[b] - s[a]) * self.down[a] ^ (b - a).astype(_U) * _TAG[3] ^ _TAG[tag])


def edits(n_words: int, near_words: int | None = NEAR_WORDS) -> int:
    """The edit bound of a line of n_words words."""
    return int(near_words is not None and n_words >= near_words)


def line_table(docs: DataFrame) -> DataFrame:
    """(i, k, line, n, h1, h2, half hashes p0 s0 p1 s1) of every line with words. No shuffle.

    p and s are of the first and last half of n words, and of n - 1 words: two lines within an edit share one for the lesser n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "k"))
            buf, off = tk.column_bytes(batch.column("text"))
            for x, y in tk.chunks(off):
                t = Lines(buf[off[x] : off[y]], off[x : y + 1] - off[x])
                some = np.flatnonzero(t.size > 0)
                a, b, n = t.at[some], t.at[some + 1], t.size[some]
                doc = np.searchsorted(t.first, some, "right") - 1
                halves = []
                for m in (n, n - 1):
                    half, tag = m // 2, m.astype(_U) * _TAG[4]
                    halves += [tk.mix(t.hash(a, a + half, 5) ^ tag), tk.mix(t.hash(b - half, b, 6) ^ tag)]
                cols = [i[x + doc], k[x + doc], some - t.first[doc], n, *(h.view(np.int64) for h in (t.hash(a, b, 7), t.hash(a, b, 7, 1), *halves))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["i", "k", "line", "n", "h1", "h2", "p0", "s0", "p1", "s1"])

    return docs.select("i", "k", "text").mapInArrow(tk.tidied(run), "i long, k long, line long, n long, h1 long, h2 long, p0 long, s0 long, p1 long, s1 long")


def variants(lines: DataFrame) -> DataFrame:
    """(key, whole, h1, h2, i, line): the deletion neighbourhood of rows (h1, h2, i, line, text).

    Place keys (whole null) hash a place and the line without the word there; line keys hash the line itself (whole true)
    or the line without a word (whole false).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "i", "line")]
            buf, off = tk.column_bytes(batch.column("text"))
            for x, y in tk.chunks(off):
                t = Lines(buf[off[x] : off[y]], off[x : y + 1] - off[x])  # one line each
                n = t.size
                row = np.repeat(np.arange(y - x), n)
                gone = np.arange(len(row))  # the word left out
                a, b = t.at[:-1][row], t.at[1:][row]
                s, up = t.sums[0], tk._pows(len(t.words) + 1)[0]
                # what stands behind the gap moves up one place
                raw = (s[gone] - s[a]) * t.down[a] + (s[b] - s[gone + 1]) * t.down[gone + 1] * up[gone - a]
                less = tk.mix(raw ^ (b - a - 1).astype(_U) * _TAG[3] ^ _TAG[7])
                place = tk.mix(less ^ tk.mix((gone - a).astype(_U) + _TAG[8]))
                own = t.hash(t.at[:-1], t.at[1:], 7)
                keys = np.concatenate([place, less, own])
                whole = pa.array([None] * len(place) + [False] * len(less) + [True] * len(own), pa.bool_())
                rows = x + np.concatenate([row, row, np.arange(y - x)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), whole, *(pa.array(m[rows]) for m in meta)], names=["key", "whole", "h1", "h2", "i", "line"])

    return lines.select("h1", "h2", "i", "line", "text").mapInArrow(tk.tidied(run), "key long, whole boolean, h1 long, h2 long, i long, line long")


_GAPS = " \t\n\x0b\x0c\r"


def line_words(line: Column) -> Column:
    """Words of a line, A-Z in lower case; null if there are none."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.nullif(F.btrim(low, F.lit(_GAPS)), F.lit("")), r"[\x20\x09-\x0D]+")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the word edit distance of two arrays is at most one: behind their common head, one word of either or both aside, they are equal."""
    n, m = F.size(a), F.size(b)
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), F.greatest(n, m) + 1).cast("int")  # the first place where they differ
    skip_a, skip_b = F.when(n >= m, 1).otherwise(0), F.when(m >= n, 1).otherwise(0)
    rest = lambda x, skip, size: F.slice(x, at + skip, F.greatest(size - at - skip + 1, F.lit(0)))
    return (F.abs(n - m) <= 1) & (rest(a, skip_a, n) == rest(b, skip_b, m))


def _pick_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, i, line, text) of the lines that `want` (an array of structs line, h1, h2) asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids = batch.column("i").to_pylist()
            for j, want in enumerate(batch.column("want").to_pylist()):
                lines = (batch.column("text")[j].as_py() or "").split("\n")
                for w in want:
                    for to, v in zip(out, (w["h1"], w["h2"], ids[j], w["line"], lines[w["line"]]), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["h1", "h2", "i", "line", "text"])

    return docs.select("i", "text", "want").mapInArrow(tk.tidied(run), "h1 long, h2 long, i long, line long, text string")


def _near(docs: DataFrame, lines: DataFrame, classes: DataFrame, scratch: Scratch, near_words: int) -> DataFrame:
    """(h1, h2) of the lines, of near_words or more, that have an earlier one an edit away, a written table."""
    # halves: of all lines, since equal lines share all of theirs and count once by their hash
    long = lines.where(F.col("n") >= near_words)
    halves = long.select("h1", "h2", F.explode(F.array("p0", "s0", "p1", "s1")).alias("half"))
    pair = F.struct("h1", "h2")
    shared = halves.groupBy("half").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).where("lo <> hi").select("half")
    flagged = halves.join(shared, "half").select("h1", "h2").distinct().join(classes, ["h1", "h2"])
    flagged = scratch.put(flagged.select("h1", "h2", F.col("first.i").alias("i"), F.col("first.k").alias("k"), F.col("first.line").alias("line")), "flagged")
    want = flagged.groupBy("i", "k").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("want"))
    some = docs.join(small(scratch.put(flagged.select("i").distinct(), "ids")), "i", "left_semi").join(want, ["i", "k"]).dropDuplicates(["i", "k"])
    texts = scratch.put(_pick_lines(some), "texts")

    v = variants(texts)
    at = F.struct("i", "line", "h1", "h2")
    place = v.where("whole is null")
    best = place.groupBy("key").agg(F.min(at).alias("m"), F.max(at).alias("last")).where("m < last").select("key", "m")
    pairs = place.join(best, "key").where(F.struct("i", "line") > F.struct("m.i", "m.line"))
    whole = v.where("whole")
    less = v.where("not whole")
    own = whole.select("key", F.struct("i", "line", "h1", "h2").alias("m")).distinct()
    after = less.join(own, "key").where(F.struct("i", "line") > F.struct("m.i", "m.line"))
    best = less.join(own.select("key"), "key", "left_semi").groupBy("key").agg(F.min(at).alias("m"))
    before = whole.join(best, "key").where(F.struct("i", "line") > F.struct("m.i", "m.line"))
    cols = ["h1", "h2", F.col("m.h1").alias("m1"), F.col("m.h2").alias("m2")]
    pairs = scratch.put(pairs.select(*cols).unionByName(after.select(*cols)).unionByName(before.select(*cols)).distinct(), "pairs")

    of = texts.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    # one line may be the mate of very many
    pairs = pairs.select("h1", "h2", F.struct("m1", "m2").alias("m"))
    mate = of.select(F.struct(F.col("h1").alias("m1"), F.col("h2").alias("m2")).alias("m"), F.col("text").alias("mate"))
    near = spread(pairs, mate, "m", "h1", pairs).join(of, ["h1", "h2"]).select("h1", "h2", line_words(F.col("text")).alias("a"), line_words(F.col("mate")).alias("b")).where(within_one_edit(F.col("a"), F.col("b"))).select("h1", "h2").distinct()
    return scratch.put(near, "near")


def repeated_lines(docs: DataFrame, scratch: Scratch, near_words: int | None = NEAR_WORDS) -> DataFrame:
    """(i, k, gone, n): the lines to take out of each text, as a map of bit sets of 64 lines, and how many they are. docs has i (the id), k (a hash of the text) and text."""
    lines = scratch.put(line_table(docs), "lines")
    at = F.struct("i", "line", "k")
    classes = lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times"))
    classes = scratch.put(classes, "classes")
    if near_words is None:
        near = classes.select("h1", "h2").limit(0)
    else:
        near = _near(docs, lines, classes, scratch, near_words)
    near = near.withColumn("near", F.lit(True))

    judged = classes.join(near, ["h1", "h2"], "left").where("times > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), "times")
    judged = scratch.put(judged, "judged")
    gone = join_hot(lines.select("i", "k", "line", "h1", "h2"), judged, ["h1", "h2"], "inner", "times").where(F.col("near") | (F.struct("i", "line") > F.struct("first.i", "first.line")))
    # bits of 64 lines each: a text of many lines is then cut in about linear time
    bits = gone.groupBy("i", "k", (F.floor(F.col("line") / 64)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(line % 64 as int))")).alias("b"))
    return scratch.put(bits.groupBy("i", "k").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("gone"), F.sum(F.bit_count("b")).cast("long").alias("n")), "gone")


def dedup_lines(docs: DataFrame, near_words: int | None = NEAR_WORDS, into: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of docs, with `text` without its repeated lines, and the two of `into`, the numbers of lines there were and
    that went (columns of docs with these names in any case are replaced).

    Lines are separated by a newline; a line without words is never removed. A null text stays null and has no lines, an
    empty one has one. A null id counts as 2^63 - 1, later than every other; rows of one id are not earlier than each other,
    so of repeated rows all stay or go. An empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "linedup")
    i, k, bits, n = (free(x, docs) for x in ("i_", "k_", "bits_", "n_"))
    keyed = docs.select("*", F.coalesce("doc_id", F.lit(_LAST)).alias(i), F.xxhash64("text").alias(k))
    gone = repeated_lines(keyed.select(F.col(i).alias("i"), F.col(k).alias("k"), "text"), scratch, near_words)
    out = keyed.join(gone.select(F.col("i").alias(i), F.col("k").alias(k), F.col("gone").alias(bits), F.col("n").alias(n)), [i, k], "left")

    stays = lambda j: F.coalesce(F.getbit(F.try_element_at(bits, F.floor(j / 64)), j % 64), F.lit(0)) == 0
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, j: stays(j)), "\n")
    names = [f.name for f in others(docs, *into)]
    return out.select(
        *(F.when(F.col(bits).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in names),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))), F.lit(0)).cast("long").alias(into[0]),
        F.coalesce(n, F.lit(0)).cast("long").alias(into[1]),
    )


def op9_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage_linedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines. One that had words and has none left goes: all of it stands in earlier ones.
    Other columns stay as they are, but n_chars follows the text. Null and empty texts stay, and so does an empty table."""
    n, gone = free("n_lines_", docs), free("n_removed_", docs)
    out = dedup_lines(docs, into=(n, gone))
    out = out.where(~((F.col(gone) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


#: The same rows in DuckDB, with variants as lists of words.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text IS NULL AS empty FROM documents),
l AS (SELECT doc_id, no, ls[no + 1] AS line, regexp_extract_all(translate(ls[no + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS no FROM t)),
c AS (SELECT w, min((doc_id, no)) AS f FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, f, p, w[: p] || w[p + 2 :] AS k FROM (SELECT w, f, unnest(range(0, len(w))) AS p FROM c WHERE len(w) >= 8)),
s AS (SELECT p, k, min(f) AS m FROM v GROUP BY p, k HAVING count(*) > 1),
near AS (SELECT v.w FROM v JOIN s ON v.p = s.p AND v.k = s.k WHERE v.f > s.m
         UNION SELECT v.w FROM v JOIN c ON v.k = c.w WHERE len(c.w) >= 8 AND v.f > c.f
         UNION SELECT c.w FROM v JOIN c ON v.k = c.w WHERE len(c.w) >= 8 AND c.f > v.f),
r AS (SELECT l.doc_id, l.no, l.line, coalesce(len(l.w) > 0 AND ((l.doc_id, l.no) > c.f OR near.w IS NOT NULL), false) AS gone
      FROM l LEFT JOIN c ON l.w = c.w LEFT JOIN near ON l.w = near.w)
SELECT t.doc_id, CAST(CASE WHEN empty THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id) g USING (doc_id)
"""
