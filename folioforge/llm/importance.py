"""Target-distribution importance resampling over hashed word n-grams.

Each block of texts gets a suffix array over its word numbers, sorted to the depth that the features need. In its order equal
n-grams stand side by side, so the runs of common prefixes list every repeated n-gram once: each run is hashed once, and its
bucket is scattered back to all places of the run. A text then is the sequence of its buckets, in two bytes each. Their counts
in the documents and in the target give a gain for each bucket, a text's weight is its mean gain, and Gumbel noise from a hash
of the id turns the highest scores into a draw without replacement.

What the driver holds is one number a bucket and one count a distinct score. Ranks are given in ranges of the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, free, others

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text that have a suffix array of their own.
BLOCK_BYTES = 4 << 20
RESULT = ("n_features", "weight", "score", "rank")


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next `depth` numbers, by prefix doubling. left: numbers up to the text's end, its place's
    own included; behind the end stands something less than all numbers."""
    order = np.argsort(ids, kind="stable")
    rank, width, n = ids.astype(np.int64) + 1, 1, len(ids)
    while width < depth:
        behind = np.zeros(n, np.int64)
        there = np.flatnonzero(left > width)
        behind[there] = rank[there + width]
        order = np.lexsort((behind, rank))
        step = np.ones(n, np.int64)
        step[1:] = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
        rank[order] = np.cumsum(step)
        width *= 2
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that each suffix shares with the one before it in `order`, `depth` at most."""
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    at = np.arange(len(b))
    for k in range(depth):
        at = at[(left[a[at]] > k) & (left[b[at]] > k)]
        at = at[ids[a[at] + k] == ids[b[at] + k]]
        lcp[at + 1] = k + 1
    return lcp


def ngram_buckets(buf: np.ndarray, off: np.ndarray, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every run of 1 to n words of a block of texts, by text; offsets of the texts in it; words of each text)."""
    w = tk.Words(buf, off, tk.ALNUM)
    many, size = w.counts(), len(w)
    if not size:
        return np.zeros(0, np.int64), np.zeros(w.n_docs + 1, np.int64), many
    ids = np.unique(w.hashes(), return_inverse=True)[1]
    left = np.repeat(w.first[1:], many) - np.arange(size)
    order = suffix_array(ids, left, n)
    lcp = common_prefixes(ids, left, order, n)

    # the words with one space between them: any run of words is a slice
    length = w.ends - w.starts
    begin = np.cumsum(length + 1) - length - 1
    line = np.full(int(length.sum()) + size, 0x20, np.uint8)
    line[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = w.buf[np.repeat(w.starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    view, end = memoryview(line), begin + length

    found, doc, owner = [], [], w.doc_of()
    for k in range(1, n + 1):
        at = np.flatnonzero(left[order] >= k)  # a suffix of fewer words comes before those that share them, never between
        new = lcp[at] < k
        head = order[at[new]]
        hashed = np.array([zlib.crc32(view[a:b]) for a, b in zip(begin[head].tolist(), end[head + k - 1].tolist(), strict=True)], np.int64) % buckets
        out = np.full(size, -1, np.int64)
        out[order[at]] = hashed[np.cumsum(new) - 1]
        there = np.flatnonzero(out >= 0)
        found.append(out[there])
        doc.append(owner[there])
    by = np.concatenate(doc)
    if n > 1:
        place = np.argsort(by, kind="stable")
        return np.concatenate(found)[place], np.searchsorted(by[place], np.arange(w.n_docs + 1)), many
    return found[0], w.first, many


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_table(docs: DataFrame, n: int, buckets: int, names: tuple[str, str, str]) -> DataFrame:
    """All columns of docs, and the three of `names`: words, features, and the features' buckets end to end. No shuffle."""
    ship(docs.sparkSession)
    kept = docs.schema.fields
    schema = T.StructType([*kept, *(T.StructField(x, t) for x, t in zip(names, (T.LongType(), T.LongType(), T.BinaryType()), strict=True))])
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column("text"))
            words, features, packed = [], [], []
            for a, b in tk.chunks(off, BLOCK_BYTES, 1 << 20):
                found, cut, many = ngram_buckets(buf[off[a] : off[b]], off[a : b + 1] - off[a], n, buckets)
                raw, size = found.astype(kind).tobytes(), int(kind[-1])
                packed += [raw[x * size : y * size] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                words += many.tolist()
                features += np.diff(cut).tolist()
            more = [pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*(f.name for f in kept), *names])

    return docs.mapInArrow(tk.tidied(run), schema)


def bucket_counts(table: DataFrame, packed: str, buckets: int) -> DataFrame:
    """(bucket, n): the features of a bucket table, a row a task and bucket before the shuffle."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(tk.column_bytes(batch.column(packed))[0].tobytes(), kind), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return table.select(packed).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier each bucket is in the target, with one more feature in all; rounded down."""
    s, t, more = docs.astype(float), target.astype(float), float(len(docs))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + more) / ((s + 1) * (t.sum() + more)))).astype(np.int64)


def _counted(table: DataFrame, packed: str, buckets: int) -> np.ndarray:
    n = np.zeros(buckets, np.int64)
    for r in bucket_counts(table, packed, buckets).collect():  # a row a bucket at most
        n[r["bucket"]] = r["n"]
    return n


def weighted(table: DataFrame, packed: str, gain: np.ndarray, into: str) -> DataFrame:
    """table with the floored mean gain of each row's buckets for its packed ones. No shuffle."""
    spark, kind = table.sparkSession, _kind(len(gain))
    shared = spark.sparkContext.broadcast(gain)
    kept = [f for f in table.schema if f.name != packed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tk.column_bytes(batch.column(packed))
            total = np.zeros(len(raw) // int(kind[-1]) + 1, np.int64)
            np.cumsum(shared.value[np.frombuffer(raw.tobytes(), kind)], out=total[1:])
            cut = off // int(kind[-1])
            many = np.diff(cut)
            mean = np.where(many > 0, (total[cut[1:]] - total[cut[:-1]]) // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(mean)], names=[*(f.name for f in kept), into])

    return table.mapInArrow(tk.tidied(run), T.StructType([*kept, T.StructField(into, T.LongType())]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times Gumbel noise from a hash of seed and id, rounded down; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, score: str, tie: list[Column], least: int, into: str, scratch: Scratch) -> DataFrame:
    """rows of a score of `least` or more, with their number from 1 in falling order of score, then by `tie`.

    Rows are dealt by ranges of that order and written; each range is numbered in its own task, behind the sizes of the ranges
    before it, so neither one score of many rows nor all rows meet in one task.
    """
    part, row, ahead = (free(x, rows) for x in ("part_", "row_", "before_"))
    order = [F.col(score).desc(), *tie]
    dealt = rows.where(F.col(score) >= least).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = dealt.withColumn(part, F.spark_partition_id()).sortWithinPartitions(*order)
    dealt = scratch.put(dealt.withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), f"ranges-{into}")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.max(row)).collect())  # a row a range
    before, total = {}, 0
    for p, last in sizes:
        before[p], total = total, total + last + 1
    offset = dealt.sparkSession.createDataFrame([*before.items()] or [(0, 0)], f"`{part}` int, `{ahead}` long")
    numbered = dealt.join(F.broadcast(offset), part)
    return numbered.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(row) + F.col(ahead) + 1).alias(into))


def resample(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, keep_text: bool = True, into: tuple[str, str, str, str] = RESULT) -> DataFrame:
    """All columns of docs (without `text` unless keep_text) and the four of `into`: features, weight, score, and the rank of the
    rows drawn, which is null for the others (columns of docs with these names in any case are replaced).

    Drawn are `percent` of a hundred of the rows of min_words words or more, rounded down, those of the highest scores; ties go
    to the lesser doc_id, a null id last, then by a hash of the text. A null or empty text has no features, weight 0, and is not
    drawn unless min_words is 0. Each of repeated rows has a rank of its own. An empty table stays empty; an empty target
    makes features that are frequent in the documents count less.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    keep = others(docs, *into)
    docs = docs.select(*(F.col(f"`{f.name}`") for f in keep))
    words, features, packed, digest = (free(x, docs) for x in ("words_", "features_", "packed_", "digest_"))
    table = bucket_table(docs, n, buckets, (words, features, packed)).withColumn(digest, F.xxhash64("text"))
    table = scratch.put(table if keep_text else table.drop("text"), "buckets")
    aim = bucket_table(target.select("text"), n, buckets, ("words_", "features_", "packed_"))
    gain = gains(_counted(table, packed, buckets), _counted(aim, "packed_", buckets))

    weight, score = free("weight_", docs), free("score_", docs)
    scored = weighted(table, packed, gain, weight).withColumn(score, F.col(weight) + noise(F.col("doc_id"), seed))
    scored = scratch.put(scored, "scored")
    scratch.drop("buckets")
    able = F.col(words) >= min_words
    # scores are whole numbers between fixed bounds, so they are few: 60,000 or so at any size
    counts = sorted(((r[0], r[1]) for r in scored.where(able).groupBy(score).count().collect()), reverse=True)
    draw, least, above = sum(c for _, c in counts) * percent // 100, None, 0
    for value, c in counts:
        if above >= draw:
            break
        least, above = value, above + c

    out = lambda rank: [*(F.col(f"`{f.name}`") for f in keep if keep_text or f.name != "text"), F.col(features).alias(into[0]), F.col(weight).alias(into[1]), F.col(score).alias(into[2]), rank.cast("long").alias(into[3])]
    if least is None:
        return scored.select(*out(F.lit(None)))
    number = free("number_", scored)
    high = ranked(scored.where(able), score, [F.col("doc_id").asc_nulls_last(), F.col(digest)], least, number, scratch)
    rest = scored.where(~able | (F.col(score) < least))
    return high.select(*out(F.when(F.col(number) <= draw, F.col(number)))).unionByName(rest.select(*out(F.lit(None))))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, load(spark, sf_dir, "benchmark"), keep_text=False).select("doc_id", *RESULT)


#: The same rows in DuckDB; the CRC of each distinct word is found byte by byte from a table made here.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY doc_id, w),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda j: CAST('0x' || substr(h, CAST(2 * j + 1 AS INT), 2) AS BIGINT))),
          lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) % 10000 AS k FROM words, tab),
s AS (SELECT k, sum(n) AS n FROM dw JOIN crc USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN crc USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (k)),
m AS (SELECT doc_id, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN g USING (k) GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (doc_id)),
n AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) * 10 // 100 FROM n) THEN p END AS rank FROM r LEFT JOIN n USING (doc_id)
"""
