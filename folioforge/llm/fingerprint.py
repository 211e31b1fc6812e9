"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

One hash per five-word shingle; its top bits name a bin and each bin keeps its least hash. Empty bins take
the value of the first filled bin in a fixed pseudo-random order of their own (optimal densification), and
of every bin only the low-order bits are stored. Likeness corrects for equal low bits by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk
from .scratch import others

BINS = 512
BITS = 8
SHINGLE = 5
_ATTEMPTS = 12
_EMPTY = np.uint64(2**64 - 1)
_order_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin, the other bins in its own order, and each bin's rank in it."""
    if bins not in _order_cache:
        rng = np.random.Generator(np.random.PCG64(20_17))
        order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
        _order_cache[bins] = order, np.argsort(order, axis=1).astype(np.int32)
    return _order_cache[bins]


def densify(table: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a filled one."""
    order, rank = _orders(table.shape[1])
    filled = table != _EMPTY
    out = table.copy()
    some = filled.any(axis=1)
    row, col = np.nonzero(~filled & some[:, None])
    for k in range(_ATTEMPTS):
        if not len(row):
            return out
        donor = order[col, k]
        hit = filled[row, donor]
        out[row[hit], col[hit]] = table[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
    cuts = np.flatnonzero(np.diff(row)) + 1
    for part in np.split(np.arange(len(row)), cuts) if len(row) else []:
        r, have = row[part[0]], np.flatnonzero(filled[row[part[0]]])
        out[r, col[part]] = table[r, have[rank[np.ix_(col[part], have)].argmin(axis=1)]]
    return out


def sketch(buf: np.ndarray, off: np.ndarray, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(packed rows of uint8, whether the document has words) of one chunk of texts."""
    if bins & (bins - 1) or 8 % bits:
        raise ValueError("bins must be a power of two and bits divide 8")
    w = tk.Words(buf, off)
    sh, first = tk.shingles(w.hashes(), w.first, k)
    n = len(off) - 1
    table = np.full(n * bins, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(table, doc * bins + (sh >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), sh & np.uint64((1 << 54) - 1))
    table = densify(table.reshape(n, bins))
    low = (tk.mix(table) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits < 8:
        per = 8 // bits
        low = np.bitwise_or.reduce(low.reshape(n, bins // per, per) << (np.arange(per, dtype=np.uint8) * bits), axis=2)
    return low, np.diff(first) > 0


def unpack(rows: np.ndarray, bits: int) -> np.ndarray:
    if bits == 8:
        return rows
    per = 8 // bits
    return ((rows[..., None] >> (np.arange(per, dtype=np.uint8) * bits)) & ((1 << bits) - 1)).reshape(*rows.shape[:-1], -1)


def likeness(a: np.ndarray, b: np.ndarray, a_words: np.ndarray, b_words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of packed rows, corrected for chance; 1 if both are without words, 0 if one is."""
    same = (unpack(a, bits) == unpack(b, bits)).mean(axis=1)
    c = 2.0**-bits
    est = np.clip((same - c) / (1 - c), 0.0, 1.0)
    return np.where(a_words & b_words, est, np.where(a_words == b_words, 1.0, 0.0))


def sketch_texts(texts: list[str], bins: int, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = tk.joined(texts)
    rows, some = [np.zeros((0, bins * bits // 8), np.uint8)], [np.zeros(0, bool)]
    for a, b in tk.chunks(off, max_docs=500):
        r, s = sketch(buf[off[a] : off[b]], off[a : b + 1] - off[a], bins, bits, k)
        rows.append(r)
        some.append(s)
    return np.concatenate(rows), np.concatenate(some)


def _hex(rows: np.ndarray, words: np.ndarray) -> list[str]:
    return [r.tobytes().hex() if w else "" for r, w in zip(rows, words, strict=True)]


def fingerprints(df: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """All columns of df and `fingerprint` (hex; empty for a null or wordless text), which replaces a column of that name in any
    case. Equal texts have equal ones. No shuffle."""
    ship(df.sparkSession)
    kept = others(df, "fingerprint")
    schema = T.StructType([*kept, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(text))
            out: list[str] = []
            for a, b in tk.chunks(off, max_docs=500):
                out += _hex(*sketch(buf[off[a] : off[b]], off[a : b + 1] - off[a], bins, bits, k))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.string())], names=schema.names)

    return df.mapInArrow(tk.tidied(run), schema)


_LEAST = -(2**63)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rows id, h, t, copy, bucket; number of buckets): each row has a bucket of consecutive places in the order of
    (id, hash of the text); the first rows of a bucket also go, as copies, to the bucket before it (of the first: the last).

    Buckets are cut at quantiles of the id; where one id (or the lack of one) spans several, these are cut at even steps of
    the hash. Only the bounds and each bucket's least place, two numbers a bucket, come to the driver. The text is shuffled once.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.when(F.col("doc_id").isNull(), F.lit(_LEAST)).otherwise(F.greatest(F.col("doc_id").cast("long"), F.lit(_LEAST + 1)))
    rows = docs.select(place.alias("i"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    cuts = rows.agg(F.percentile_approx("i", [k / n for k in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("q")).first()["q"] or []
    ids, spans = np.unique(np.array(cuts, np.int64), return_counts=True)
    # a bound is the least (id, hash) of a bucket; an id that is several quantiles gets as many bounds
    bounds = [(int(i), _LEAST + int(k * 2**64 // int(m))) for i, m in zip(ids, spans, strict=True) for k in range(int(m))]
    low = np.array([b[0] for b in bounds], np.int64)
    steps = np.array([b[1] for b in bounds], np.int64)

    def bucket_of(i: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of bounds at or below (i, h)."""
        out, end = np.searchsorted(low, i, "left"), np.searchsorted(low, i, "right")
        for j in np.flatnonzero(end - out > 0):
            out[j] += np.searchsorted(steps[out[j] : end[j]], h[j], "right")
        return out.astype(np.int32)

    @F.pandas_udf(T.IntegerType())
    def bucket(i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(i.to_numpy(), h.to_numpy()))

    placed = rows.withColumn("own", bucket("i", "h"))
    least = {r["own"]: (r["m"]["i"], r["m"]["h"]) for r in placed.groupBy("own").agg(F.min(F.struct("i", "h")).alias("m")).collect()}
    order = sorted(least)
    firsts = spark.createDataFrame([(b, *least[b], order[k - 1]) for k, b in enumerate(order)], "own int, i0 long, h0 long, before int")
    placed = placed.join(F.broadcast(firsts), "own", "left")  # one row a bucket
    to = F.when((F.col("i") == F.col("i0")) & (F.col("h") == F.col("h0")), F.array("own", "before")).otherwise(F.array("own"))
    return placed.select("id", "h", "t", F.posexplode(to).alias("copy", "bucket")), max(1, len(order))


def edited_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """Fingerprint of each text and of its edited text, and likeness to that and to the next document's.

    Documents are in ascending doc_id (a null id first), ties by a hash of the text, then by the text; the one after the last is
    the first. A null text is empty. Repeated rows are rows of their own, and follow one another. Other columns of docs are
    ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, n = with_next(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", F.asc_nulls_first("id"), "h", "t")

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: (bucket, copy, id, text); rows that have a successor in it and aren't copies are done."""
        own = [x for x, y in zip(held, held[1:], strict=False) if x[1] == 0 and y[0] == x[0]]
        if not own:
            return
        texts = [h[3] for h in held]
        fp, some = sketch_texts(texts, bins, bits, k)
        at = [j for j, (x, y) in enumerate(zip(held, held[1:], strict=False)) if x[1] == 0 and y[0] == x[0]]
        edited = [texts[j][: len(texts[j]) - len(texts[j]) // 2] + texts[j + 1][: len(texts[j]) // 2] for j in at]
        efp, esome = sketch_texts(edited, bins, bits, k)
        at, nx = np.array(at), np.array(at) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([held[j][2] for j in at], pa.int64()),
                pa.array([len(texts[j]) for j in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array(_hex(fp[at], some[at]), pa.string()),
                pa.array(_hex(efp, esome), pa.string()),
                pa.array(likeness(fp[at], efp, some[at], esome, bits), pa.float64()),
                pa.array(likeness(fp[at], fp[nx], some[at], some[nx], bits), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids, copies, buckets = (batch.column(c).to_pylist() for c in ("id", "copy", "bucket"))
            for j in range(batch.num_rows):
                t = batch.column("t")[j].as_py() or ""
                held.append((buckets[j], copies[j], ids[j], t))
                size += len(t)
                if size > tk.CHUNK_BYTES or len(held) > 1000:
                    yield from emit(held)
                    held = held[-1:]
                    size = len(held[0][3])
        yield from emit(held)

    return rows.mapInArrow(tk.tidied(run), schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(load(spark, sf_dir, "documents").select("doc_id", "text"))
