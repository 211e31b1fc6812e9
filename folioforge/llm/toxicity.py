"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 32-bit hashes of its words, adjacent word pairs and pairs one word apart.
Training runs on a bounded labelled sample with per-coordinate learning rates and L1, which leaves a few
thousand non-zero weights; these are broadcast, and scoring is one map over the documents without a shuffle.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, free, others

#: Labelled rows that a model is fitted on at most, and bytes of their texts, each of which is learnt from as a whole.
SAMPLE = 12000
SAMPLE_BYTES = 80 << 20
#: A feature must stand in so many documents of the sample.
MIN_DOCS = 3
THRESHOLD = 0.3
EPOCHS = 5
#: L1 grows with the sample, since the gradients that it is weighed against are summed over it.
L1_EACH, L1_LEAST = 6e-4, 1.0
#: Feature ids of the sample that the driver counts at a time.
COUNT_IDS = 1 << 18


class Mapped:
    """Arrays that are written one by one to a file without a name in the driver's temporary folder and mapped when all are there:
    only what is looked at just now is in memory."""

    def __init__(self, dtype: type):
        self.dtype, self.ends, self.file = np.dtype(dtype), [0], tempfile.TemporaryFile()

    def add(self, values: np.ndarray | bytes) -> None:
        self.ends.append(self.ends[-1] + self.file.write(values) // self.dtype.itemsize)

    def arrays(self) -> list[np.ndarray]:
        with self.file as f:
            f.flush()
            every = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), self.dtype) if self.ends[-1] else np.zeros(0, self.dtype)
        return [every[a:b] for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, document index) of a chunk of texts, with repeats."""
    w = tk.Words(buf, off, tk.ALNUM)
    h, doc = w.hashes(), w.doc_of()
    ids, docs = [h], [doc]
    for gap, (c, d) in ((1, tk._COEF[50:52]), (2, tk._COEF[52:54])):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            ids.append(tk.mix(h[:-gap] * c + h[gap:] * d)[same])
            docs.append(doc[gap:][same])
    return (np.concatenate(ids) >> np.uint64(32)).astype(np.uint32), np.concatenate(docs)


@dataclass
class Weights:
    """Sorted feature ids with non-zero weights, and the intercept."""

    ids: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        z = np.full(n, self.bias)
        if len(self.ids):
            ids, doc = features(buf, off)
            maybe = np.zeros(1 << 22, bool)
            maybe[self.ids & 0x3FFFFF] = True
            at = np.flatnonzero(maybe[ids & 0x3FFFFF])
            ids, doc = ids[at], doc[at]
            k = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[k] == ids
            pair = np.unique(doc[hit] * len(self.ids) + k[hit])  # a feature counts once in a document
            np.add.at(z, pair // len(self.ids), self.values[pair % len(self.ids)])
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def vocabulary(rows: list[np.ndarray], min_docs: int) -> np.ndarray:
    """The ids, in order, that stand in min_docs rows or more. Ids are hashes, so ranges of them, which are counted one after the
    other, have about COUNT_IDS each."""
    parts = sum(map(len, rows)) // COUNT_IDS + 1
    edges = (np.arange(1, parts) * (2**32 // parts)).astype(np.uint32)
    cuts = [np.concatenate([[0], np.searchsorted(r, edges), [len(r)]]).astype(np.int32) for r in rows]
    out = []
    for j in range(parts):
        ids, many = np.unique(np.concatenate([r[c[j] : c[j + 1]] for r, c in zip(rows, cuts, strict=True)]), return_counts=True)
        out.append(ids[many >= min_docs])
    return np.concatenate(out)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float | None = None, l2: float = 0.1, epochs: int = EPOCHS, min_docs: int = MIN_DOCS) -> Weights:
    """Fit by FTRL-proximal; each row holds the distinct feature ids of one document. Beside the rows, memory is needed for
    what stands in min_docs of them or more, some 20 bytes a feature, and for COUNT_IDS ids."""
    if not rows:
        return Weights(np.zeros(0, np.uint32), np.zeros(0), -2.0)  # nothing learnt: no text is rejected
    l1 = max(L1_LEAST, L1_EACH * len(rows)) if l1 is None else l1
    rows = [r if (r[:-1] <= r[1:]).all() else np.sort(r) for r in rows]
    vocab = vocabulary(rows, min_docs)
    places = Mapped(np.int32)
    for r in rows:
        k = np.minimum(np.searchsorted(vocab, r), max(0, len(vocab) - 1))
        places.add(k[vocab[k] == r].astype(np.int32) if len(vocab) else np.zeros(0, np.int32))
    index = places.arrays()
    z, n = np.zeros(len(vocab)), np.zeros(len(vocab))
    zb = nb = 0.0
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            k, y = index[j], labels[j]
            zk, nk = z[k], n[k]
            wk = np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(nk)) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(wb + wk.sum(), -35, 35))) - y
            root = np.sqrt(nk + g * g)
            z[k] = zk + g - (root - np.sqrt(nk)) / alpha * wk
            n[k] = nk + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    on = np.abs(z) > l1
    w = -(z[on] - np.sign(z[on]) * l1) / ((beta + np.sqrt(n[on])) / alpha + l2)
    return Weights(vocab[on], w, float(-zb / ((beta + nb**0.5) / alpha)))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 4 = 2"), F.lit(False))


def sample_labels(labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """At most n labelled ids in the order of a hash. Repeated labels of an id count as toxic if one does."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h = F.expr("xxhash64(doc_id, 4) & 9223372036854775807")
    total = rows.count()
    if total > 2 * n:
        rows = rows.where(h <= int(2.0**63 * 2 * n / total))
    return rows.orderBy(h, "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, n: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Weights:
    """Fit on a bounded sample: at most n distinct rows (doc_id, text) with a label, in the order of a hash of both, those left out
    with which the texts would have more than most_bytes.

    Executors make the features, the driver gets only those of the sample, about twice most_bytes, a partition at a time, and
    keeps them in a mapped temporary file. Labels of null or held-out ids and
    null labels are not learnt; a null or empty text has no features; rows that repeat an id with other texts are rows of their
    own, those that repeat both count once. Without a labelled document the weights reject nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, n)), "doc_id")
    picked = picked.select("doc_id", "toxic", F.expr("xxhash64(doc_id, text) & 9223372036854775807").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column("text"))
            out = []
            for a, b in tk.chunks(off):
                ids, doc = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                pair = np.unique((doc.astype(np.uint64) << np.uint64(32)) | ids)  # by document, then by hash
                cut = np.searchsorted(pair >> np.uint64(32), np.arange(b - a + 1).astype(np.uint64))
                out += [(pair[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "size")), batch.column("toxic").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "h", "size", "toxic", "ids"])

    made = picked.mapInArrow(tk.tidied(run), "doc_id long, h long, size long, toxic int, ids binary")
    scratch = Scratch(spark, "toxicity")
    table = scratch.put(made.groupBy("doc_id", "h").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size"), F.first("ids").alias("ids")), "features")
    keys = table.select("h", "doc_id", "size").orderBy("h", "doc_id").limit(n).toArrow()  # n rows of numbers at most
    keep, total = [], 0
    for h, i, size in zip(*(keys[c].to_pylist() for c in ("h", "doc_id", "size")), strict=True):
        if total + size <= most_bytes:
            keep.append((h, i))
            total += size
    if not keep:
        return ftrl([], np.zeros(0))
    rows = table.select("h", "doc_id", "toxic", "ids").join(F.broadcast(spark.createDataFrame(keep, "h long, doc_id long")), ["h", "doc_id"])
    ids, of = Mapped(np.uint32), []
    for r in rows.toLocalIterator():
        ids.add(r["ids"])
        of.append((r["h"], r["doc_id"], r["toxic"]))
    scratch.drop()
    tk.tidy()
    each = ids.arrays()
    order = sorted(range(len(of)), key=of.__getitem__)
    out = ftrl([each[j] for j in order], np.array([of[j][2] for j in order], float))
    del each
    tk.tidy()
    return out


def score(docs: DataFrame, weights: Weights, text: str = "text", threshold: float = THRESHOLD, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs and the two of `into`, the score and whether it reaches the threshold (columns of docs with these
    names in any case are replaced). A null or empty text gets the intercept's score. Equal texts score alike. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)
    kept = others(docs, *into)
    names = [*(f.name for f in kept), *into]
    schema = T.StructType([*kept, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(text))
            s = np.concatenate([w.score(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in tk.chunks(off)] or [np.zeros(0)])
            cols = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return docs.mapInArrow(tk.tidied(run), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    w = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, w).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't reject, with all their columns. Null and empty texts, null ids and repeated rows are
    judged each by its text; an empty table stays empty."""
    w = train(docs, load(spark, sf_dir, "labels"))
    bad = free("predicted_", docs)
    return score(docs, w, into=(free("score_", docs), bad)).where(F.col(bad) == 0).select(*docs.columns)
