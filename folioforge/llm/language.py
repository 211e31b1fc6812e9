"""Language ID: a linear-chain conditional random field over the words of a text.

Each word is described by its byte n-grams, affixes and identity (a lexicon learnt with the rest), hashed into one weight
table; learnt transitions tie neighbouring words, so that code-switched text is labelled by spans. Forward-backward gives
each word's label probabilities, whose sum over a text decides its language. Training splices spans of sample texts of
known language into one another, which is where switches are learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk
from .scratch import others

#: Bounds of what a model is fitted on: rows of each language, rows in all (which all languages share), and bytes of their texts.
SAMPLE = 250
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 12 << 20
#: Labels of words (words times languages) in whole chains that are worked on at a time in the fit.
BATCH = 1 << 20
TABLE_BITS = 18
STEPS = 25
LANE = 64
UNKNOWN = "und"

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64
_TAG = tk.mix(np.arange(900, 964, dtype=_U))


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, offsets by word): n-grams of 1 to 4 bytes with word ends marked, prefixes and suffixes of 2 to 4, the word itself."""
    size = ends - starts + 2
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    b = np.zeros(off[-1] + 4, _U)
    at = np.arange(off[-1]) - np.repeat(off[:-1], size)
    inner = (at > 0) & (at < np.repeat(size, size) - 1)
    b[: off[-1]][inner] = buf[np.repeat(starts - 1, size)[inner] + at[inner]]
    b[off[:-1]] = 2
    b[off[1:] - 1] = 3
    word = np.repeat(np.arange(len(size)), size)
    rows, owner = [hashes ^ _TAG[0]], [np.arange(len(size))]
    room = np.repeat(size, size) - at
    g = np.zeros(off[-1], _U)
    for n in range(1, 5):
        g = g + b[n - 1 : n - 1 + off[-1]] * tk._COEF[n]
        ok = room >= n
        rows.append(tk.mix(g[ok] + _TAG[n]))
        owner.append(word[ok])
        if n > 2:  # affixes are n-grams at the ends, told apart from those within
            head = off[:-1][size >= n]
            rows.append(tk.mix(g[head] + _TAG[10 + n]))
            owner.append(np.flatnonzero(size >= n))
            tail = (off[1:] - n)[size >= n]
            rows.append(tk.mix(g[tail] + _TAG[20 + n]))
            owner.append(np.flatnonzero(size >= n))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    cuts = np.zeros(len(size) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(size)), out=cuts[1:])
    return (rows[order] >> _U(64 - TABLE_BITS)).astype(np.int64), cuts


def _sum_rows(weights: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of the weight rows of each word."""
    if len(cuts) == 1:
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[rows], cuts[:-1], axis=0).astype(np.float64)


def forward_backward(scores: np.ndarray, fresh: np.ndarray, trans: np.ndarray, start: np.ndarray, lane: int = LANE, pairs: bool = False):
    """Label probabilities of each position of many chains laid end to end; fresh marks the first of a chain. With pairs, also
    the expected number of each label pair at neighbouring positions of a chain.

    The positions are dealt into lanes that are worked on side by side: first each lane's product of step matrices, then the
    messages between lanes, then the messages within them. This is exact for chains of any length.
    """
    n, k = scores.shape
    expected = np.zeros((k, k))
    if not n or not k:
        return (scores, expected) if pairs else scores
    c = -(-n // lane)
    e = np.ones((c * lane, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    r = np.ones(c * lane, bool)
    r[:n] = fresh
    r[0] = True
    e, r = e.reshape(c, lane, k), r.reshape(c, lane)
    a, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    prod = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for t in range(lane):
        go = prod @ a
        if (new := r[:, t]).any():
            go[new] = prod[new].sum(axis=2, keepdims=True) * s
        prod = go * e[:, t, None, :]
        prod /= prod.sum(axis=(1, 2), keepdims=True)
    left, right = np.empty((c, k)), np.empty((c, k))
    v = np.full(k, 1 / k)
    for i in range(c):
        left[i] = v
        v = v @ prod[i]
        v /= v.sum()
    v = np.ones(k)
    for i in range(c - 1, -1, -1):
        right[i] = v
        v = prod[i] @ v
        v /= v.sum()
    alpha = np.empty((c, lane, k))
    v = left
    for t in range(lane):
        go = v @ a
        if (new := r[:, t]).any():
            go[new] = v[new].sum(axis=1, keepdims=True) * s
        v = go * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    v = right
    for t in range(lane - 1, -1, -1):
        w = e[:, t] * v
        if pairs and (on := ~r[:, t]).any():  # the step into t: what came before, the transition, what is here and behind
            before = alpha[on, t - 1] if t else left[on]
            both = before[:, :, None] * a * w[on][:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        alpha[:, t] *= v
        go = w @ a.T
        if (new := r[:, t]).any():
            go[new] = (w[new] @ s)[:, None]
        v = go / go.sum(axis=1, keepdims=True)
    alpha = alpha.reshape(-1, k)[:n]
    alpha = alpha / alpha.sum(axis=1, keepdims=True)
    return (alpha, expected) if pairs else alpha


def chain_marginals(scores: np.ndarray, fresh: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What forward_backward gives with pairs, for many chains that aren't long: all chains are gone through side by side, word by word,
    in a time of words times labels squared. The first word begins a chain."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, n))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # chains of more than t words come first
    alpha, expected = np.empty((n, k)), np.zeros((k, k))
    v = np.broadcast_to(s, (len(begin), k))
    for t, m in enumerate(alive.tolist()):
        at = begin[:m] + t
        v = (v[:m] @ a if t else v[:m]) * e[at]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[at] = v
    back = np.ones((len(begin), k))
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        w = e[at] * back[:m]
        if t:  # the step into t: what came before, the transition, what is here and behind
            before = alpha[at - 1]
            expected += a * ((before / ((before @ a) * w).sum(axis=1, keepdims=True)).T @ w)
        alpha[at] *= back[:m]
        go = w @ a.T
        back[:m] = go / go.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True), expected


@dataclass
class Crf:
    """Labels, weight table (float32), transition and start scores."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def word_probabilities(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of each word's labels, first word of each text)."""
        w = tk.Words(buf, off, _LETTERS)
        h, at, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
        emit = _sum_rows(self.weights, *word_features(w.buf, w.starts[at], w.ends[at], h))[inv]
        fresh = np.zeros(len(w), bool)
        fresh[w.first[:-1][w.first[:-1] < len(w)]] = True
        return forward_backward(emit, fresh, self.trans, self.start), w.first


def fit(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 7) -> Crf:
    """Fit by AdaGrad on the likelihood of word labels in spliced texts. Equal inputs give equal models. Beside the texts it holds 4 MB
    and a number a different word for each language, and what BATCH labels of words take."""
    names = sorted(set(labels))
    if not names:
        return Crf([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    k = len(names)
    buf, off = tk.joined(texts)
    w = tk.Words(buf, off, _LETTERS)
    h, at, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
    rows, cuts = word_features(w.buf, w.starts[at], w.ends[at], h)
    y = np.repeat(np.array([names.index(x) for x in labels]), w.counts())
    # spans of 5 to 60 words, in random order, make up chains of a few spans
    rng = np.random.default_rng(seed)
    spans = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        while a < b:
            e = min(b, a + int(rng.integers(5, 61)))
            spans.append((a, e))
            a = e
    order = rng.permutation(len(spans))
    seq = np.concatenate([np.arange(*spans[i]) for i in order] or [np.zeros(0, np.int64)])
    size = np.array([spans[i][1] - spans[i][0] for i in order], np.int64)
    fresh = np.zeros(len(seq), bool)
    if len(seq):
        fresh[(np.cumsum(size) - size)[rng.random(len(size)) < 0.3]] = True
        fresh[0] = True
    inv, y = inv[seq], y[seq]
    follow = ~fresh[1:]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:-1][follow], y[1:][follow]), 1)
    # transitions have a closed form near the optimum when words are telling: the smoothed log frequencies
    trans = np.log((pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True))
    start = np.log((np.bincount(y[fresh], minlength=k) + 0.5) / (fresh.sum() + 0.5 * k))
    weights = np.zeros((1 << TABLE_BITS, k))
    total = np.full((1 << TABLE_BITS, k), 1e-8)
    dt, ds = np.full((k, k), 1e-8), np.full(k, 1e-8)
    owner = np.repeat(np.arange(len(h)), np.diff(cuts))
    begin = np.flatnonzero(fresh)
    each = max(1, BATCH // k)
    ends = np.unique(np.append(begin[np.searchsorted(begin, np.arange(each, len(seq), each)) % max(1, len(begin))], len(seq)))
    ends = ends[ends > 0]
    for _ in range(steps if len(seq) else 0):
        by_kind = _sum_rows(weights, rows, cuts)
        by_word, both, first = np.zeros((len(h), k)), np.zeros((k, k)), np.zeros(k)
        for x, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):  # whole chains, so that the sums are those of all at once
            prob, part = chain_marginals(by_kind[inv[x:z]], fresh[x:z], trans, start)
            both += part
            diff = -prob
            diff[np.arange(z - x), y[x:z]] += 1
            first += diff[fresh[x:z]].sum(axis=0)
            for j in range(k):
                by_word[:, j] += np.bincount(inv[x:z], diff[:, j], len(h))
        for j in range(k):
            grad = np.bincount(rows, by_word[owner, j], 1 << TABLE_BITS) / len(seq) - 1e-7 * weights[:, j]
            total[:, j] += grad * grad
            weights[:, j] += 0.3 * grad / np.sqrt(total[:, j])
        g = (pairs - both) / len(seq)
        dt += g * g
        trans = trans + 0.05 * g / np.sqrt(dt)
        g = first / len(seq)
        ds += g * g
        start = start + 0.05 * g / np.sqrt(ds)
    return Crf(names, weights.astype(np.float32), trans, start)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 3 = 1"), F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE, most_rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Crf:
    """Fit on whole texts of a bounded sample: distinct rows (doc_id, text), per_language of each language at most and no more than an
    equal share of most_rows (one at least), in the order of a hash, languages by turns; a row with which the texts would have
    more than most_bytes is left out.

    The driver gets the sample's texts. Every language with a row that fits is learnt. Null and empty texts and null languages
    teach nothing; rows that repeat id, text and language count once. Without rows the model has no language and calls every
    text `und`.
    """
    spark = docs.sparkSession
    ship(spark)
    able = docs.where(~held_out()).where("lang is not null and text is not null").select("doc_id", "lang", F.expr("xxhash64(doc_id, text) & 9223372036854775807").alias("h"), "text")
    counts = able.groupBy("lang").agg(F.approx_count_distinct("h").alias("total"))
    n = counts.count()
    if not n:
        return fit([], [])
    each = max(1, min(per_language, most_rows // n))
    some = able.join(F.broadcast(counts) if n <= most_rows else counts, "lang").where(F.col("h").cast("double") <= F.lit(2.0**63) * 4 * each / F.greatest("total", F.lit(1)))
    keys = some.select("lang", "h", F.octet_length("text").alias("size")).distinct()
    keys = keys.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= each)
    keep, total = [], 0
    for r in keys.orderBy("nth", "lang").limit(most_rows).collect():  # most_rows rows of numbers at most
        if total + r["size"] <= most_bytes:
            keep.append((r["lang"], r["h"]))
            total += r["size"]
    if not keep:
        return fit([], [])
    picked = F.broadcast(spark.createDataFrame(keep, "lang string, h long"))
    rows = able.join(picked, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", "text").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    return fit(rows["text"].to_pylist(), rows["lang"].to_pylist())


def label(docs: DataFrame, crf: Crf, text: str = "text", spans: bool = False) -> DataFrame:
    """All columns of docs, `lang_pred` and `score`, and with spans the runs of equally labelled words.

    `score` is the probability of the predicted language, the mean of those of the words. A text without a letter, and a null
    or empty one, is `und` with score 0 and no spans. Equal texts get equal labels. A span has its first word, the one past its
    last, and its language. Columns of docs with the names of the added ones, in any case, are replaced. No shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(crf)
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", T.ArrayType(span))] * spans
    kept = others(docs, *(x.name for x in added))
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(text))
            lang, score, runs = [], [], []
            for a, b in tk.chunks(off):
                part, cut = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                prob, first = m.word_probabilities(part, cut)
                for d in range(b - a):
                    p = prob[first[d] : first[d + 1]]
                    if not len(p) or not m.labels or not _has_letter(part[cut[d] : cut[d + 1]]):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        runs.append([])
                        continue
                    mean = p.mean(axis=0)
                    best = int(mean.argmax())
                    lang.append(m.labels[best])
                    score.append(min(1.0, float(mean[best])))
                    if spans:
                        y = p.argmax(axis=1)
                        edge = np.concatenate([[0], np.flatnonzero(np.diff(y)) + 1, [len(y)]]).tolist()
                        runs.append([{"first": x, "end": z, "lang": m.labels[y[x]]} for x, z in zip(edge[:-1], edge[1:], strict=True)])
            cols = [batch.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(tk.tidied(run), schema)


def _has_letter(raw: np.ndarray) -> bool:
    if (_LETTERS[raw] & (raw < 128)).any():
        return True
    return any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    crf = train(docs.select("doc_id", "text", "lang"))
    return label(docs.select("doc_id", "text"), crf).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
