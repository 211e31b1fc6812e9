"""Substring dedup by recompression.

A text's words are its symbols. A round names every maximal run of one symbol, then, with symbols dealt into a left and
a right half by a bit of their name, every pair of a left and a following right symbol. Names are 64-bit functions of the
parts' names, so equal parts get equal names in every document. Spark rounds over the corpus then

(1) give exact copies of a text to the first of them;
(2) screen: how far a symbol's making looked to either side is tracked, so that the symbols of which a window of words alone
decides are known. Each window is represented by one of them, its anchor: one that took 4 to 8 words to make, which leaves
room for neighbouring windows to agree, else any; the largest hash decides. Every window has one, for single words are
symbols too, and equal windows have equal anchors. Words under no window whose anchor stands in two documents are set aside;
(3) name: on what is left, every Spark round makes runs and pairs of runs and pairs, collects the dictionary of all names with
the first and last document of each, and cuts the symbols that no second document has. What lies within a long repeat is
named alike in all its places, so it stays and grows from round to round;
(4) reveal and verify: a symbol of 13 words or more that an earlier document shares is a repeat, all its windows with it. Every
symbol carries, beside its name, a second hash that is made from other hashes of the words' bytes; in each dictionary it must
be the same wherever the name is, or the job ends with an error;
(5) name the windows at the borders of these symbols, under shared anchors, by two independent hashes (124 bits), with the first
document of each; and take out the words under symbols and windows of an earlier document.

A remark: a name is a function of its parts, not a number that a dictionary deals out, so that no round has to send every
pair of the corpus to its number and back; dictionaries decide what is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, join_hot, small

WINDOW = 13
#: Levels of runs and pairs of the screen, and those that each Spark round of naming adds to its symbols.
ROUNDS = 4
LEVELS = (5, 3, 3)
PREFERRED = (4, 8)
#: Words that are worked on at a time; a longer text is in segments that overlap by WINDOW - 1 words, which changes no window.
SEGMENT = 200_000
_U = np.uint64
_SEED = tk.mix(np.arange(77, 77 + 64, dtype=_U))
_GAP = _U(0)


def segments(first: np.ndarray, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, one past the last word) of the pieces of all documents with at least w words."""
    doc, a, b = [], [], []
    for d, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        while y - x >= w:
            e = min(y, x + SEGMENT)
            doc.append(d)
            a.append(x)
            b.append(e)
            if e == y:
                break
            x = e - w + 1
    return np.array(doc, np.int64), np.array(a, np.int64), np.array(b, np.int64)


def anchors(name: np.ndarray, w: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of the window that starts at each position of name; gaps between texts are 0, and no window spans one."""
    n = len(name)
    up, down = tk._pows(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(tk.mix(name) * up[:n], out=sums[1:])
    lo = hi = np.arange(n)
    entries: list[list[tuple]] = [[] for _ in range(w + 1)]  # by length: starts of what symbols of one level were made from, and their keys (hashes of it all)
    for level in range(rounds + 1):
        if level:
            # runs: a symbol is known to end a run only with its neighbours
            head = np.ones(len(name), bool)
            head[1:] = (name[1:] != name[:-1]) | (name[1:] == _GAP)
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(name)) - 1
            size = (last - at + 1).astype(_U)
            run = np.where(size > 1, tk.mix(name[at] * _SEED[2] + size), name[at])
            lo, hi, name = lo[np.maximum(at - 1, 0)], hi[np.minimum(last + 1, len(hi) - 1)], run
            # pairs: a left symbol and the right one behind it
            side = tk.mix(name ^ _SEED[4 + level]) >> _U(63)
            real = name != _GAP
            left, right = real & (side == 0), real & (side == 1)
            two = np.zeros(len(name), bool)
            two[:-1] = left[:-1] & right[1:]
            second = np.zeros(len(name), bool)
            second[1:] = two[:-1]
            nxt_hi, prv_lo = np.append(hi[1:], hi[-1:]), np.append(lo[:1], lo[:-1])
            nxt = np.append(name[1:], name[-1:])
            hi2 = np.where(left, nxt_hi, hi)
            lo2 = np.where(right, prv_lo, lo)
            name = np.where(two, tk.mix(name * _SEED[40] + nxt * _SEED[41] + _U(level)), name)[~second]
            lo, hi = lo2[~second], hi2[~second]
        span = hi - lo + 1
        ok = (span <= w) & (name != _GAP)
        if not ok.any():
            break
        s, length = lo[ok], span[ok]
        h = tk.mix((sums[s + length] - sums[s]) * down[s] + _SEED[20 + level] * length.astype(_U))
        key = ((length >= PREFERRED[0]) & (length <= PREFERRED[1])).astype(_U) << _U(60) | h >> _U(4)
        order = np.argsort(length.astype(np.int16), kind="stable")
        s, key = s[order], key[order]
        end = np.cumsum(np.bincount(length, minlength=w + 1))
        for d in range(1, w + 1):
            if end[d] > end[d - 1]:
                entries[d].append((s[end[d - 1] : end[d]], key[end[d - 1] : end[d]]))
    best = np.zeros(n, _U)
    for d in range(1, w + 1):
        if d > 1:
            np.maximum(best[:-1], best[1:], out=best[:-1])
        for s, key in entries[d]:
            best[s] = np.maximum(best[s], key)
    return best


class Windows:
    """Anchors and hashes of all windows of some segments; doc and pos (word number in the document) of each. Anchors are made from
    the word hashes h, window hashes from g."""

    __slots__ = ("doc", "pos", "anchor", "hash")

    def __init__(self, h: np.ndarray, g: np.ndarray, first: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, w: int = WINDOW):
        size = b - a
        start = np.cumsum(size + 1) - size  # each segment follows a gap
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        to, src = np.repeat(start, size) + within, np.repeat(a, size) + within
        name, other = np.zeros(int(size.sum()) + len(size) + 1, _U), np.zeros(int(size.sum()) + len(size) + 1, _U)
        name[to], other[to] = h[src], g[src]
        nw = size - w + 1
        within = np.arange(int(nw.sum())) - np.repeat(np.cumsum(nw) - nw, nw)
        win = np.repeat(start, nw) + within
        self.doc = np.repeat(doc, nw)
        self.pos = np.repeat(a - first[doc], nw) + within
        self.anchor = anchors(name, w)[win]
        up, down = tk._pows(len(name) + 1)
        sums = np.zeros(len(name) + 1, _U)
        np.cumsum(tk.mix(other ^ _SEED[60]) * up[: len(name)], out=sums[1:])
        self.hash = tk.mix((sums[win + w] - sums[win]) * down[win])


def word_hashes(words: tk.Words) -> np.ndarray:
    """The names of single words; none is that of a gap."""
    h = words.hashes()
    h[h == _GAP] = _U(1)
    return h


def windows_of(words: tk.Words, h: np.ndarray, g: np.ndarray, w: int = WINDOW) -> Iterator[Windows]:
    """Windows of a chunk's documents, some segments at a time."""
    doc, a, b = segments(words.first, w)
    group = np.cumsum(b - a) // SEGMENT
    for x, y in zip(np.searchsorted(group, np.unique(group)).tolist(), np.searchsorted(group, np.unique(group), "right").tolist(), strict=True):
        yield Windows(h, g, words.first, doc[x:y], a[x:y], b[x:y], w)


class Symbols:
    """Symbols of many documents laid end to end: name, second hash, the words first:last of each, and the row of its document."""

    __slots__ = ("name", "check", "a", "b", "row")

    def __init__(self, name: np.ndarray, check: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray):
        self.name, self.check, self.a, self.b, self.row = name, check, a, b, row

    def take(self, on: np.ndarray) -> Symbols:
        return Symbols(self.name[on], self.check[on], self.a[on], self.b[on], self.row[on])

    def step(self, seed: int) -> Symbols:
        """A round of runs and pairs. Symbols that don't touch stay apart."""
        n = len(self.name)
        if n < 2:
            return self
        touch = np.append(False, (self.a[1:] == self.b[:-1]) & (self.row[1:] == self.row[:-1]))
        head = ~touch
        head[1:] |= self.name[1:] != self.name[:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, n)).astype(_U)
        s = self.take(at)
        s.b = self.b[np.append(at[1:], n) - 1]
        run = size > 1
        s.name = np.where(run, tk.mix(s.name * _SEED[42] + size), s.name)
        s.check = np.where(run, tk.mix(s.check * _SEED[46] ^ size), s.check)
        touch = touch[at]
        side = tk.mix(s.name ^ _SEED[43] ^ _U(seed)) >> _U(63)
        second = np.append(False, (side[:-1] == 0) & (side[1:] == 1)) & touch
        left = np.flatnonzero(second) - 1
        s.name[left] = tk.mix(s.name[left] * _SEED[44] + s.name[left + 1] * _SEED[45] + _U(seed))
        s.check[left] = tk.mix(s.check[left] * _SEED[47] + s.check[left + 1] * _SEED[48])
        s.b[left] = s.b[left + 1]
        return s.take(~second)

    def steps(self, levels: int, seed: int) -> Symbols:
        s = self
        for level in range(levels):
            s = s.step(seed + level)
        return s


_LAST = 2**63 - 1
_KEY = ["i", "k"]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = tk.column_bytes(batch.column("text"))
    for a, b in tk.chunks(off):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY)


def _longs(*cols: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == _U else c.astype(np.int64)) for c in cols]


def _flat(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each value, values) of a column of lists; of null lists none."""
    size = np.diff(col.offsets.to_numpy()) if not col.null_count else np.array([len(x) if x.is_valid else 0 for x in col], np.int64)
    return np.repeat(np.arange(len(size)), size), col.flatten()


def _number(values: pa.Array, kind: type = np.int64) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _lists(row: np.ndarray, n: int, *cols: np.ndarray) -> list[pa.Array]:
    """Columns of lists from values in the order of their rows."""
    off = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(off, pa.array(c.view(np.int64) if c.dtype == _U else c)) for c in cols]


def _of_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys of (value, row)."""
    return tk.mix(values.view(_U) ^ tk.mix(row.astype(_U) + _SEED[50]))


def occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, i, k): the anchors of each document's windows, each at least once. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k = _ids(batch)
            for x, _, buf, off in _chunks(batch):
                words = tk.Words(buf, off, lower=False)
                h = word_hashes(words)
                for w in windows_of(words, h, h):
                    new = np.ones(len(w.doc), bool)
                    new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])
                    anchor, doc = w.anchor[new], w.doc[new]
                    order = np.lexsort((anchor, doc))
                    anchor, doc = anchor[order], doc[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays(_longs(anchor[new], i[x + doc[new]], k[x + doc[new]]), names=["anchor", *_KEY])

    return docs.select(*_KEY, "text").mapInArrow(tk.tidied(run), "anchor long, i long, k long")


_SYMBOLS = {"name": "array<long>", "check": "array<long>", "a": "array<int>", "b": "array<int>"}
_WINDOWS = {"pos": "array<int>", "anchor": "array<long>", "hash": "array<long>"}


def _schema(cols: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in ({"i": "long", "k": "long"} | cols).items())


def live(docs: DataFrame, levels: int) -> DataFrame:
    """Of each document, its windows whose anchor is in `wanted` (pos, anchor, hash), and the first Spark round's symbols of the
    words under them (name, check, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k = _ids(batch)
            row, values = _flat(batch.column("wanted"))
            wanted = _of_row(_number(values), row)
            for x, y, buf, off in _chunks(batch):
                words = tk.Words(buf, off, lower=False)
                h, g = word_hashes(words), words.hashes(other=True)
                edge = np.zeros(len(words) + 1, np.int32)
                parts: list[tuple] = []
                for w in windows_of(words, h, g):
                    on = np.isin(_of_row(w.anchor, x + w.doc), wanted)
                    at = w.pos[on] + words.first[w.doc[on]]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    parts.append((w.doc[on], w.pos[on], w.anchor[on], w.hash[on]))
                stays = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                doc = words.doc_of()[stays]
                at = stays - words.first[doc]
                s = Symbols(h[stays], g[stays], at, at + 1, doc).steps(levels, 0)
                win = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, _U)] * 2
                cols = _lists(s.row, y - x, s.name, s.check, s.a.astype(np.int32), s.b.astype(np.int32)) + _lists(win[0], y - x, win[1].astype(np.int32), win[2], win[3])
                yield pa.RecordBatch.from_arrays([*_longs(i[x:y], k[x:y]), *cols], names=[*_KEY, *_SYMBOLS, *_WINDOWS])

    return docs.select(*_KEY, "text", "wanted").mapInArrow(tk.tidied(run), _schema(_SYMBOLS | _WINDOWS))


def next_symbols(symbols: DataFrame, levels: int, seed: int) -> DataFrame:
    """The symbols of the next Spark round: those that aren't in `shared` are cut, the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row, name), (of, shared) = _flat(batch.column("name")), _flat(batch.column("shared"))
            rest = [_number(batch.column(c).flatten()) for c in ("check", "a", "b")]
            name = _number(name)
            s = Symbols(name.view(_U), rest[0].view(_U), rest[1], rest[2], row).take(np.isin(_of_row(name, row), _of_row(_number(shared), of)))
            s = s.steps(levels, seed)
            cols = _lists(s.row, batch.num_rows, s.name, s.check, s.a.astype(np.int32), s.b.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), *cols], names=[*_KEY, *_SYMBOLS])

    return symbols.select(*_KEY, *_SYMBOLS, "shared").mapInArrow(tk.tidied(run), _schema(_SYMBOLS))


def dictionary(places: DataFrame, *by: str) -> DataFrame:
    """by, `lo`, the first document, and `times`, of the names (columns `by`) that stand in two documents of different ids."""
    return places.groupBy(*by).agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("times")).where("lo < hi").select(*by, "lo", "times")


def verified(places: DataFrame) -> DataFrame:
    """The dictionary of places (name, check, i): a name with two second hashes is an error."""
    seen = places.groupBy("name").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("times"), F.min("check").alias("c"), F.max("check").alias("d"))
    same = F.when(F.col("c") == F.col("d"), F.col("lo")).otherwise(F.raise_error(F.lit("different words have one name")))
    return seen.where("lo < hi").select("name", same.alias("lo"), "times")


def long_symbols(at: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, k, a, b): the symbols of WINDOW words or more that an earlier document shares, after all rounds of naming."""
    for r, levels in enumerate(LEVELS[1:], 1):
        names = at.select(*_KEY, F.explode(F.arrays_zip("name", "check")).alias("s")).select(*_KEY, "s.*").distinct()
        names = scratch.put(names, f"names-{r}")
        known = scratch.put(verified(names), f"shared-{r}")
        shared = join_hot(names, known, ["name"], "inner", "times").groupBy(*_KEY).agg(F.collect_set("name").alias("shared"))
        at = scratch.put(next_symbols(at.join(shared, _KEY), levels, 100 * r), f"symbols-{r}")
        scratch.drop(f"names-{r}", f"shared-{r}", f"symbols-{r - 1}")
    places = at.select(*_KEY, F.explode(F.arrays_zip("name", "check", "a", "b")).alias("s")).select(*_KEY, "s.*").where(f"b - a >= {WINDOW}")
    places = scratch.put(places, "places")
    known = scratch.put(verified(places), "long")
    return join_hot(places, known, ["name"], "inner", "times").where("i > lo").select(*_KEY, "a", "b")


def border_windows(rows: DataFrame) -> DataFrame:
    """(anchor, hash, i, k): the distinct live windows of each document, but those within its `long`, structs a, b of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k = _ids(batch)
            (row, anchor), (of, long) = _flat(batch.column("anchor")), _flat(batch.column("long"))
            anchor, h, pos = _number(anchor), _number(batch.column("hash").flatten()), _number(batch.column("pos").flatten())
            on = ~_within(row, pos, pos + WINDOW, of, *(_number(long.field(c)) for c in ("a", "b")))
            row, anchor, h = row[on], anchor[on], h[on]
            order = np.lexsort((h, row))
            row, anchor, h = row[order], anchor[order], h[order]
            new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (anchor[1:] != anchor[:-1]))[: len(row)]
            yield pa.RecordBatch.from_arrays(_longs(anchor[new], h[new], i[row[new]], k[row[new]]), names=["anchor", "hash", *_KEY])

    return rows.select(*_KEY, *_WINDOWS, "long").mapInArrow(tk.tidied(run), "anchor long, hash long, i long, k long")


def _within(row: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the span a:b of a row lies in one of the disjoint spans x:y of that row (`of`)."""
    if not len(of):
        return np.zeros(len(row), bool)
    order = np.lexsort((x, of))
    of, x, y = of[order], x[order], y[order]
    at = np.searchsorted((of << 40) + x, (row << 40) + a, "right") - 1
    return (at >= 0) & (of[at] == row) & (b <= y[at])


def spans(rows: DataFrame) -> DataFrame:
    """(i, k, cut): the spans of words of each document, as pairs first, end one after the other, under its live windows that are in
    `gone` or within its `long`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row, h), (of, gone), (own, long) = (_flat(batch.column(c)) for c in ("hash", "gone", "long"))
            pos = _number(batch.column("pos").flatten())
            on = np.isin(_of_row(_number(h), row), _of_row(_number(gone), of))
            row = np.concatenate([row[on], own])
            a = np.concatenate([pos[on], _number(long.field("a"))])
            b = np.concatenate([pos[on] + WINDOW, _number(long.field("b"))])
            order = np.lexsort((a, row))
            row, a, b = row[order], a[order], b[order]
            if len(row):  # ends that go before count within a row only: rows are set far apart
                far = row << 40
                reach = np.maximum.accumulate(far + b)
                head = np.append(True, far[1:] + a[1:] > reach[:-1])
                first = np.flatnonzero(head)
                row, a, b = row[first], a[first], (reach - far)[np.append(first[1:], len(head)) - 1]
            flat = np.stack([a, b], axis=1).astype(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), *_lists(np.repeat(row, 2), batch.num_rows, flat)], names=[*_KEY, "cut"])

    return rows.select(*_KEY, "pos", "hash", "gone", "long").mapInArrow(tk.tidied(run), "i long, k long, cut array<long>")


def _cut(docs: DataFrame, kept_text: bool) -> DataFrame:
    """n_words, n_removed and the kept words (their hash, or they themselves) of texts with `copy` and `cut`, the spans to take out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, cut = batch.column("copy").to_pylist(), batch.column("cut").to_pylist()
            total, removed, kept = [], [], []
            for x, _, buf, off in _chunks(batch):
                raw = buf.tobytes()
                for d in range(len(off) - 1):
                    own = raw[off[d] : off[d + 1]].split()
                    left = own
                    if copy[x + d] and len(own) >= WINDOW:
                        left = []
                    elif cut[x + d]:
                        bounds = [0, *cut[x + d], len(own)]
                        left = [v for p, q in zip(bounds[::2], bounds[1::2], strict=True) for v in own[p:q]]
                    text = b" ".join(left)
                    total.append(len(own))
                    removed.append(len(own) - len(left))
                    kept.append(text.decode("utf-8", "replace") if kept_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return docs.select("doc_id", "text", "copy", "cut").mapInArrow(tk.tidied(run), "doc_id long, n_words long, n_removed long, kept string")


def one_a_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without repeated rows of one id and text: what is found out for one of them goes for all."""
    again = scratch.put(docs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY), "again")
    if again.isEmpty():
        return docs
    return docs.join(small(again), _KEY, "left_anti").unionByName(docs.join(small(again), _KEY, "left_semi").dropDuplicates(_KEY))


def cut_repeats(docs: DataFrame, kept_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`: the words, joined by single spaces, under no window that starts in a document of a smaller id.

    A window is 13 consecutive words; windows are judged on the input. A null or empty text has no words. A null id counts as
    2^63 - 1, larger than every other; rows of one id don't count as earlier than each other, and repeated rows are cut alike.
    Other columns are ignored, an empty table gives no rows. With kept_text false, `kept` is the SHA-256 of the kept words instead.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "recompress")
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("i"), F.xxhash64("text").alias("k"), "text")
    same = docs.select("i", "k", F.unhex(F.md5("text")).alias("whole")).where("whole is not null")
    first = scratch.put(same.groupBy("whole").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("times")).where("first < last").select("whole", "first", "times"), "texts")
    copies = scratch.put(join_hot(same, first, ["whole"], "inner", "times").where("i > first").select("i", "k").distinct(), "copies")
    own = one_a_key(docs.join(small(copies), _KEY, "left_anti"), scratch)

    occ = scratch.put(occurrences(own), "occurrences")
    shared = scratch.put(dictionary(occ, "anchor").drop("lo"), "anchors")
    wanted = scratch.put(join_hot(occ, shared, ["anchor"], "inner", "times").groupBy(*_KEY).agg(F.collect_set("anchor").alias("wanted")), "wanted")
    scratch.drop("occurrences", "anchors")
    parts = scratch.put(live(own.join(wanted, _KEY), LEVELS[0]), "live")
    scratch.drop("wanted")
    long = long_symbols(parts.select(*_KEY, *_SYMBOLS), scratch).groupBy(*_KEY).agg(F.collect_list(F.struct("a", "b")).alias("long"))
    held = parts.select(*_KEY, *_WINDOWS).join(scratch.put(long, "long-of"), _KEY, "left")
    windows = scratch.put(border_windows(held), "windows")
    twice = scratch.put(dictionary(windows, "anchor", "hash"), "repeats")
    gone = join_hot(windows, twice, ["anchor", "hash"], "inner", "times").where("i > lo").groupBy(*_KEY).agg(F.collect_set("hash").alias("gone"))
    cut = scratch.put(spans(held.join(gone, _KEY, "left").where("gone is not null or long is not null")), "cut").distinct()
    scratch.drop("live", "windows", "repeats", "places")
    marked = docs.join(cut, _KEY, "left").join(small(copies).withColumn("copy", F.lit(True)), _KEY, "left")
    return _cut(marked.withColumn("copy", F.coalesce("copy", F.lit(False))), kept_text)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(load(spark, sf_dir, "documents"), False).withColumnRenamed("kept", "kept_sha256")


#: The same rows in DuckDB, from all windows as text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 13], ' ') AS span FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)),
f AS (SELECT span, min(doc_id) AS first FROM x GROUP BY span HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT x.doc_id, unnest(range(s, s + 13)) AS q FROM x JOIN f USING (span) WHERE x.doc_id > f.first)),
g AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(qs, i - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
