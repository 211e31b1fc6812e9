"""Spelling variants of a corpus' words, by a positional q-gram inverted index with a count filter.

Words are counted over whole texts. Two words one edit apart, padded at both ends, keep all but q of their positional q-grams,
so of the greater length m they share m - 1, at places that differ by one at most. Grams have one order, by how many words hold
them, and the first q + 1 of each word in it must meet one of the other's. These are the postings of the index: their key is
a gram with its place and the word's length, and a word looks itself up among words of its own length and, at two places, of
one more. Postings of a key meet in one task, sorted; there the lists are indexed once more by the next grams of their words, and
the lists of a probe are merged in the order of the rows, whole blocks of probes at a time (a sort-merge in numpy in place of
a heap for each word). What is left must share m - 1 grams within the limits of place and length, and one edit is verified.
A pair that meets under several keys counts under the first.

No pair leaves a task: of each word only the number of near words and the most frequent of them do.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch

MIN_CHARS = 5
MIN_COUNT = 3
Q = 4
#: A word whose hash this divides loses a letter.
SLIP = 97
RATIO = 2
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 20_000
#: Rows of whole keys that are merged at a time, and pairs that are looked at at a time.
BLOCK_ROWS = 1 << 17
BLOCK_PAIRS = 1 << 20
#: Grams are counted in so many classes, by a hash: any order serves that is the same for all words.
CLASSES = 1 << 16
#: Bytes of a run from which on its hash is made by itself.
LONG_RUN = 64

_U = np.uint64
_HEAD, _TAIL = 1, 2
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def letter_runs(buf: np.ndarray, off: np.ndarray) -> tk.Words:
    """Runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8, 0xC3 and one byte), A-Z in lower case."""
    clean = tk._LOWER[buf]
    second = np.zeros(len(buf), bool)
    second[1:] = buf[:-1] == 0xC3
    clean[~(((clean >= 0x61) & (clean <= 0x7A)) | (buf == 0xC3) | second)] = 0x20
    return tk.Words(clean, off, _LETTERS, lower=False)


def slip_hashes(w: tk.Words, ids: list, crc: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """crc32 of `<id>:<run>` of every run: the id's CRC moved on by the run's length, and the run's own."""
    ahead = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    size, doc = w.ends - w.starts, w.doc_of()
    moved = np.empty((LONG_RUN + 1, len(ids)), np.uint32)
    moved[0] = ahead
    for k in range(LONG_RUN):
        moved[k + 1] = _CRC[moved[k] & 0xFF] ^ (moved[k] >> 8)
    out = crc[kind] ^ moved[np.minimum(size, LONG_RUN), doc]
    for j in np.flatnonzero(size > LONG_RUN):
        out[j] = zlib.crc32(w.buf[w.starts[j] : w.ends[j]], int(ahead[doc[j]]))
    return out


def block_words(buf: np.ndarray, off: np.ndarray, ids: list, min_chars: int = MIN_CHARS, slip: int = SLIP) -> Counter:
    """Words of a block of texts with their counts, those of min_chars letters or more."""
    w = letter_runs(buf, off)
    if not len(w):
        return Counter()
    _, first, kind = np.unique(w.hashes(), return_index=True, return_inverse=True)
    text = [w.buf[a:b].tobytes() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
    crc = np.array([zlib.crc32(t) for t in text], np.uint32)
    lead = np.concatenate([[0], np.cumsum(w.buf == 0xC3)])
    chars = (w.ends - w.starts) - (lead[w.ends] - lead[w.starts])
    h = slip_hashes(w, ids, crc, kind)
    slips = h % slip == 0 if slip else np.zeros(len(h), bool)
    found = Counter()
    many = np.bincount(kind[~slips], minlength=len(text))
    for k in np.flatnonzero((many > 0) & (chars[first] >= min_chars)).tolist():
        found[text[k].decode()] += int(many[k])
    at = np.flatnonzero(slips & (chars > min_chars))  # one letter less must be long enough
    for k, gone in zip(kind[at].tolist(), (h[at] % chars[at].astype(np.uint32)).tolist(), strict=True):
        t = text[k].decode()
        found[t[:gone] + t[gone + 1 :]] += 1
    return found


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the words of min_chars letters or more and min_count occurrences or more in the texts of docs (doc_id, text).

    A null text has no words; a null id counts as the empty text in the hash. Repeated rows count each.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            buf, off = tk.column_bytes(batch.column("text"))
            for a, b in tk.chunks(off, BLOCK_BYTES, BLOCK_DOCS):
                found = block_words(buf[off[a] : off[b]], off[a : b + 1] - off[a], ids[a:b], min_chars, slip)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(tk.tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Index:
    """Words of one block, by length: their letters, positional grams, and their first grams in the common order."""

    def __init__(self, words: list[str], counts: np.ndarray, q: int = Q):
        raw = [x.encode("latin-1") for x in words]
        self.q, self.keep, self.raw = q, q + 2, raw
        self.size = np.array([len(x) for x in raw], np.int64)
        n = len(raw)
        self.slot = np.zeros(n, np.int64)  # a word's row among those of its length
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}
        self.code = np.zeros((n, self.keep), np.uint32)
        self.pos = np.full((n, self.keep), -9, np.int64)  # of a word with fewer grams the rest is nowhere
        order = np.argsort(self.size, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(self.size[order])) + 1) if n else []:
            L = int(self.size[at[0]])
            self.slot[at] = np.arange(len(at))
            self.letters[L] = m = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), L)
            padded = np.concatenate([np.full((len(at), q - 1), _HEAD, np.uint8), m, np.full((len(at), q - 1), _TAIL, np.uint8)], 1)
            g = np.zeros((len(at), L + q - 1), np.uint32)
            for k in range(q):
                g = (g << np.uint32(8)) | padded[:, k : k + g.shape[1]]
            self.grams[L] = g
            rarity = np.minimum(counts[gram_class(g)], 2**32 - 1).astype(_U) << _U(32) | g
            best = np.argsort(rarity, 1, kind="stable")[:, : self.keep]
            self.code[at, : best.shape[1]] = np.take_along_axis(g, best, 1)
            self.pos[at, : best.shape[1]] = best


def gram_class(g: np.ndarray) -> np.ndarray:
    return (tk.mix(g.astype(_U)) & _U(CLASSES - 1)).astype(np.int64)


def posting_key(code: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    return tk.mix(code.astype(_U) ^ tk.mix(pos.astype(_U) ^ tk.mix(size.astype(_U))))


def gram_counts(words: DataFrame, q: int = Q) -> np.ndarray:
    """How many grams of all words are of each class, a fixed number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, none = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for g in Index(batch.column("word").to_pylist(), none, q).grams.values():
                n += np.bincount(gram_class(g).ravel(), minlength=CLASSES)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["c", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in words.select("word").mapInArrow(tk.tidied(run), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[r["c"]] = r["n"]
    return out


def postings(words: DataFrame, shared, q: int = Q) -> DataFrame:
    """(key, shift, j, word, n): each word under its first q + 1 grams. shift is null for the word's own posting; 0 and 1 are
    looks at the postings of words of one letter more, whose gram stands at the same place or at the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = Index(batch.column("word").to_pylist(), shared.value, q)
            row, j = np.nonzero(x.pos[:, : q + 1] >= 0)
            code, pos, size = x.code[row, j], x.pos[row, j], x.size[row]
            keys = np.concatenate([posting_key(code, pos, size), posting_key(code, pos, size + 1), posting_key(code, pos + 1, size + 1)])
            shift = np.repeat(np.array([-1, 0, 1], np.int8), len(row))
            at = pa.array(np.tile(row, 3))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shift), pa.array(np.tile(j, 3).astype(np.int8)), batch.column("word").take(at), batch.column("n").take(at)], names=["key", "shift", "j", "word", "n"])

    return words.select("word", "n").mapInArrow(tk.tidied(run), "key long, shift byte, j byte, word string, n long")


def _expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list number, element) of all elements of the lists start[i] : start[i] + size[i]."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


class Merge:
    """The postings of whole keys, merged."""

    def __init__(self, key: np.ndarray, shift: np.ndarray, j: np.ndarray, word: np.ndarray, index: Index):
        self.key, self.shift, self.j, self.word, self.index = key, shift, j.astype(np.int64), word, index

    def _next_grams(self, rows: np.ndarray, shift: int) -> np.ndarray:
        """Keys of rows x (q + 1): the row's key with each of the word's first grams but that of the key."""
        x, w = self.index, self.word[rows]
        col = np.arange(x.keep - 1)[None, :] + (np.arange(x.keep - 1)[None, :] >= self.j[rows][:, None])
        code, pos = np.take_along_axis(x.code[w], col, 1), np.take_along_axis(x.pos[w], col, 1)
        key = tk.mix(self.key[rows][:, None] ^ tk.mix(code.astype(_U) << _U(32) ^ (pos + shift).astype(_U)))
        return np.where(pos >= 0, key, _U(0))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe row, posting row) in blocks, each pair of rows once in a block and no probe in two blocks."""
        own = np.flatnonzero(self.shift < 0)
        keys = self._next_grams(own, 0)
        width = keys.shape[1]
        flat, rows = keys.ravel(), np.repeat(own, width)
        some = flat != 0
        order = np.argsort(flat[some], kind="stable")  # a list is in the order of the rows
        lists, rows = flat[some][order], rows[some][order]
        for shifts, probes in (((0,), own), ((0, 1), np.flatnonzero(self.shift >= 0))):
            for a in range(0, len(probes), 4096):
                part = probes[a : a + 4096]
                look = np.concatenate([self._next_grams(part, s) for s in shifts], 1)
                lo, hi = np.searchsorted(lists, look.ravel(), "left"), np.searchsorted(lists, look.ravel(), "right")
                size = np.where(look.ravel() != 0, hi - lo, 0)
                each = size.reshape(len(part), -1).sum(1)
                cut = np.searchsorted(np.cumsum(each), np.arange(BLOCK_PAIRS, each.sum() + BLOCK_PAIRS, BLOCK_PAIRS))
                begin = 0
                for end in [*np.unique(np.minimum(cut + 1, len(part))).tolist()]:
                    s = slice(begin * look.shape[1], end * look.shape[1])
                    which, at = _expand(lo[s], size[s])
                    x, y = part[begin + which // look.shape[1]], rows[at]
                    if shifts == (0,):  # equal lengths: each pair from its earlier row
                        later = y > x
                        x, y = x[later], y[later]
                    both = np.unique(x * len(self.key) + y)
                    yield both // len(self.key), both % len(self.key)
                    begin = end

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, word) of all pairs one edit apart whose first common key is one of this block."""
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for x, y in self.candidates():
            s, t, shift, j = self.word[x], self.word[y], np.maximum(self.shift[x], 0).astype(np.int64), self.j[x]
            keep = s != t
            s, t, shift, j = s[keep], t[keep], shift[keep], j[keep]
            ok = self._within(s, t)
            s, t, shift, j = s[ok], t[ok], shift[ok], j[ok]
            ok = self._first(s, t, shift, j)
            out[0].append(s[ok])
            out[1].append(t[ok])
        return np.concatenate(out[0]), np.concatenate(out[1])

    def _within(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether t, of the length of s or of one more, shares enough grams and is one edit away."""
        x, ok = self.index, np.zeros(len(s), bool)
        more = x.size[t] - x.size[s]
        kind = np.where((more == 0) | (more == 1), 2 * x.size[s] + more, -1)
        for k in np.unique(kind[kind >= 0]).tolist():
            L, d = divmod(k, 2)
            at = np.flatnonzero(kind == k)
            step = max(1, (16 << 20) // (L + 8))
            for a in range(0, len(at), step):
                p = at[a : a + step]
                i, u = x.slot[s[p]], x.slot[t[p]]
                g, h = x.grams[L][i], x.grams[L + d][u]
                same = g == h[:, : g.shape[1]]
                if d:
                    same |= g == h[:, 1:]
                p, i, u = (v[same.sum(1) >= L + d - 1] for v in (p, i, u))
                m, o = x.letters[L][i], x.letters[L + d][u]
                if d:
                    ahead = np.logical_and.accumulate(m == o[:, :-1], 1).sum(1)
                    behind = np.logical_and.accumulate((m == o[:, 1:])[:, ::-1], 1).sum(1)
                    ok[p[ahead + behind >= L]] = True
                else:
                    ok[p[(m != o).sum(1) == 1]] = True
        return ok

    def _first(self, s: np.ndarray, t: np.ndarray, shift: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the j-th gram of s, moved by shift, is the first that both words look at."""
        x, q = self.index, self.index.q
        cs, ps, ct, pt = x.code[s, : q + 1], x.pos[s, : q + 1], x.code[t, : q + 1], x.pos[t, : q + 1]
        one_more = (x.size[t] > x.size[s])[:, None]
        seen = np.zeros((len(s), q + 1, 2), bool)
        for a in range(q + 1):
            for b in range(q + 1):
                same = (cs[:, a] == ct[:, b]) & (ps[:, a] >= 0)
                seen[:, a, 0] |= same & (ps[:, a] == pt[:, b])
                seen[:, a, 1] |= same & (ps[:, a] + 1 == pt[:, b]) & one_more[:, 0]
        seen = seen.reshape(len(s), 2 * (q + 1))
        mine = 2 * j + shift
        return seen.any(1) & (seen.argmax(1) == mine)


def near_words(words: DataFrame, q: int = Q) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit from each that has any, and the most frequent of these (of equal
    ones the least). words has word (letters up to U+00FF, three or more) and n, each word once."""
    ship(words.sparkSession)
    if not 2 <= q <= 4:
        raise ValueError("q must be 2, 3 or 4")
    shared = words.sparkSession.sparkContext.broadcast(gram_counts(words, q))

    def merged(table: pa.Table) -> pa.RecordBatch | None:
        word = table["word"].combine_chunks().dictionary_encode()
        names = word.dictionary.to_pylist()
        kind = word.indices.to_numpy().astype(np.int64)
        n = np.zeros(len(names), np.int64)
        n[kind] = table["n"].to_numpy()
        key, shift, j = (table[c].to_numpy() for c in ("key", "shift", "j"))
        s, t = Merge(key.view(_U), shift, j, kind, Index(names, shared.value, q)).near()
        if not len(s):
            return None
        a, b = np.concatenate([s, t]), np.concatenate([t, s])
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort((place[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        many = np.diff(np.append(first, len(a)))
        text = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([text.take(pa.array(a[first])), pa.array(many), pa.array(n[b[first]]), text.take(pa.array(b[first]))], names=["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if cut:
                    if (out := merged(table.slice(0, cut))) is not None:
                        yield out
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if rows and (out := merged(pa.Table.from_batches(held))) is not None:
            yield out

    dealt = postings(words, shared, q).repartition("key").sortWithinPartitions("key")
    near = dealt.mapInArrow(tk.tidied(run), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where following links (word, to), which never lead in a circle, ends. Each round doubles the way gone; a word is
    looked at until its end is found, so the rounds are the logarithm of the longest way."""
    now, done, k = scratch.put(links.select("word", "to"), "links-0"), None, 0
    ways = now
    while not now.isEmpty():
        far = ways.select(F.col("word").alias("to"), F.col("to").alias("far"))
        step = scratch.put(now.join(far, "to", "left").select("word", "to", "far"), f"step-{k}")
        ended = step.where("far is null").select("word", F.col("to").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        now = step.where("far is not null").select("word", F.col("far").alias("to"))
        ways = done.withColumnRenamed("root", "to").unionByName(now)
        k += 1
    return links.select("word", F.col("to").alias("root")).limit(0) if done is None else done


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP, q: int = Q) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text) with min_chars letters or more (at least three) and
    min_count occurrences or more.

    A word's form is the most frequent word one edit away (of equal ones the least in code points), if it is `ratio` times as
    frequent or more; root is the end of the way from form to form. slip plants misspellings: a run loses a letter where slip
    divides the hash of id and run (0 plants none). A null text has no words, a null id counts as the empty text, repeated rows
    count each; an empty table has no words. Other columns are ignored.
    """
    if min_chars < 3 or ratio < 2:
        raise ValueError("words of fewer than three letters can't be looked up by shared grams, and forms must be twice as frequent")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.put(vocabulary(docs, min_chars, min_count, slip), "words")
    near = scratch.put(near_words(words, q), "near")
    is_form = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    out = scratch.put(out, "forms")
    ends = roots(out.where("form is not null").select("word", F.col("form").alias("to")), scratch)
    rows = out.join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents"))


#: The same rows in DuckDB: CRCs byte by byte, near words by the word with each letter left out.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY doc_id, w),
x AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS h FROM r),
c AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda j: CAST('0x' || substr(h, CAST(2 * j + 1 AS INT), 2) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) AS crc FROM x, tab),
e AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, CAST(crc % length(w) AS INT)) || substr(w, CAST(crc % length(w) AS INT) + 2) ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
l AS (SELECT word, n, p, substr(word, 1, CAST(p AS INT)) || substr(word, CAST(p AS INT) + 2) AS k FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM v)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM l a JOIN l b ON a.p = b.p AND a.k = b.k AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM l JOIN v ON l.k = v.word
  UNION SELECT v.word, l.word, l.n FROM l JOIN v ON l.k = v.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS best, max(m) AS best_n FROM pairs GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends USING (word)
"""
