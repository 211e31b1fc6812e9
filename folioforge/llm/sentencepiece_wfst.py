"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser (rewrite trie, dummy prefix, white-space rules) is
deterministic, so composing it with a text gives one string. The lexicon has an arc for every piece, whose weight is minus
the piece's score; it is kept as arrays (hashes, ids, weights) in which all substrings of many strings are looked up at once.
Byte fallback has an arc for each character that no piece holds, spelt as the pieces of its UTF-8 bytes. Composed with the
string they give a lattice over its characters, whose arcs are relaxed in the tropical semiring (min, +) node by node; the
shortest path is the encoding. Decoding is the inverse machine: piece ids to bytes.

For a unigram model that is all. A BPE model's encoding isn't the path of least summed scores, so its lattice is composed with
one more machine, whose states are pieces: from piece a to piece b there is an arc of weight 0 if merging the text of the two
gives these two again, and of infinite weight otherwise. A BPE encoding is the one path of finite weight, on every prefix too,
so each lattice node needs one state only. Whether a and b may stand side by side is found by undoing, merge by merge, the
later one of those that made the two symbols at the border: a merge across the border would have come before it, or not.

No piece holds a space mark behind another character (checked when compiling), so every such place is a node of all
paths; strings are cut there, and each distinct part of a batch is solved once, all parts of one length side by side.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk
from .scratch import others

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The format's penalty of an unknown character below the least score.
UNKNOWN_PENALTY = 10.0
#: Paths and piece pairs that a Python worker remembers at most (each; about 200 bytes).
CACHE = 80_000
#: Piece pairs that a Python worker remembers beside that: two to this power.
PAIR_BITS = 19
#: Longer parts are relaxed one at a time; of others so many side by side that their lattices have so many places.
LONG, PLACES = 48, 300_000
#: Documents and bytes of text that are encoded together.
BATCH_DOCS, BATCH_BYTES = 500, 1 << 20
_U = np.uint64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif kind == 1:
            yield key >> 3, struct.unpack("<d", data[at : at + 8])[0]
            at += 8
        else:
            raise ValueError(f"wire type {kind}")


class Normaliser:
    """Longest-match rewriting by the model's double-array trie, then the white-space rules."""

    def __init__(self, spec: bytes):
        f = dict(_fields(spec))
        self.prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        blob = f.get(2, b"")
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            n = struct.unpack("<I", blob[:4])[0]
            self.units, self.strings = np.frombuffer(blob[4 : 4 + n], "<u4"), blob[4 + n :]
        self.units_list = self.units.tolist()

    def _rewrite(self, text: str) -> str:
        raw, out, at, units = text.encode("utf-8", "replace"), bytearray(), 0, self.units_list
        while at < len(raw):
            node, found, end = 0, None, at
            pos = node ^ ((units[0] >> 10) << ((units[0] & 512) >> 6))
            for k in range(at, len(raw)):
                pos ^= raw[k]
                if pos >= len(units) or units[pos] & 0x800000FF != raw[k]:
                    break
                u = units[pos]
                pos ^= (u >> 10) << ((u & 512) >> 6)
                if u >> 8 & 1:
                    found, end = units[pos] & 0x7FFFFFFF, k + 1
            if found is None:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out += raw[at : at + n]
                at += n
            else:
                out += self.strings[found : self.strings.index(0, found)]
                at = end
        return out.decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        if self.units_list:
            text = self._rewrite(text)
        if self.squeeze:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class _Table:
    """A map from 64-bit hashes to numbers, looked up for whole arrays: the hashes of one slot stand side by side."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.mask = _U((1 << bits) - 1)
        slot = (keys & self.mask).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values, slot = keys[order], values[order], slot[order]
        self.first = np.full((1 << bits) + 1, -1, np.int32)
        self.most = int(np.bincount(slot).max()) if len(slot) else 0
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys (of any shape), -1 where there is none."""
        flat = keys.ravel()
        at = self.first[(flat & self.mask).view(np.int64)]
        out = np.full(len(flat), -1, np.int64)
        on = np.flatnonzero(at >= 0)
        at, some = at[on].astype(np.int64), flat[on]
        for k in range(self.most):
            j = np.minimum(at + k, len(self.keys) - 1)
            hit = self.keys[j] == some
            out[on[hit]] = self.values[j[hit]]
        return out.reshape(keys.shape)


def _substrings(codes: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hashes of the characters q[j]:p[j] (columns) of every row of codes, which has one string a row."""
    up, down = tk._pows(codes.shape[1] + 1)
    s = np.zeros((codes.shape[0], codes.shape[1] + 1), _U)
    np.cumsum(tk.mix(codes.astype(_U) + _U(0xA5A5)) * up[: codes.shape[1]], axis=1, out=s[:, 1:])
    return tk.mix((s[:, p] - s[:, q]) * down[q] ^ (p - q).astype(_U))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), -1)


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer = norm = b""
        for k, v in _fields(model):
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append((f.get(1, b"").decode("utf-8"), f.get(2, 0.0), f.get(3, NORMAL)))
            elif k == 2:
                trainer = v
            elif k == 3:
                norm = v
        self.kind = dict(_fields(trainer)).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.normalise = Normaliser(norm)
        self.lexicon = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER) and p}
        self.score = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.lexicon))
        self.letters = set("".join(self.lexicon))
        self.least = min((self.score[i] for i in self.lexicon.values()), default=0.0)
        if self.kind == BPE:  # a piece that merging its characters doesn't give is on no path
            ends = {p: self._merge(p, 2) for p in self.lexicon if len(p) > 1}
            self.lexicon = {p: i for p, i in self.lexicon.items() if len(p) == 1 or (len(ends[p]) == 2 and all(x in self.lexicon for x in ends[p]))}
            self._compile_border(ends)
        cut = not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        self.cut = cut and "\n" not in self.letters
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if self.cut else r"(?s).+")
        self._compile_lexicon()
        out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in self.pieces]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.follows: dict[int, bool] = {}
        self.forget()

    def _compile_lexicon(self) -> None:
        """The lexicon's arcs as arrays."""
        keys, ids, by_size = [], [], {}
        for p, i in self.lexicon.items():
            by_size.setdefault(len(p), []).append((p, i))
        for n, some in by_size.items():
            keys.append(_substrings(_codes([p for p, _ in some]), np.array([0]), np.array([n]))[:, 0])
            ids += [i for _, i in some]
        keys = np.concatenate(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.arcs = _Table(keys, np.array(ids, np.int64))
        self.weight = -np.array(self.score)

    def _compile_border(self, ends: dict[str, list[str]]) -> None:
        """Ranks, last merges and pair results of all pieces, for may_follow and side_by_side."""
        n = len(self.pieces)
        self.rank = np.empty(n, np.int64)  # 0 is merged first; equal scores have equal ranks
        self.rank[:] = np.unique(-np.array(self.score), return_inverse=True)[1]
        self.split = np.full((n, 2), -1, np.int64)
        keys, values = [], []
        for p, i in self.lexicon.items():
            if len(p) > 1:
                self.split[i] = [self.lexicon[x] for x in ends[p]]
            for k in range(1, len(p)):
                x, y = self.lexicon.get(p[:k]), self.lexicon.get(p[k:])
                if x is not None and y is not None:
                    keys.append(x * n + y)
                    values.append(i)
        self.joined = _Table(tk.mix(np.array(keys, _U)), np.array(values, np.int64))  # mix is a bijection: equal hashes, equal pairs
        self.pair_seen, self.pair_ok = np.full(1 << PAIR_BITS, _U(2**64 - 1)), np.zeros(1 << PAIR_BITS, bool)

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a[j] and b[j] gives these two, for all j."""
        n, never = len(self.pieces), 1 << 40
        ok = np.ones(len(a), bool)
        j, a, b = np.arange(len(a)), a.copy(), b.copy()
        before = np.full(len(a), never)  # a merge across the border of a lesser rank would have been made
        while len(j):
            both = self.joined.get(tk.mix((a * n + b).astype(_U)))
            crossed = (both >= 0) & (self.rank[both] < before)
            ok[j[crossed]] = False
            ra = np.where(self.split[a, 0] >= 0, self.rank[a], -1)
            rb = np.where(self.split[b, 0] >= 0, self.rank[b], -1)
            go = ~crossed & (np.maximum(ra, rb) >= 0)
            j, a, b, ra, rb = j[go], a[go], b[go], ra[go], rb[go]
            left = ra > rb  # of equal ones the left one is made first, so the right one is undone first
            before = np.where(left, ra, rb + 1)  # a merge to the left of the one that is undone comes first if they are equal
            a = np.where(left, self.split[a, 1], a)
            b = np.where(left, b, self.split[b, 0])
        return ok

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side, with a memory of the pairs that came last to each slot of a table of fixed size."""
        key = tk.mix((a * len(self.pieces) + b).astype(_U))
        slot = (key & _U((1 << PAIR_BITS) - 1)).view(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_seen[slot] != key)
        if len(new):
            some, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.side_by_side(a[new[first]], b[new[first]])
            ok[new] = found[back]
            to = (some & _U((1 << PAIR_BITS) - 1)).view(np.int64)
            self.pair_seen[to], self.pair_ok[to] = some, found
        return ok

    def _merge(self, text: str, least: int = 1) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until nothing merges or `least` parts are left. Compiles a model's
        pieces, and is what tests hold the shortest path against."""
        parts, lexicon, score = list(text), self.lexicon, self.score
        while len(parts) > least:
            best, where = None, -1
            for j in range(len(parts) - 1):
                i = lexicon.get(parts[j] + parts[j + 1])
                if i is not None and (best is None or score[i] > best):
                    best, where = score[i], j
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the border machine has an arc of weight 0 from piece a to piece b."""
        key = a * len(self.pieces) + b
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) >= CACHE:
                self.follows.clear()
            ok = self.follows[key] = bool(self.side_by_side(np.array([a]), np.array([b]))[0])
        return ok

    def forget(self) -> None:
        """Drop remembered paths."""
        self.known: dict[str, int] = {}
        self.pool: list[np.ndarray] = []
        self.pool_size = 0
        self.path_at, self.path_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _spell(self, ch: str) -> tuple[int, ...]:
        """Byte fallback of a character outside the lexicon."""
        return tuple(self.bytes[b] for b in ch.encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Piece ids of the cheapest path through the lattice of one normalised part."""
        n, get, longest, inf = len(text), self.lexicon.get, self.longest, float("inf")
        cost, last, came = [0.0] + [inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for p in range(1, n + 1):
            for q in range(max(0, p - longest), p):
                i = get(text[q:p])
                c = inf if i is None else cost[q] - self.score[i]
                if c < cost[p] and (self.kind != BPE or last[q] < 0 or self.may_follow(last[q], i)):
                    cost[p], last[p], came[p] = c, i, q
            c = cost[p - 1] - self.least + UNKNOWN_PENALTY
            if c < cost[p] and get(text[p - 1]) is None:
                cost[p], last[p], came[p] = c, -1, p - 1
        back: list[tuple[int, ...]] = []
        p = n
        while p:
            back.append((last[p],) if last[p] >= 0 else self._spell(text[p - 1]))
            p = came[p]
        return tuple(i for part in reversed(back) for i in part)

    def shortest_paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, how many for each text) of the cheapest paths of parts of one length, relaxed side by side."""
        codes = _codes(texts)
        w, n = codes.shape
        starts, ends = (np.array(x) for x in zip(*((q, p) for p in range(1, n + 1) for q in range(max(0, p - self.longest), p)), strict=True))
        lattice = self.arcs.get(_substrings(codes, starts, ends)).T.copy()  # a row for each place, ordered by its end
        first = np.searchsorted(ends, np.arange(1, n + 2))
        cost = np.full((w, n + 1), np.inf)
        cost[:, 0] = 0
        last, came = np.full((w, n + 1), -1, np.int64), np.zeros((w, n + 1), np.int64)
        for p in range(1, n + 1):
            arcs = lattice[first[p - 1] : first[p]]
            place, row = np.nonzero(arcs >= 0)
            i, q = arcs[place, row], starts[first[p - 1] : first[p]][place]
            if self.kind == BPE:
                state = last[row, q]
                go = np.isfinite(cost[row, q])
                tied = np.flatnonzero(go & (state >= 0))  # at the start, and behind a character of byte fallback, all may follow
                go[tied] = self.allowed(state[tied], i[tied])
                row, i, q = row[go], i[go], q[go]
            c = cost[row, q] + self.weight[i]
            np.minimum.at(cost[:, p], row, c)
            best = np.flatnonzero(c == cost[row, p])[::-1]  # the earliest start stays
            last[row[best], p], came[row[best], p] = i[best], q[best]
            c = cost[:, p - 1] - self.least + UNKNOWN_PENALTY
            on = np.flatnonzero((arcs[-1] < 0) & (c < cost[:, p]))
            cost[on, p], last[on, p], came[on, p] = c[on], -1, p - 1
        # back from the ends: ids are laid down from the right
        out = np.full((w, n), -1, np.int64)
        row, at, spelt = np.arange(w), np.full(w, n), np.zeros(w, bool)
        while len(row):
            i = last[row, at]
            out[row, at - 1] = i
            spelt[row[i < 0]] = True
            at = came[row, at]
            row, at = row[at > 0], at[at > 0]
        for k in np.flatnonzero(spelt):
            ids = self._spelt(texts[k], last[k], came[k])
            if len(ids) > out.shape[1]:
                out = np.pad(out, ((0, 0), (0, len(ids) - out.shape[1])), constant_values=-1)
            out[k] = -1
            out[k, : len(ids)] = ids
        return out[out >= 0].astype(np.int32), (out >= 0).sum(axis=1)

    def _spelt(self, text: str, last: np.ndarray, came: np.ndarray) -> list[int]:
        """Ids of a path with byte fallback."""
        p, back = len(text), []
        while p:
            back.append((int(last[p]),) if last[p] >= 0 else self._spell(text[p - 1]))
            p = int(came[p])
        return [i for part in reversed(back) for i in part]

    def _learn(self, parts: set[str]) -> None:
        """Remember the paths of parts."""
        by_size: dict[int, list[str]] = {}
        for x in parts:
            by_size.setdefault(len(x), []).append(x)
        sizes = []
        for n, some in by_size.items():
            width = max(64, PLACES // (min(n, self.longest) * n))
            for a in range(0, len(some), width):
                block = some[a : a + width]
                if n <= LONG:
                    ids, size = self.shortest_paths(block)
                else:
                    paths = [np.array(self.shortest_path(x), np.int32) for x in block]
                    ids, size = np.concatenate(paths), np.array([len(x) for x in paths])
                self.known.update(zip(block, range(len(self.known), len(self.known) + len(block)), strict=True))
                self.pool.append(ids)
                sizes.append(size)
        self.pool = [np.concatenate(self.pool)]
        size = np.concatenate(sizes)
        self.path_at = np.concatenate([self.path_at, self.pool_size + np.cumsum(size) - size])
        self.path_size = np.concatenate([self.path_size, size])
        self.pool_size += int(size.sum())

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, the place where each text's begin and the end)."""
        if len(self.known) > CACHE:
            self.forget()
        parts, many = [], []
        for x in texts:
            own = self.parts.findall(self.normalise(x))
            parts += own
            many.append(len(own))
        new = {x for x in parts if x not in self.known}
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        size = self.path_size[at]
        ends = np.append(0, np.cumsum(size))
        ids = self.pool[0][np.repeat(self.path_at[at] - ends[:-1], size) + np.arange(ends[-1])] if len(parts) else np.zeros(0, np.int32)
        return ids, ends[np.append(0, np.cumsum(many)).astype(np.int64)]

    def encode(self, text: str) -> array:
        """Piece ids of a text; of an empty one none."""
        return array("i", self.encode_all([text])[0].tobytes())

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Texts of piece ids, cut at the places of cuts: the inverse transducer. Bytes that are no UTF-8 become U+FFFD; the dummy prefix goes."""
        size = self.out_size[ids]
        ends = np.append(0, np.cumsum(size))
        raw = self.out_bytes[np.repeat(self.out_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        out = []
        for a, b in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.normalise.prefix and text.startswith(" ") else text)
        return out

    def decode(self, ids: array | list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


_compiled: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer and its memory per Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode(docs: DataFrame, model_path: str = MODEL, text: str = "text") -> DataFrame:
    """All columns of docs, `ids` (piece ids), `n_tokens`, `decoded_sha256` of the decoded text and `lossless`, whether that is the text.

    The model file is read on the driver and broadcast (it has one row per piece, half a megabyte here). A null or empty text
    has no ids; equal texts have equal ones, null ids and repeated rows are rows like others, an empty table stays empty.
    Columns of docs with the names of the added ones, in any case, are replaced. No shuffle; a row needs memory for its own
    text and ids.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    added = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded_sha256": T.StringType(), "lossless": T.BooleanType()}
    kept = others(docs, *added)
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(shared.value)
        for batch in batches:
            _, off = tk.column_bytes(batch.column(text))
            for a, b in tk.chunks(off, BATCH_BYTES, BATCH_DOCS):
                part = batch.slice(a, b - a)
                texts = [x.as_py() or "" for x in part.column(text)]
                ids, cuts = t.encode_all(texts)
                back = t.decode_all(ids, cuts)
                sha = [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back]
                same = [x == y for x, y in zip(back, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                cols = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(np.diff(cuts)), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=schema.names)
        t.forget()

    return docs.mapInArrow(tk.tidied(run), schema)


def decode(rows: DataFrame, model_path: str = MODEL, ids: str = "ids") -> DataFrame:
    """All columns of rows and `decoded`, the text of their piece ids (null or none: empty; repeated rows are decoded alike)."""
    spark = rows.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def text_of(col):
        t = compiled(shared.value)
        return col.map(lambda x: t.decode([] if x is None else x))  # a row's ids, all at once

    return rows.withColumn("decoded", text_of(F.col(ids)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids, as encode() says."""
    return encode(docs)
