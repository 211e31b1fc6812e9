import random
import struct

import pytest
from folioforge.llm import sentencepiece_wfst as wf

from . import brute

sp = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, ids string, lossless int"
MORE = ["  a  b", "a   b\n\n c", "\n", "   ", "a" * 70 + " b", "http://www.example.com/a_b?x=1&y=2", "def f(x):\n    return x**2\n", "▁ ▁▁a", "\x00\x01 z", "l'été; Œuvre", "🙂" * 9]


def _field(k, v):
    if isinstance(v, float):
        return bytes([k << 3 | 5]) + struct.pack("<f", v)
    if isinstance(v, int):
        return _varint(k << 3) + _varint(v)
    return _varint(k << 3 | 2) + _varint(len(v)) + v


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _model(pieces, kind, norm=b""):
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, t)) for p, s, t in pieces)
    return body + _field(2, _field(3, kind)) + _field(3, norm)


def test_matches_the_library_on_documents(spark, sf_dir):
    lib = sp.SentencePieceProcessor(model_file=wf.MODEL)
    t = wf.Transducer(open(wf.MODEL, "rb").read())
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [x or "" for x in brute.ODD_TEXTS] + MORE
    for x in texts:
        ids = t.encode(x)
        assert ids.tolist() == lib.encode(x)
        assert t.decode(ids) == lib.decode(lib.encode(x)) == x or SPACE_IN(x)


def SPACE_IN(x):
    return wf.SPACE in x


def test_matches_merging_on_random_letters():
    t = wf.Transducer(open(wf.MODEL, "rb").read())
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeinrst▁.é你") for _ in range(rng.randint(1, 90))) for _ in range(400)] + ["".join(rng.choice("helo wrd▁") for _ in range(12)) for _ in range(400)]
    for x in texts:
        want = [i for p in t._merge(x) for i in ([t.lexicon[p]] if p in t.lexicon else t._spell(p))]
        assert list(t.shortest_path(x)) == want
        ids, size = t.shortest_paths([x, x[::-1]])
        assert ids[: size[0]].tolist() == want and size.sum() == len(ids)


def test_border_arcs_equal_merging_the_two():
    t = wf.Transducer(open(wf.MODEL, "rb").read())
    rng, pieces = random.Random(4), sorted(t.lexicon)
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(3000)]
    pairs += [(p[:k], p[k:]) for p in rng.sample(pieces, 2000) for k in range(1, len(p)) if p[:k] in t.lexicon and p[k:] in t.lexicon]
    got = t.side_by_side(*(wf.np.array([t.lexicon[x[k]] for x in pairs]) for k in (0, 1)))
    assert got.tolist() == [t._merge(a + b) == [a, b] for a, b in pairs] and 0 < got.sum() < len(pairs)


def test_unigram_shortest_path_is_the_cheapest():
    pieces = [("<unk>", 0, wf.UNKNOWN), ("a", -2, 1), ("b", -3, 1), ("ab", -4, 1), ("ba", -2.5, 1), ("aba", -6, 1), ("▁", -1, 1), ("▁a", -1.5, 1)]
    t = wf.Transducer(_model(pieces, wf.UNIGRAM))
    cost = {p: -s for p, s, k in pieces if k == 1}

    def best(x):
        if not x:
            return 0.0
        return min([cost[x[:k]] + best(x[k:]) for k in range(1, 4) if x[:k] in cost] + ([wf.UNKNOWN_PENALTY - t.least + best(x[1:])] if x[0] not in cost else []))

    rng = random.Random(1)
    for _ in range(100):
        x = "".join(rng.choice("aab▁z") for _ in range(rng.randint(1, 9)))
        ids = t.shortest_path(x)
        assert t.shortest_paths([x])[0].tolist() == list(ids)
        assert abs(sum(cost.get(t.pieces[i][0], wf.UNKNOWN_PENALTY - t.least) for i in ids) - best(x)) < 1e-9
    assert t.decode(t.encode("ab ab")) == "ab ab"


def test_white_space_rules():
    n = wf.Normaliser(_field(4, 1) + _field(3, 0))
    assert n("  a   b ") == "a▁b"
    assert wf.Normaliser(b"")("a b") == "▁a▁b" and wf.Normaliser(b"")("") == ""


def test_rewrite_trie():
    # a double array with one rule: "A" -> "a"
    units = [0] * 512
    units[0] = 1 << 10  # root, its children are at 1 ^ byte
    at = 1 ^ ord("A")
    units[at] = ord("A") | 1 << 8 | 2 << 10
    units[at ^ 2] = 0 | 1 << 31
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"a\0"
    n = wf.Normaliser(_field(2, blob) + _field(3, 0))
    assert n("bAA é") == "baa▁é"


def test_texts_of_a_batch_share_parts_and_long_parts():
    t = wf.Transducer(open(wf.MODEL, "rb").read())
    lib = sp.SentencePieceProcessor(model_file=wf.MODEL)
    texts = ["the cat", "", "the dog the cat", "a" * 3000, "你好世界" * 300, "the\nthe", " "]
    ids, cuts = t.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == lib.encode(texts)
    assert t.decode_all(ids, cuts) == texts


def test_columns_that_clash_in_any_case(spark):
    out = wf.encode(spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, IDS string"))
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded_sha256", "lossless"] and out.first()["n_tokens"] == 2


def test_odd_rows(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate(brute.ODD_TEXTS)] + [(None, "a", None, None)] * 2
    out = wf.encode(spark.createDataFrame(rows, SCHEMA))
    got = wf.decode(out).collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") and r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert wf.encode(spark.createDataFrame([], SCHEMA)).count() == 0
