import hashlib

import numpy as np
from folioforge.llm import fingerprint as fp
from folioforge.llm import textkernel as tk

from . import brute

SCHEMA = "doc_id long, text string, fingerprint int, bucket string"


def test_words_and_shingles_match_brute_force():
    texts = [t or "" for t in brute.ODD_TEXTS]
    buf, off = tk.joined(texts)
    w = tk.Words(buf, off)
    got = [bytes(w.buf[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in brute.words(t)]
    assert list(w.counts()) == [len(brute.words(t)) for t in texts]
    sh, first = tk.shingles(w.hashes(), w.first, 5)
    assert [len(s) for s in tk.distinct_sets(sh, first)] == [len(brute.shingles(t)) for t in texts]
    a = tk.Words(buf, off, tk.ALNUM)
    assert [bytes(a.buf[s:e]).decode() for s, e in zip(a.starts, a.ends, strict=True)] == [x for t in texts for x in brute.alnum_words(t)]


def test_equal_words_hash_equally_wherever_they_stand():
    buf, off = tk.joined(["alpha beta gamma", "gamma xx alpha", "beta"])
    h = tk.Words(buf, off).hashes()
    assert h[0] == h[5] and h[1] == h[6] and h[2] == h[3] and len(set(h.tolist())) == 4


def test_densify_fills_every_bin_from_a_filled_one():
    t = np.full((3, 64), fp._EMPTY)
    t[0, 5] = 7
    t[1, ::3] = np.arange(22)
    out = fp.densify(t)
    assert (out[0] == 7).all() and set(out[1]) <= set(range(22)) and (out[2] == fp._EMPTY).all()


def test_likeness_is_unbiased():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.75, 1.0):
        errors = []
        for _ in range(12):
            base = [f"w{x}" for x in rng.integers(0, 10**9, 700)]
            cut = int(700 * share)
            other = base[:cut] + [f"v{x}" for x in rng.integers(0, 10**9, 700 - cut)]
            a, b = " ".join(base), " ".join(other)
            r, s = fp.sketch_texts([a, b], 512, 8, 5)
            errors.append(fp.likeness(r[:1], r[1:], s[:1], s[1:])[0] - brute.jaccard(brute.shingles(a), brute.shingles(b)))
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.09


def test_packed_bits_round_trip():
    rows, _ = fp.sketch_texts(["a b c d e f g h"], 64, 2, 3)
    assert rows.shape == (1, 16) and fp.unpack(rows, 2).shape == (1, 64)


def test_edited_fingerprints_against_brute_force(spark):
    rows = [(i * 3, t, i, "x") for i, t in enumerate(brute.ODD_TEXTS)] + [(None, "null id text here", 0, None)]
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = fp.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
        order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0]))
        by = {r["doc_id"]: r for r in got}
        assert len(got) == len(rows)
        for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1], strict=True):
            t, u = t or "", u or ""
            e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            assert by[i]["n_chars"] == len(t) and by[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
            if t == u:
                assert by[i]["near_next"] == 1.0
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    same = [r["fingerprint"] for r in got if by and r["n_chars"] == 9]
    assert len(set(same)) < len(same)


def test_empty_table_and_repeated_rows(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fp.edited_fingerprints(spark.createDataFrame([(1, "a b", 1, "")] * 3, SCHEMA)).count() == 3
    out = fp.fingerprints(spark.createDataFrame([(1, "a b c", 9, ""), (2, None, 9, "")], SCHEMA)).orderBy("doc_id").collect()
    assert len(out[0]["fingerprint"]) == 1024 and out[1]["fingerprint"] == ""


def plain_fingerprint(text, bins=fp.BINS):
    """One bin at a time, from the hashes of the distinct shingles; None without words."""
    buf, off = tk.joined([text])
    w = tk.Words(buf, off)
    sh = {int(x) for x in tk.shingles(w.hashes(), w.first, 5)[0]}
    if not sh:
        return None
    table = {}
    for x in sh:
        b = x >> (64 - bins.bit_length() + 1)
        table[b] = min(table.get(b, 2**64), x % 2**54)
    order = fp._orders(bins)[0]
    full = [table[b] if b in table else table[next(int(d) for d in order[b] if int(d) in table)] for b in range(bins)]
    return bytes(tk.mix1(x) & 255 for x in full)


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def _check(spark, rows, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    got = fp.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    h = {r["text"]: r["h"] for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]], r[1] or ""))
    want = []
    for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = plain_fingerprint(t), plain_fingerprint(e), plain_fingerprint(u)
        text = lambda x: "" if x is None else x.hex()
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    rounded = [(*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(rounded, key=str) == sorted(want, key=str)


def test_all_columns_against_a_plain_version(spark):
    words = lambda i, n: " ".join(f"w{(i * 7 + j) % 40}" for j in range(n))
    rows = [(i * 5 - 20, t, 0, "") for i, t in enumerate(brute.ODD_TEXTS[:12])] + [(200 + i, words(i // 3, 6 + i), 0, "") for i in range(12)]
    for n in (1, 5):
        _check(spark, rows, n)


def test_hot_and_missing_ids_are_dealt_over_buckets(spark):
    rows = [(None, f"no id {i} a b c d", 0, "") for i in range(30)] + [(7, f"seven {i} x y z w", 0, "") for i in range(30)] + [(-(2**63), "least id", 0, ""), (2**63 - 1, "last id", 0, ""), (9, "nine", 0, "")]
    _check(spark, rows, 8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    placed, n = fp.with_next(spark.createDataFrame(rows, SCHEMA))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n > 3 and max(r["count"] for r in placed.where("copy = 0").groupBy("bucket").count().collect()) < 30
