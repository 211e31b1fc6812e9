import gzip
import io
import json
import random
import zlib

import pytest
from folioforge.llm import warc as wa

SCHEMA = "page_id long, url string, html string, payload string, s int, first long"


def _pages(n=40):
    rng = random.Random(2)
    html = [None, "", "", "<p>é 你好</p>", "x" * 200_000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "a\r\n\r\n"]
    html += [f"<p>{rng.randrange(12)}</p>" for _ in range(n)]
    return [(i * 2 + 1, f"http://h/{i}\nx", h, "p", 1, 2) for i, h in enumerate(html)]


def _want(rows):
    out, first = [], {}
    for i, _, h, *_ in sorted(rows):
        b = (h or "").encode()
        f = first.setdefault(b, i)
        out.append((i, len(b), wa.digest(b), "revisit" if i > f else "response", f if i > f else None))
    return sorted(out)


def test_inflater_reads_any_split_of_any_members(monkeypatch):
    rng = random.Random(0)
    data = b"".join(bytes([rng.randrange(97, 100)]) * rng.randrange(1, 400) + b"\n" for _ in range(60))
    for block in (7, 100, 1 << 20):
        monkeypatch.setattr(wa, "BLOCK", block)
        for parts in ([data], [data[:5000], data[5000:], b""]):
            packed = b"".join(gzip.compress(p) for p in parts)
            s = wa.Inflater(io.BytesIO(packed))
            assert b"".join(iter(s.line, b"")) == data
            s = wa.Inflater(io.BytesIO(packed))
            assert s.take(11) == data[:11] and s.take(10**9) == data[11:] and s.take(5) == b""
            with pytest.raises((EOFError, zlib.error)):
                wa.Inflater(io.BytesIO(packed[:-9])).take(10**9)


def test_normalise_round_trip():
    bodies = [b"", b"one", b"two\r\n\r\nWARC/1.1", b"z" * 3_000_000]
    records = [wa.record(i, "http://x", b, wa.digest(b)) for i, b in enumerate(bodies)]
    out = io.BytesIO()
    index = list(wa.normalise(io.BytesIO(gzip.compress(b"".join(records))), out))
    assert [i[0] for i in index] == [f"<urn:page:{i}>" for i in range(4)]
    raw = out.getvalue()
    assert sum(n for *_, n in index) == len(raw)
    for (_, _, at, n), r in zip(index, records, strict=True):
        assert gzip.decompress(raw[at : at + n]) == r
    assert list(wa.normalise(io.BytesIO(b""), io.BytesIO())) == []


def test_archive_and_read_back(spark):
    rows = _pages()
    index = wa.archive(spark.createDataFrame(rows, SCHEMA).repartition(3))
    read = wa.read_records(index)
    got = wa.revisited(read).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == _want(rows)
    by, got = {i: h for i, _, h, *_ in rows}, read.collect()
    assert all(r["payload_digest"] == r["declared"] if r["record_type"] == "response" else r["payload_digest"] is None for r in got)
    assert all(r["payload"] == (by[r["page_id"]] or "").encode() for r in got if r["record_type"] == "response")
    path = index.first()["path"]
    fs, name = wa._open(path + ".index")
    lines = [json.loads(x) for x in fs.open_input_stream(name).read().decode().splitlines()]
    assert len(lines) == index.where(index["path"] == path).count() and lines[0]["offset"] == 0
    assert fs.get_file_info(name.rsplit("/", 2)[0] + "/whole").type == wa.pafs.FileType.NotFound


def test_many_files_and_least_bytes(spark, monkeypatch):
    rows = _pages(10)
    got = {r["page_id"]: r["record_type"] for r in wa.read_records(wa.archive(spark.createDataFrame(rows, SCHEMA).coalesce(1), least=1)).collect()}
    assert got[1] == got[3] == got[5] == "response" and "revisit" in got.values()


def test_odd_rows(spark):
    rows = [(None, None, "a", None, None, None), (None, "u", "a", "", 1, 1), (7, "u", "a", "", 1, 1), (7, "u", "a", "", 1, 1), (9, None, "a", "", 1, 1)]
    got = wa.read_records(wa.archive(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == [(0, "response", None), (0, "response", None), (7, "response", None), (7, "response", None), (9, "revisit", 7)]
    assert wa.read_records(wa.archive(spark.createDataFrame([], SCHEMA))).count() == 0


def test_hot_revisits(spark):
    rows = [(i, "u", "same" if i % 3 else "hot" * 9, "", 1, 1) for i in range(900)]
    got = wa.revisited(wa.read_records(wa.archive(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == _want(rows)
