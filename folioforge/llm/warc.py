"""WARC archives, and the normaliser of archives that are one gzip stream.

An archive written as one gzip stream can only be read from its start. The normaliser inflates such a file once, in blocks,
finds the record bounds by their Content-Length, writes every record as a gzip member of its own and, beside it, an index
of (record id, type, offset, length). A record is then read by a seek. Files are written under a name of the attempt and
renamed, so a retried task replaces, and never mixes with, what a lost executor left.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load, ship
from . import textkernel as tk
from .scratch import Scratch, join_hot, small

BLOCK = 1 << 20
#: Payload bytes of an archive file; a larger record has a file of its own.
FILE_BYTES = 64 << 20
_GZIP = 16 + zlib.MAX_WBITS
#: Fixed value: the record format's date field; archives made from a table have no fetch time.
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record (without the payload) if it refers to another."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(url: str | None) -> str:
    """A header value: no line breaks."""
    return " ".join((url or "").split())


class Inflater:
    """Bytes of a gzip file of one or many members, inflated a block at a time. A file that ends within a member is an error."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.held = raw, None, b""
        self.ready, self.at, self.done = b"", 0, False

    def _more(self) -> None:
        data = self.held or self.raw.read(BLOCK)
        new = b""
        if data:
            if self.z is None:
                self.z = zlib.decompressobj(_GZIP)
            new = self.z.decompress(data, BLOCK)
            self.held = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        elif self.z is None:
            self.done = True
        else:
            new = self.z.flush()
            if not self.z.eof:
                raise EOFError("the gzip stream is cut off")
        if self.z is not None and self.z.eof:
            self.held = self.z.unused_data or self.held if data else b""
            self.z = None
        self.ready, self.at = self.ready[self.at :] + new, 0

    def take(self, n: int) -> bytes:
        """Exactly n bytes, fewer only at the end."""
        while len(self.ready) - self.at < n and not self.done:
            self._more()
        out = self.ready[self.at : self.at + n]
        self.at += len(out)
        return out

    def line(self) -> bytes:
        """Up to and with the next newline."""
        while (end := self.ready.find(b"\n", self.at)) < 0 and not self.done:
            self._more()
        end = len(self.ready) if end < 0 else end + 1
        out, self.at = self.ready[self.at : end], end
        return out


def headers(source: Inflater) -> tuple[bytes, dict[str, str]] | None:
    """(header block, fields in lower case) of the next record; None at the end."""
    line = source.line()
    while line in (b"\r\n", b"\n"):
        line = source.line()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    block, fields = [line], {}
    while (line := source.line()) not in (b"\r\n", b"\n", b""):
        block.append(line)
        k, _, v = line.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    return b"".join(block) + b"\r\n", fields


def normalise(raw: BinaryIO, out: BinaryIO) -> Iterator[tuple[str, str, int, int]]:
    """Rewrite a gzip WARC file with a member for each record; yields (record id, type, offset, length). Memory: a few blocks."""
    source, at = Inflater(raw), 0
    while (found := headers(source)) is not None:
        block, fields = found
        z = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
        size = out.write(z.compress(block)) or 0
        left = int(fields.get("content-length", 0))
        while left:
            part = source.take(min(left, BLOCK))
            if not part:
                raise EOFError("a record is cut off")
            left -= len(part)
            size += out.write(z.compress(part)) or 0
        size += out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0
        yield fields.get("warc-record-id", ""), fields.get("warc-type", ""), at, size
        at += size


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _put(path: str, fill) -> None:
    """Write a file aside and rename it into place."""
    fs, name = _open(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    aside = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as out:
        fill(out)
    fs.move(aside, name)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(path, records): one-stream archives of rows (page_id, url, payload, sha, refers_to), closed at FILE_BYTES of payload.

    A null payload is empty, null ids and repeated rows are written like others, no row writes no file; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, paths, counts = TaskContext.get().partitionId(), [], []
        state: dict = {"z": None}

        def close() -> None:
            if state["z"] is not None:
                state["out"].write(state["z"].flush())
                state["out"].close()
                state["fs"].move(state["aside"], state["name"])
                paths.append(state["path"])
                counts.append(state["n"])
                state["z"] = None

        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["payload"] or "").encode("utf-8", "surrogatepass")
                if state["z"] is not None and state["bytes"] + len(payload) > FILE_BYTES:
                    close()
                if state["z"] is None:
                    path = f"{folder}/part-{part:06d}-{len(paths):05d}.warc.gz"
                    fs, name = _open(path)
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    aside = f"{name}.{uuid.uuid4().hex}"
                    state = {"z": zlib.compressobj(6, zlib.DEFLATED, _GZIP), "fs": fs, "name": name, "aside": aside, "path": path, "n": 0, "bytes": 0, "out": fs.open_output_stream(aside, compression=None)}
                state["out"].write(state["z"].compress(record(r["page_id"], r["url"], payload, r["sha"], r["refers_to"])))
                state["n"] += 1
                state["bytes"] += len(payload)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return rows.select("page_id", "url", "payload", "sha", "refers_to").mapInArrow(tk.tidied(run), "path string, records long")


def normalise_archives(paths: DataFrame, folder: str) -> DataFrame:
    """(path, record_id, type, offset, length): the index of the rewritten files, which also stands beside each as JSON lines.

    Each file is inflated once, record by record, whatever its size; an empty one has no records, one that is cut off is an
    error. A file that is listed twice is rewritten to the same place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column("path").to_pylist():
                to = f"{folder}/{src.rsplit('/', 1)[1]}"
                index: list = []
                fs, name = _open(src)
                with fs.open_input_stream(name, compression=None) as raw:
                    _put(to, lambda out, raw=raw, index=index: index.extend(normalise(raw, out)))
                lines = "".join(json.dumps({"id": i, "type": t, "offset": o, "length": n}) + "\n" for i, t, o, n in index)
                _put(f"{to}.index", lambda out, lines=lines: out.write(lines.encode()))
                cols = list(zip(*index, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([to] * len(index), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["path", "record_id", "type", "offset", "length"])

    return paths.select("path").mapInArrow(tk.tidied(run), "path string, record_id string, type string, offset long, length long")


def read_records(index: DataFrame) -> DataFrame:
    """Records by their place: page_id, url, payload, record_type, payload_bytes, payload_digest, refers_to, declared.

    Each is read by a seek to its member. payload_bytes and payload_digest are of the payload that was read, `declared` is the
    digest that the header names; a response for which the two differ is an error. A revisit holds no payload: its payload and
    the two are null, see revisited(). An empty index gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "record_type", "payload_bytes", "payload_digest", "refers_to", "declared"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        held = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for r in batch.to_pylist():
                if held is None or held[0] != r["path"]:
                    if held:
                        held[1].close()
                    fs, name = _open(r["path"])
                    held = r["path"], fs.open_input_file(name)
                held[1].seek(r["offset"])
                source = Inflater(io.BytesIO(held[1].read(r["length"])))
                _, f = headers(source)
                body = source.take(int(f["content-length"]))
                declared, kind, ref = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], _page(f.get("warc-refers-to"))
                own = (body, kind, len(body), digest(body)) if kind == "response" else (None, kind, None, None)
                if own[3] not in (None, declared):
                    raise ValueError(f"{f['warc-record-id']}: the payload doesn't match its digest")
                for to, v in zip(out, (_page(f["warc-record-id"]), f["warc-target-uri"], *own, ref, declared), strict=True):
                    to.append(v)
                size += len(body)
                if size > 8 * BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        if held:
            held[1].close()

    schema = "page_id long, url string, payload binary, record_type string, payload_bytes long, payload_digest string, refers_to long, declared string"
    return index.select("path", "offset", "length").mapInArrow(tk.tidied(run), schema)


def revisited(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of written records; a revisit has bytes and digest of the
    response that it refers to (by id and declared digest), as that was read. records is a written table."""
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared")
    wanted = again.groupBy("refers_to", "declared").agg(F.count(F.lit(1)).alias("times"))
    seen = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared"), "payload_bytes").distinct()
    one = seen.join(wanted, ["refers_to", "declared"])
    found = join_hot(again, one, ["refers_to", "declared"], "left", "times").withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("declared")))
    return records.where("record_type = 'response'").select(*cols).unionByName(found.select(*cols))


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text else None


def with_revisits(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, sha and refers_to: of payloads of at least `least` bytes that are equal, all but the smallest page_id's refer to it.

    Only payloads that occur twice are looked up, and the one row of each meets its copies in a join that can be split.
    A page without an id is a response, and nothing refers to it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    slim = rows.select("page_id", F.sha1("payload").alias("s"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    first = slim.where("page_id is not null").groupBy("s", "n").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("s", "n", "first")
    refs = scratch.put(slim.join(first, ["s", "n"]).where("page_id > first").select("page_id", "s", "first").distinct(), "refs")
    named = rows.withColumn("s", F.sha1("payload"))
    out = named.join(small(refs), ["page_id", "s"], "left")

    @F.pandas_udf("string")
    def base32(s):
        return s.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    return out.select("page_id", "url", "payload", base32("s").alias("sha"), F.col("first").alias("refers_to"))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """The index (path, record_id, type, offset, length) of normalised archives with a record for every row of pages.

    A null html is empty. Repeated ids are records of their own. Rows are written where they are read; no page is shuffled
    unless the revisits are too many to broadcast.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc")
    whole = scratch.put(write_archives(with_revisits(pages, least, scratch), scratch.path("whole")), "files")
    n = max(1, whole.count())
    width = 4 * spark.sparkContext.defaultParallelism
    index = scratch.put(normalise_archives(whole.repartition(min(n, width)), scratch.path("records")), "index")
    scratch.drop("whole")  # only now: a task that is run again must find them
    return index


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(load(spark, sf_dir, "pages"), 0)
    rows = read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared")
    return revisited(Scratch(spark, "warc-read").put(rows, "records"))


#: The same rows in DuckDB; base32 by way of the digest's bits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(CAST(from_hex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
d AS (SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS sha FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(octet_length(encode(d.h)) AS BIGINT) AS payload_bytes, sha AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""
