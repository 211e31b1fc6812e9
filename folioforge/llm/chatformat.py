"""Chat formatting by columnar byte assembly, with a loss mask, and its way back.

A conversation becomes one text: each turn is a header, its text and a footer. Control strings inside a text are escaped with
one backslash behind their first character; where such backslashes stand already, they get one more, so the way back is exact.

Rows are dealt by conversation and sorted by turn. Of each block of rows the lengths of all segments give, by a running sum, the
place of every one in the output, and index arrays scatter all headers and all texts into one preallocated Arrow buffer. A
conversation is one row of the result unless it is longer than PART_BYTES; then it comes in parts of whole turns, so that no
task ever holds one whole, and everything behind reads it part by part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import load, ship
from . import textkernel as tk

#: Bytes of a conversation that are put together at a time; a longer one comes in parts.
PART_BYTES = 2 << 20
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Header and footer by role. A role that has none is named in its header. The controls are what no text may hold unescaped:
    they begin with < or [, and none of them is the beginning of another."""

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE] ", " [/TURN]\n")
    loss_roles: tuple[str, ...] = ("assistant",)

    @cached_property
    def controls(self) -> list[str]:
        return sorted({s.strip() for pair in self.turns.values() for s in pair} | {s.strip() for s in self.named})

    def _parts(self) -> str:
        """Alternatives of two groups: a control's first character with the backslashes behind it, and its rest."""
        heads = sorted({c[0] for c in self.controls})
        rests = {h: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == h) for h in heads}
        return "|".join(rf"({re.escape(h)}\\*){{}}({rests[h]})" for h in heads)

    def escaped(self, texts: pa.Array) -> pa.Array:
        heads = len({c[0] for c in self.controls})
        lead, rest = ("".join(f"\\{2 * k + j}" for k in range(heads)) for j in (1, 2))
        return pc.replace_substring_regex(texts, self._parts().format(*[""] * heads), lead + r"\\" + rest)

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(self._parts().format(*[r"\\"] * len({c[0] for c in self.controls})))

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: "".join(filter(None, m.groups())), text) if ESCAPE in text else text


LLAMA = Template()


def _utf8(a: pa.Array) -> pa.Array:
    return pc.fill_null(a.cast(pa.large_string()), "")


def assemble(roles: pa.Array, texts: pa.Array, template: Template = LLAMA) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, offsets of the turns in it, and where each turn's text starts and ends) of a block of turns."""
    roles, texts = _utf8(roles), template.escaped(_utf8(texts))
    n = len(texts)
    names = list(template.turns)
    kind = pc.fill_null(pc.index_in(roles, value_set=pa.array(names, pa.large_string())), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    own = template.escaped(pc.if_else(pa.array(kind == len(names)), roles, pa.scalar("", pa.large_string())))

    # segments of a turn: head, role where it has to be named, the rest of the head, text, foot
    fixed = [(h, "", f) for h, f in template.turns.values()] + [template.named]
    raw = [s.encode() for t in fixed for s in t]
    table = np.frombuffer(b"".join(raw), np.uint8)
    length = np.array([len(x) for x in raw], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    sources, sizes, begins = [], [], []
    for column in (0, "role", 1, "text", 2):
        if isinstance(column, int):
            sources.append(table)
            sizes.append(length[3 * kind + column])
            begins.append(start[3 * kind + column])
        else:
            data, off = tk.column_bytes(own if column == "role" else texts)
            sources.append(data)
            sizes.append(np.diff(off))
            begins.append(off[:-1])
    ends = np.cumsum(np.stack(sizes, 1).ravel()) if n else np.zeros(0, np.int64)
    place = (ends - np.stack(sizes, 1).ravel()).reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k in range(5):
        size = sizes[k]
        ahead = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        out[np.repeat(place[:, k] - ahead, size) + step] = sources[k][np.repeat(begins[k] - ahead, size) + step]
    return buffer, np.append(place[:, 0], total), place[:, 3], place[:, 3] + sizes[3]


def _texts(buffer: pa.Buffer, cut: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), buffer])


def _lists(start: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(start.astype(np.int64)))


class _Parts:
    """Turns in order in, formatted conversations out: a block ends with a whole conversation, or with `most` bytes of one."""

    def __init__(self, template: Template, most: int):
        self.template, self.most, self.held, self.last, self.part = template, most, [], None, 0

    def put(self, batch: pa.RecordBatch, final: bool) -> pa.RecordBatch | None:
        table = pa.Table.from_batches([*self.held, batch]).combine_chunks()
        conv = table["conv_id"].combine_chunks()
        n = len(conv)
        new = np.ones(n, bool)
        same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False) | (conv[1:].is_null().to_numpy(zero_copy_only=False) & conv[:-1].is_null().to_numpy(zero_copy_only=False))
        new[1:] = ~same
        stop = n
        if not final:
            stop = int(np.flatnonzero(new)[-1]) if n else 0
            tail = table.slice(stop)
            if sum(b.nbytes for b in tail.to_batches()) > self.most:
                stop = n
        self.held = table.slice(stop).combine_chunks().to_batches() if stop < n else []
        if not stop:
            return None
        head = table.slice(0, stop)
        conv, new = conv[:stop], new[:stop]
        buffer, cut, text, end = assemble(head["role"].combine_chunks(), head["text"].combine_chunks(), self.template)
        first = np.flatnonzero(new)
        at = np.append(first, stop)
        where = cut[:-1]
        base = np.repeat(where[first], np.diff(at))
        learnt = pc.is_in(_utf8(head["role"].combine_chunks()), value_set=pa.array(self.template.loss_roles, pa.large_string())).to_numpy(zero_copy_only=False)
        masks = np.concatenate([[0], np.cumsum(learnt)])[at]
        part = np.zeros(len(first), np.int64)
        now = conv[0].as_py()
        part[0] = self.part if self.last is not None and self.last[0] == now else 0
        self.last, self.part = (conv[stop - 1].as_py(),), int(part[-1]) + 1
        cols = [conv.take(pa.array(first)), pa.array(part), pa.array(np.diff(at)), _texts(buffer, cut[at]), _lists((text - base)[learnt], masks), _lists((end - base)[learnt], masks)]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, role, text with each conversation in one task, its turns in order: by turn (a null one first), then by role and text."""
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(turns: DataFrame, template: Template = LLAMA, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_start, loss_end: each conversation as one text, or as parts of whole turns from 0
    where it is longer than part_bytes. loss_start and loss_end are byte places in `formatted` of what is learnt: the texts of
    the template's loss roles, escaped as they stand there.

    A null text or role is empty, and a role that the template has no header for is named in its header. Rows of a null conv_id
    are one conversation; repeated rows are turns of their own, equal turns in the order of role and text. An empty table
    has no conversation. Other columns are ignored, so they may have any names.
    """
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = _Parts(template, part_bytes), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # blocks of bounded bytes, whole turns each
            _, off = tk.column_bytes(batch.column("text"))
            for a, b in tk.chunks(off, part_bytes, 1 << 20):
                if last is not None and (done := parts.put(last, False)) is not None:
                    yield done
                last = batch.slice(a, b - a)
        if last is not None:
            yield parts.put(last, True)

    kind = turns.schema["conv_id"].dataType
    longs = T.ArrayType(T.LongType())
    fields = [("conv_id", kind), ("part", T.LongType()), ("n_turns", T.LongType()), ("formatted", T.StringType()), ("loss_start", longs), ("loss_end", longs)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return in_order(turns).mapInArrow(tk.tidied(_as_strings(run)), schema)


def _as_strings(run):
    """Parts are below two gigabytes, so that Spark's offsets of 32 bits do."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            cols = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in b.columns]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return both


def parse(formatted: str, template: Template = LLAMA) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    openers = [(h, role, f) for role, (h, f) in template.turns.items()]
    while at < len(formatted):
        for head, role, foot in openers:
            if formatted.startswith(head, at):
                break
        else:
            head, middle, foot = template.named
            if not formatted.startswith(head, at):
                raise ValueError(f"no header at character {at}")
            stop = formatted.index(middle, at)
            role, head = template.unescape(formatted[at + len(head) : stop]), formatted[at : stop + len(middle)]
        begin = at + len(head)
        stop = formatted.index(foot, begin)
        yield role, template.unescape(formatted[begin:stop])
        at = stop + len(foot)


def parsed(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """conv_id, part, turn, role, text: the turns read back from formatted conversations, numbered from 0 in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                turns = list(parse(batch.column("formatted")[j].as_py(), template))
                same = [pa.array([batch.column(c)[j].as_py()] * len(turns), batch.column(c).type) for c in ("conv_id", "part")]
                cols = [*same, pa.array(range(len(turns)), pa.int64()), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "turn", "role", "text"])

    ids = [formatted.schema[c] for c in ("conv_id", "part")]
    schema = T.StructType([*ids, T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return formatted.select("conv_id", "part", "formatted").mapInArrow(tk.tidied(run), schema)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, starts: list[int], ends: list[int], template: Template) -> None:
        for role, text in parse(formatted, template):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        raw = formatted.encode("utf-8", "surrogatepass")
        for a, b in zip(starts, ends, strict=True):
            text = template.unescape(raw[a:b].decode("utf-8", "surrogatepass"))
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(formatted)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """A row a conversation of what is read back from format_chats: n_turns, turns_sha256 of role, newline, text, newline of every
    turn, loss_chars and loss_sha256 of what the loss mask covers, unescaped, formatted_chars. Parts must follow each other, as
    format_chats leaves them; digests run on from part to part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d, done = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 6
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        def close() -> None:
            if d is not None:
                done.append((now, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_start", "loss_end")), strict=True):
                if row[1] == 0:
                    close()
                    now, d = row[0], _Digest()
                d.add(row[2], row[3], row[4], template)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    schema = T.StructType([formatted.schema["conv_id"], *T.StructType.fromDDL(DIGEST).fields])
    return formatted.select("conv_id", "part", "formatted", "loss_start", "loss_end").mapInArrow(tk.tidied(run), schema)


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return digests(format_chats(turns.unionByName(more)))


#: The same rows in DuckDB, from the turns alone; the template's lengths give formatted_chars.
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, regexp_replace(text, '(<\\*)(/s>|<SYS>>|</SYS>>|s>)|(\[\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\3\\\2\4', 'g') AS x,
  regexp_replace(role, '(<\\*)(/s>|<SYS>>|</SYS>>|s>)|(\[\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\3\\\2\4', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 23 + length(r) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
