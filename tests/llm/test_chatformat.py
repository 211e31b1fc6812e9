import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from folioforge.llm import chatformat as cf

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "<", "[", ">", "]", "s>", "/", " ", "\n", "é", "好", "a b", "<\\s>", "[\\\\INST]", "😀"]


def _text(rng, n=12):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, n)))


def plain(turns):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)}, one turn at a time."""
    out, wrap = {}, cf.LLAMA.turns
    convs = {}
    for i, t, r, x in turns:
        convs.setdefault(i, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    for i, rows in convs.items():
        rows = [(r[3], r[5]) for r in sorted(rows)]
        loss = "".join(x for r, x in rows if r == "assistant")
        chars = 0
        for r, x in rows:
            head, foot = wrap.get(r, (f"[ROLE]{escaped(r)}[/ROLE] ", " [/TURN]\n"))
            chars += len(head) + len(escaped(x)) + len(foot)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[i] = (len(rows), sha("".join(f"{r}\n{x}\n" for r, x in rows)), len(loss), sha(loss), chars)
    return out


def escaped(text):
    """By hand: a backslash behind the head of what is a control but for backslashes there."""
    out, i = "", 0
    while i < len(text):
        out += text[i]
        k = i + 1
        while text[i] in "<[" and k < len(text) and text[k] == "\\":
            k += 1
        if text[i] in "<[" and any(text.startswith(c[1:], k) for c in cf.LLAMA.controls if c[0] == text[i]):
            out += "\\"
        i += 1
    return out


def _got(df):
    return {r[0]: tuple(r)[1:] for r in cf.digests(df).collect()}


def test_escaping_is_exact():
    rng = random.Random(1)
    texts = [_text(rng) for _ in range(3000)] + ["", *cf.LLAMA.controls]
    got = cf.LLAMA.escaped(pa.array(texts, pa.large_string())).to_pylist()
    assert got == [escaped(t) for t in texts]
    assert [cf.LLAMA.unescape(t) for t in got] == texts
    assert not any(c in t for t in got for c in cf.LLAMA.controls)


def test_assembly_and_way_back():
    rng = random.Random(2)
    turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[/ROLE]"]), _text(rng)) for _ in range(400)]
    buffer, cut, start, end = cf.assemble(*(pa.array(c) for c in zip(*turns, strict=True)))
    raw = buffer.to_pybytes()
    assert list(cf.parse(raw.decode())) == turns
    assert [cf.LLAMA.unescape(raw[a:b].decode()) for a, b in zip(start, end, strict=True)] == [t for _, t in turns]
    assert [list(cf.parse(raw[a:b].decode())) for a, b in zip(cut, cut[1:], strict=False)] == [[t] for t in turns]
    with pytest.raises(ValueError):
        list(cf.parse("no header"))


@pytest.mark.parametrize("part", [1, 300, 2 << 20])
def test_against_the_definition(spark, part):
    rng = random.Random(part)
    rows = [(rng.choice([1, 2, 3, 40, 41, None]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, "A<s>"]), rng.choice([None, _text(rng), _text(rng, 60)])) for _ in range(500)]
    rows += [(50 + k, 0, "user", "x") for k in range(60)] + rows[:20]
    made = cf.format_chats(spark.createDataFrame(rows, SCHEMA), part_bytes=part)
    assert _got(made) == plain(rows)
    parts = made.collect()
    assert (part == 2 << 20) == all(r["part"] == 0 for r in parts)
    for r in parts:
        assert r["n_turns"] == len(list(cf.parse(r["formatted"])))
        assert len(r["loss_start"]) == len(r["loss_end"]) == sum(role == "assistant" for role, _ in cf.parse(r["formatted"]))


def test_turns_read_back(spark):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["user", "assistant", "note"]), _text(rng)) for i in range(20) for t in range(5)]
    got = sorted(tuple(r) for r in cf.parsed(cf.format_chats(spark.createDataFrame(rows, SCHEMA))).select("conv_id", "turn", "role", "text").collect())
    assert got == sorted(rows)


def test_one_hot_conversation_comes_in_parts(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(900)] + [(k, 0, "user", "hi") for k in range(2, 300)]
    made = cf.format_chats(spark.createDataFrame(rows, SCHEMA), part_bytes=4000)
    own = made.where("conv_id = 1").collect()
    assert len(own) > 20 and sorted(r["part"] for r in own) == list(range(len(own)))
    assert _got(made) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", "y", 3)], SCHEMA + ", Part string, FORMATTED string, n_turns int")
    assert cf.format_chats(df).columns == ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"]
    assert _got(cf.format_chats(df)) == plain([(1, 0, "user", "a")])
    assert cf.digests(cf.format_chats(df.limit(0))).count() == 0 and cf.parsed(cf.format_chats(df.limit(0))).count() == 0
    small = spark.createDataFrame([(1, 0, "user", "a" * 3_000_000)], "conv_id int, turn int, role string, text string")
    assert _got(cf.format_chats(small)) == plain([(1, 0, "user", "a" * 3_000_000)])


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = {r[0]: tuple(r)[1:] for r in cf.op13_chat(spark, sf_dir).collect()}
    assert got == {r[0]: r[1:] for r in con.execute(cf.ORACLE_SQL).fetchall()}
    assert got == plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall() + [(-7, 0, "user", cf.CONTROL_TEXT), (-7, 1, "assistant", cf.CONTROL_TEXT)])
