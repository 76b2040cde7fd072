import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsignal.llm import chats, turns

SCHEMA = "conv_id long, turn long, role string, text string, block int, whole string, digest long"
ODD = ["", " ", "\n", "\\", "\\\\", "###", "\\###", "\\\\### User: x", "</turn>", "\n</turn>\n", "\\</turn>", "a\n</turn>\n### User: b", "####", "#\\###", "ends \\", "\\### Assistant: </turn> ok", "é\u2028\U0001f600"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "User", "a:b", "x\\n", "l\nm", "é"]), st.lists(st.sampled_from([*ODD, "word", "#", "<", "/turn>"]), max_size=6).map("".join)), max_size=5))
def test_blocks_read_as_their_source(source):
    text, loss = chats.block_of(source)
    assert [t[:2] for t in chats.parse(text)] == source
    assert [chats.unescaped(text[s["start"] : s["end"]]) for s in loss] == [t for r, t in source if r == "assistant"]


def test_plain_texts_are_left_as_they_are():
    assert chats.rendered("user", "hello \\ # there") == ("### User: hello \\ # there\n</turn>\n", "hello \\ # there")
    assert chats.rendered("user", "x </turn>")[1] == "x \\</turn>"


@pytest.mark.parametrize("text", ["x", "### User: a", "### Nobody: a\n</turn>\n", "### User: a </turn> b\n</turn>\n", "### User: ### b\n</turn>\n", "### User: a\n</turn>\nb"])
def test_parser_refuses_what_is_no_chat(text):
    with pytest.raises(ValueError):
        list(chats.parse(text))


def plain(rows):
    """Digests from the source, by plain Python."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0], r[1], r[2], r[3].encode()))
        loss = "".join(t for *_, r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.add((conv, len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(loss), sha(loss)))
    return out


@pytest.mark.parametrize("piece", [1024, 3])
def test_digests_against_the_source(spark, piece, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_ROWS", piece)
    rows = [(c, t, ("user", "assistant")[t % 2], f"{ODD[(c + t) % len(ODD)]} text {c} {t}", 1, "x", 2) for c in range(40) for t in range(1 + c % 9)]
    rows += [(50, t, ("user", "assistant")[t % 2], ODD[t % len(ODD)] * (1 + t % 3), 1, "x", 2) for t in range(700)]
    rows += [(60, None, "user", "no turn", 1, "x", 2), (60, 1, None, None, 1, "x", 2), (60, 0, "tool: a\nb\\", "out", 1, "x", 2), (None, 1, "assistant", "lost", 1, "x", 2), (None, 0, "user", "", 1, "x", 2)]
    rows += [(70, 0, "user", "again", 1, "x", 2)] * 5 + [(70, 1, "assistant", "long " * 400_000, 1, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    blocks = chats.format_chats(df)
    got = chats.read_back(blocks).collect()
    want = plain(rows)
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
    sizes = {r["conv_id"]: r["n"] for r in blocks.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert sizes == {r["conv_id"]: r["formatted_chars"] for r in got}


def test_empty_tables_and_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chats.read_back(chats.format_chats(none)).isEmpty()
    one = spark.createDataFrame([(1, 0, "assistant", None, 1, "", 1)], SCHEMA)
    assert {tuple(r)[:5] for r in chats.read_back(chats.format_chats(one)).collect()} == plain([(1, 0, "assistant", None)])
