r"""Chat formatting with a grammar round trip.

A formatted conversation is a sequence of turns, each ``### Name: text`` and a line ``</turn>``:

    chat := turn*      turn := "### " name ": " text "\n</turn>\n"

Known roles have names (System, User, Assistant), any other is written as ``=role`` with backslash, colon and newline
behind a backslash. ``###`` and ``</turn>`` are control strings. The parser is deterministic: it reads left to right,
takes a control string behind backslashes as text with one backslash less, ends the turn at the first bare ``</turn>`` on
a line of its own, and refuses any other bare control string. A turn is rendered as it is and parsed again; if that
doesn't give the source, or nothing at all, the conflicting text gets a backslash before each control string (and the
backslashes before it), and it is parsed once more, until both are identical. Turns end by what stands before their end
alone, so a block of turns that parse each to itself parses as their sequence.

A long conversation is formatted in blocks of bounded size, in several tasks if need be; the conversation is its blocks
put together in order. The loss mask is a list of spans of code points in its block, one for each turn of a loss role.

Digests are read back from the blocks alone: whole conversations where they are, others streamed in order through a task
that keeps a hash's state and no text. A digest by SHA-256 has to see a conversation's text in order, so that last step
can't be split; it moves blocks, not rows, and only those of conversations at the ends of tasks.

Defined results: rows go by turn, nulls first, then role and text; a null text or role counts as empty; rows without
conversation form one; repeated rows are turns of their own; a text longer than a block is a block of its own; an empty
table gives no rows; extra columns are ignored. Rows of one conversation, turn, role and beginning of text stay in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.turns import batched, in_order, pieces

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {name: role for role, name in NAMES.items()}
CLOSE = "\n</turn>\n"
CONTROL = re.compile(r"(?<!\\)\\*+(?:###|</turn>)")
HEADER = re.compile(r"### (?:(System|User|Assistant)|=((?:[^\\:\n]|\\[\\:n])*)): ")
LOSS_ROLES = ("assistant",)


class Turn(NamedTuple):
    """A turn that was read, and the span of its text as it stands."""

    role: str
    text: str
    start: int
    end: int


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[0].removeprefix("\\"), text)


def header(role: str) -> str:
    name = NAMES.get(role) or "=" + role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\n")
    return f"### {name}: "


def parse(formatted: str) -> Iterator[Turn]:
    """The turns of a formatted text; ValueError where it isn't one."""
    at = 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        if head is None:
            raise ValueError(f"no header at {at}")
        role = ROLES[head[1]] if head[1] else re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head[2])
        for token in CONTROL.finditer(formatted, head.end()):
            if token[0] == "</turn>" and token.start() > head.end() and formatted.startswith(CLOSE, token.start() - 1):
                break
            if token[0][0] != "\\":
                raise ValueError(f"bare control string at {token.start()}")
        else:
            raise ValueError(f"turn at {at} has no end")
        end = token.start() - 1
        yield Turn(role, unescaped(formatted[head.end() : end]), head.end(), end)
        at = end + len(CLOSE)


def reads_as(formatted: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(formatted)] == [(role, text)]
    except ValueError:
        return False


def rendered(role: str, text: str) -> tuple[str, str]:
    """A turn as a text that parses to it alone, and the text's form in it."""
    for body in (text, escaped(text)):
        whole = header(role) + body + CLOSE
        if reads_as(whole, role, text):
            return whole, body
    raise ValueError(f"a turn of role {role!r} can't be read back")


def block_of(turns: Iterable[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[dict[str, int]]]:
    """The turns formatted, and the spans under the loss mask. The block is read again as a whole before it is given out."""
    parts, spans, at, source = [], [], 0, list(turns)
    for role, text in source:
        whole, body = rendered(role, text)
        if role in loss_roles:
            start = at + len(header(role))
            spans.append({"start": start, "end": start + len(body)})
        parts.append(whole)
        at += len(whole)
    out = "".join(parts)
    if [t[:2] for t in parse(out)] != source:
        raise ValueError("formatted turns don't read as their source")
    return out, spans


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, block (ascending), whole (certain to be the conversation's only block), formatted, loss (array of start, end)."""
    kind = rows.schema[conv_col].dataType.simpleString()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    schema = pa.schema([("conv_id", pa.string()), ("block", pa.int64()), ("whole", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((held[0][0], number, whole, *block_of((r[1:] for r in held), loss_roles)) for number, held, whole in pieces(batches, 2))
        yield from batched(found, schema, text_at=3)

    # ranges go by the texts' beginnings, so that no long text becomes a range's end
    placed = in_order(own.withColumn("begins", F.substring("text", 1, 64)), ["conv_id", "turn", "role", "begins"], ["text"])
    out = placed.select(F.col("conv_id").cast("string"), "role", "text").mapInArrow(run, "conv_id string, block long, whole boolean, formatted string, loss array<struct<start:int,end:int>>")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


class Digest:
    """What is read back from a conversation's blocks, one after the other."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict[str, int]]) -> Digest:
        for turn in parse(formatted):
            self.turns += 1
            self.turns_sha.update(f"{turn.role}\n{turn.text}\n".encode())
        for span in loss:
            text = unescaped(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss_sha.update(text.encode())
        self.chars += len(formatted)
        return self

    def row(self) -> tuple[int, str, int, str, int]:
        return self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_FIELDS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the output of ``format_chats``."""
    block = [("block", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    kind = blocks.schema["conv_id"].dataType.simpleString()
    mixed = pa.schema([("conv_id", pa.string()), *block, *DIGEST_FIELDS])
    names = "conv_id string, block long, formatted string, loss array<struct<start:int,end:int>>, "

    def whole_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = ((c, n, None, None, *Digest().add(text, loss).row()) if whole else (c, n, text, loss, *[None] * 5) for c, n, whole, text, loss in rows)
        yield from batched(found, mixed, text_at=2)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

        def folded() -> Iterator[tuple]:
            for conv, own in groupby(rows, lambda r: r[0]):
                digest = Digest()
                for _, _, text, loss, *done in own:
                    if text is None:
                        yield conv, *done
                    else:
                        digest.add(text, loss)
                if digest.chars:
                    yield conv, *digest.row()

        yield from batched(folded(), pa.schema([("conv_id", pa.string()), *DIGEST_FIELDS]))

    first = blocks.select(F.col("conv_id").cast("string"), "block", "whole", "formatted", "loss").mapInArrow(whole_ones, names + DIGEST)
    out = first.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(others, "conv_id string, " + DIGEST)
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


#: A conversation whose texts hold the template's own control strings, and escaped ones.
CONFLICT = r"\### Assistant: </turn> ok"


def op12_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the conflicting one, formatted and read back from what was formatted."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], rows.schema)
    return read_back(format_chats(rows.unionByName(more)))


QUERIES = {"op12_grammar_round_trip": op12_grammar_round_trip}
ORACLES = {
    "op12_grammar_round_trip": r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r)),
         f AS (SELECT *, 4 + 2 + 9 + length(text) + len(regexp_extract_all(text, '###|</turn>'))
                         + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
                                ELSE 1 + length(replace(replace(replace(role, '\', '\\'), ':', '\:'), chr(10), '\n')) END AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id
    """
}
