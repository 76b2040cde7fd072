"""Repair of conversations' structure by a cheapest path through an edit lattice.

A conversation's rows are edited so that the initials of their roles follow ``(s?(ua)+)?``. The lattice's nodes are
(rows read, state of the grammar); keeping, reroling or deleting a row leads to the next row, inserting stays at it. It is
never built: Dijkstra's search pushes a node's neighbours when it pops the node, the key is (cost, audit), and the first
accepting end node that is popped ends it. The audit is the edits' initials (K, R, D, I); it tells the path, so two paths
to a node of equal cost never have one audit that begins with the other, and the key is a proper order along paths.

Faults of a row: blank (nothing but space), duplicate (role and text stood earlier in the conversation), truncated (the last
character that isn't space doesn't end a sentence). Blank and duplicate rows must be deleted.

How it runs: which rows are a text's first occurrence is found by a grouped minimum of (conversation, role, digest), and
this minimum travels as a row of its own that sorts just before the row it marks; no row of a repeated text meets the
others. Rows are dealt by ranges of (conversation, turn, ...) and cut into pieces (``turns.py``). A whole conversation is
repaired where it is. Pieces of others give the cheapest path from each state to each state, and a conversation's
pieces are put together from these: costs and audits first, then each piece's texts stream past its audit in order.

Defined results: rows go by turn (nulls first), then role, then the text's MD5; identical rows keep together; null roles and texts are one
space; a role's initial is its first character; rows without conversation form one; a conversation whose rows are all
dropped has zeros, an empty audit and the digest of nothing; an empty table gives no rows; extra columns are ignored. An
audit is one string, so a conversation can have about 10^9 rows at most.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.turns import batched, in_order, pieces
from gridsignal.session import written

SPACE = " \t\n\v\f\r"
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
#: States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


Path = tuple[int, str]


def edits(state: int, initial: str | None, fault: str, costs: Costs) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows read, next state) of the edits at a node; ``initial`` is None where no row is left."""
    for letter, to in NEXT[state].items():
        if letter in ROLES:
            yield costs.insert, "I", 0, to
    if initial is None:
        return
    yield costs.delete, "D", 1, state
    if fault in (BLANK, DUPLICATE):
        return
    more = costs.truncated if fault == TRUNCATED else 0
    for letter, to in NEXT[state].items():
        if letter == initial:
            yield more, "K", 1, to
        elif letter in ROLES:
            yield costs.rerole + more, "R", 1, to


def popped(initials: list[str], faults: str, start: int, costs: Costs) -> Iterator[tuple[int, Path]]:
    """The end nodes' states with their cheapest paths from ``start``, in the order of (cost, audit)."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(initials):
            yield state, (cost, audit)
        left = at < len(initials)
        for more, letter, read, to in edits(state, initials[at] if left else None, faults[at] if left else SOUND, costs):
            if (at + read, to) not in done:
                heapq.heappush(heap, (cost + more, audit + letter, at + read, to))


def cheapest(initials: list[str], faults: str, costs: Costs = Costs()) -> Path:  # noqa: B008
    """The cost and the audit of a whole conversation: the first accepting end node that is popped."""
    return next(path for state, path in popped(initials, faults, START, costs) if state in ACCEPTING)


def crossings(initials: list[str], faults: str, costs: Costs = Costs()) -> dict[tuple[int, int], Path]:  # noqa: B008
    """The cheapest path of a piece from each state to each state."""
    return {(start, end): path for start in NEXT for end, path in popped(initials, faults, start, costs)}


def joined(parts: list[dict[tuple[int, int], Path]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of a conversation in pieces, and each piece's first state and audit."""
    now: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
    for part in parts:
        best: dict[int, tuple[int, str, tuple]] = {}
        for (start, end), (cost, audit) in part.items():
            if start in now:
                before, so_far, trail = now[start]
                if end not in best or (before + cost, so_far + audit) < best[end][:2]:
                    best[end] = (before + cost, so_far + audit, (trail, start, audit))
        now = best
    cost, _, trail = min(now[s] for s in ACCEPTING if s in now)
    out = []
    while trail:
        trail, start, audit = trail
        out.append((start, audit))
    return cost, out[::-1]


def repaired(rows: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that an audit leaves."""
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        to = role[:1] if letter == "K" else next(x for x in NEXT[state] if x in ROLES)
        state = NEXT[state][to]
        yield (role if letter == "K" else ROLES[to]), text


@dataclass
class Summary:
    """What a piece of a conversation adds to its counts; ``first`` and ``last`` are (turn, initial) of its ends."""

    rows: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: tuple[int | None, str] | None = None
    last: tuple[int | None, str] | None = None

    def then(self, other: Summary) -> Summary:
        """Both, ``other`` coming after this one."""
        if not self.rows or not other.rows:
            return self if self.rows else other
        ends = [x for x in (self.low, self.high, other.low, other.high) if x is not None]
        meet = self.last[0] is not None and self.last[0] == other.first[0]
        illegal = self.illegal + other.illegal + (self.last[1] + other.first[1] not in LEGAL)
        counts = [a + b for a, b in ((self.blank, other.blank), (self.duplicate, other.duplicate), (self.truncated, other.truncated))]
        return Summary(self.rows + other.rows, min(ends, default=None), max(ends, default=None), self.turns + other.turns - meet, *counts, illegal, self.first, other.last)

    def counts(self) -> tuple[int, int, int, int, int]:
        return (0 if self.low is None else self.high - self.low + 1 - self.turns), self.blank, self.duplicate, self.truncated, self.illegal


@dataclass
class Piece:
    """A piece's rows: turn, role, text, whether role and text stand here for the first time."""

    rows: list[tuple[int | None, str, str, bool]] = field(default_factory=list)

    def initials(self) -> list[str]:
        return [r[1][:1] for r in self.rows]

    def faults(self) -> str:
        return "".join(self._fault(text, first) for _, _, text, first in self.rows)

    @staticmethod
    def _fault(text: str, first: bool) -> str:
        ends = text.rstrip(SPACE)[-1:]
        return BLANK if not ends else DUPLICATE if not first else SOUND if ends in ".!?" else TRUNCATED

    def summary(self) -> Summary:
        out = Summary()
        for (turn, role, _, _), fault in zip(self.rows, self.faults(), strict=True):
            one = (turn, role[:1])
            out = out.then(Summary(1, turn, turn, int(turn is not None), int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0, one, one))
        return out


def piece_of(held: list[tuple]) -> Piece:
    """From rows (conversation, kind, turn, role, digest, text): a mark stands just before the row that it marks."""
    out, marked = Piece(), None
    for _, kind, turn, role, digest, text in held:
        if kind == MARK:
            marked = (turn, role, digest)
        elif kind == ROW:
            out.rows.append((turn, role, text, marked == (turn, role, digest)))
            marked = None
    return out


#: Kinds of rows in the order of pieces.
MARK, ROW, DROPPED = 0, 1, 2
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
RESULT_FIELDS = [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
END = pa.struct([("turn", pa.int64()), ("initial", pa.string())])
SUMMARY = [*[(n, pa.int64()) for n in ("rows", "low", "high", "turns", "n_blank", "n_duplicate", "n_truncated", "n_illegal")], ("first", END), ("last", END)]
CONTENT = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
OPEN = (
    "conv_id string, piece long, done boolean, " + RESULT + ", rows long, low long, high long, turns long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, "
    "first struct<turn:long,initial:string>, last struct<turn:long,initial:string>, paths array<struct<start:int,end:int,cost:long,audit:string>>, roles array<string>, texts array<string>"
)
OPEN_SCHEMA = pa.schema([("conv_id", pa.string()), ("piece", pa.int64()), ("done", pa.bool_()), *RESULT_FIELDS, *SUMMARY, ("paths", pa.list_(PATH)), *CONTENT])


def digest_of(lines: Iterator[tuple[str, str]]) -> str:
    sha = hashlib.sha256()
    for i, (role, text) in enumerate(lines):
        sha.update((("\n" if i else "") + f"{role}:{text}").encode())
    return sha.hexdigest()


def repaired_pieces(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    """A row a piece: the result where the piece is a whole conversation, else what it adds to one."""
    for number, held, whole in pieces(batches, 5, lambda row: row[1] == MARK):
        piece = piece_of(held)
        total = piece.summary()
        if whole:
            cost, audit = cheapest(piece.initials(), piece.faults(), costs)
            yield (held[0][0], number, True, *total.counts(), cost, audit, digest_of(repaired([r[1:3] for r in piece.rows], audit)), *[None] * 13)
            continue
        paths = [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in crossings(piece.initials(), piece.faults(), costs).items()]
        ends = [None if x is None else {"turn": x[0], "initial": x[1]} for x in (total.first, total.last)]
        yield (held[0][0], number, False, *[None] * 8, total.rows, total.low, total.high, total.turns, total.blank, total.duplicate, total.truncated, total.illegal, *ends, paths, [r[1] for r in piece.rows], [r[2] for r in piece.rows])


def repair(rows: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:  # noqa: B008
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    Rows whose ``dropped_col`` is true only say that their conversation exists.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    own = rows.select(F.col(conv_col).cast("string").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), dropped.alias("dropped"))
    own = own.select("conv_id", F.when(F.col("dropped"), DROPPED).otherwise(ROW).alias("kind"), "turn", "role", F.md5("text").alias("digest"), F.when(~F.col("dropped"), F.col("text")).alias("text"))
    # the first occurrence of each role and text; a struct's least goes by turns with nulls first
    firsts = own.filter(F.col("kind") == ROW).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    marks = firsts.select("conv_id", F.lit(MARK).alias("kind"), F.col("at.turn").alias("turn"), "role", "digest", F.lit(None).cast("string").alias("text"))
    placed = in_order(own.unionByName(marks), ["conv_id", "turn", "role", "digest"], ["kind"])
    mixed = written(placed.mapInArrow(lambda batches: batched(repaired_pieces(batches, costs), OPEN_SCHEMA), OPEN))
    done = mixed.filter("done").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    return done.unionByName(put_together(mixed.filter("NOT done"))).withColumn("conv_id", F.col("conv_id").cast(kind))


def put_together(open_pieces: DataFrame) -> DataFrame:
    """Results of the conversations that lie in several pieces, or may do so."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        total, parts = Summary(), []
        for r in group.itertuples(index=False):
            whole = lambda x: None if pd.isna(x) else int(x)
            ends = [None if x is None else (whole(x["turn"]), x["initial"]) for x in (r.first, r.last)]
            total = total.then(Summary(int(r.rows), whole(r.low), whole(r.high), *(int(v) for v in (r.turns, r.n_blank, r.n_duplicate, r.n_truncated, r.n_illegal)), *ends))
            parts.append({(int(p["start"]), int(p["end"])): (int(p["cost"]), p["audit"]) for p in r.paths})
        cost, trail = joined(parts)
        out = pd.DataFrame({"conv_id": group["conv_id"], "piece": group["piece"], "start": [s for s, _ in trail], "audit": [a for _, a in trail]})
        for name, value in zip(COUNTS, (*total.counts(), cost), strict=True):
            out[name] = value
        return out

    sums = open_pieces.select("conv_id", "piece", *[n for n, _ in SUMMARY], "paths")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    trails = sums.groupBy("conv_id").applyInPandas(fold, f"conv_id string, piece long, start int, audit string, {counts}")
    texts = open_pieces.select("conv_id", "piece", "roles", "texts")
    # a piece's number is its own, the conversation may be null
    full = trails.join(texts.drop("conv_id"), "piece")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

        def results() -> Iterator[tuple]:
            for conv, own in groupby(rows, lambda r: r[0]):
                audits: list[str] = []
                values: tuple = ()

                def lines(own=own, audits=audits) -> Iterator[tuple[str, str]]:
                    nonlocal values
                    for _, _, start, audit, roles, texts, *values in own:  # noqa: B007
                        audits.append(audit)
                        yield from repaired(list(zip(roles, texts, strict=True)), audit, start)

                digest = digest_of(lines())
                yield (conv, *values, "".join(audits), digest)

        yield from batched(results(), pa.schema([("conv_id", pa.string()), *RESULT_FIELDS]))

    placed = full.select("conv_id", "piece", "start", "audit", "roles", "texts", *COUNTS).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return placed.mapInArrow(stream, "conv_id string, " + RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the crc32 of ``conv_id:turn``, modulo 20; those that are dropped stay, with ``dropped`` true."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20).alias("what")
    out = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), what)
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") == 0).alias("dropped"), copies.alias("copy"))


def op13_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged as the contract says, and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), dropped_col="dropped")


QUERIES = {"op13_lattice_repair": op13_lattice_repair}
ORACLES = {
    "op13_lattice_repair": """
    WITH RECURSIVE src AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    -- crc32 of the name, bit by bit: each character is followed by seven zeros
    bits AS (SELECT *, list_prepend(4294967295, flatten(list_transform(range(1, length(name) + 1), lambda i: [CAST(ascii(substr(name, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS b FROM src),
    hashed AS (SELECT *, xor(4294967295, list_reduce(b, lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS what FROM bits),
    damaged AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
                       CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END))
                FROM hashed WHERE what <> 0),
    placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
    rows_ AS (SELECT *, CASE WHEN ends = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                             WHEN right(ends, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
                     lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                      count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
               FROM rows_ GROUP BY conv_id),
    -- states: 0 nothing yet, 1 after s, 2 after u, 3 after a
    nexts(f, letter, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    inserts(f, edits, cost, t) AS (VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 3, 2), (0, 'II', 6, 3), (1, 'I', 3, 2), (1, 'II', 6, 3), (2, 'I', 3, 3), (3, 'I', 3, 2)),
    acts AS (SELECT f, ini, fault, 'D' AS edit, 4 AS cost, f AS t FROM (SELECT DISTINCT f FROM inserts), (SELECT DISTINCT ini, fault FROM rows_)
             UNION ALL
             SELECT f, ini, fault, CASE WHEN letter = ini THEN 'K' ELSE 'R' END, CASE WHEN letter = ini THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END, t
             FROM nexts, (SELECT DISTINCT ini, fault FROM rows_) WHERE fault IN ('-', 't') AND (letter = ini OR letter <> 's')),
    steps AS (SELECT i.f, a.ini, a.fault, i.edits || a.edit AS edits, i.cost + a.cost AS cost, a.t FROM inserts i JOIN acts a ON a.f = i.t),
    -- the key sorts by cost, then by audit
    paths AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, '000000000' AS path FROM counts
              UNION ALL
              SELECT r.conv_id, r.i, s.t, min(lpad(CAST(CAST(left(p.path, 9) AS INTEGER) + s.cost AS VARCHAR), 9, '0') || substr(p.path, 10) || s.edits)
              FROM paths p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN steps s ON s.f = p.state AND s.ini = r.ini AND s.fault = r.fault
              GROUP BY r.conv_id, r.i, s.t),
    best AS (SELECT c.conv_id, min(lpad(CAST(CAST(left(p.path, 9) AS INTEGER) + e.cost AS VARCHAR), 9, '0') || substr(p.path, 10) || e.edits) AS path
             FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN inserts e ON e.f = p.state AND e.t IN (0, 3) GROUP BY c.conv_id),
    letters AS (SELECT conv_id, unnest(string_split(substr(path, 10), '')) AS edit, unnest(range(length(path) - 9)) AS place FROM best WHERE length(path) > 9),
    told AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS e FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
    filled AS (SELECT t.*, r.role, r.text, r.ini, max(CASE WHEN edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS s
               FROM told t LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i AND t.edit <> 'I' WHERE edit <> 'D'),
    lines AS (SELECT conv_id, place, CASE WHEN edit = 'K' THEN role WHEN (e - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM filled),
    repaired AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS sha FROM lines GROUP BY conv_id)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(left(path, 9), '0') AS BIGINT) AS cost, coalesce(substr(path, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """
}
