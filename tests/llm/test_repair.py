import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridsignal.llm import repair, turns

SCHEMA = "conv_id long, turn long, role string, text string, piece long, done boolean, digest string, kind int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def all_repairs(rows, faults):
    """Every edit sequence with up to two inserts in a row whose roles fit the grammar, by exhaustion: (cost, audit, rows)."""
    out = []

    def go(at, cost, audit, kept):
        if at == len(rows):
            if GRAMMAR.fullmatch("".join(r[:1] for r, _ in kept)):
                out.append((cost, audit, kept))
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(at, cost + 3, audit + "I", [*kept, (role, "")])
        if at < len(rows):
            role, text = rows[at]
            go(at + 1, cost + 4, audit + "D", kept)
            if faults[at] not in "bd":
                more = 3 if faults[at] == "t" else 0
                go(at + 1, cost + more, audit + "K", [*kept, (role, text)])
                for to in ("user", "assistant"):
                    go(at + 1, cost + more + 3, audit + "R", [*kept, (to, text)])

    go(0, 0, "", [])
    return min(out)


def test_cheapest_against_all_repairs():
    r = random.Random(4)
    for _ in range(120):
        n = r.randrange(4)
        rows = [(r.choice(["system", "user", "assistant", " ", "tool"]), f"t{i}") for i in range(n)]
        faults = "".join(r.choice("bdt---") for _ in range(n))
        cost, audit, kept = all_repairs(rows, faults)
        assert repair.cheapest([x[:1] for x, _ in rows], faults) == (cost, audit)
        assert list(repair.repaired(rows, audit)) == kept


def test_pieces_put_together_are_the_whole():
    r = random.Random(9)
    for _ in range(60):
        n = r.randrange(1, 30)
        initials = [r.choice("suua a") for _ in range(n)]
        faults = "".join(r.choice("bdt----") for _ in range(n))
        cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(3))})
        spans = list(zip(cuts, cuts[1:], strict=False))
        cost, trail = repair.joined([repair.crossings(initials[a:b], faults[a:b]) for a, b in spans])
        assert (cost, "".join(a for _, a in trail)) == repair.cheapest(initials, faults)
        rows = [(i, str(k)) for k, i in enumerate(initials)]
        kept = [x for (a, b), (s, audit) in zip(spans, trail, strict=True) for x in repair.repaired(rows[a:b], audit, s)]
        assert kept == list(repair.repaired(rows, "".join(a for _, a in trail)))


def plain(rows):
    """The contract in plain Python, with a dynamic programme in place of the search."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        own += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = set()
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = "", set()
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults += "b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t"
            seen.add((role, text))
        grammar = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        closed = lambda b: min_of([*b.items(), *((t2, (c + 3 * k, a + "I" * k)) for s, (c, a) in b.items() for k, t2 in inserted(grammar, s))])  # noqa: B023, E731
        best = closed({0: (0, "")})
        for (_, role, _), f in zip(own, faults, strict=True):
            more = []
            for s, (c, a) in best.items():
                more.append((s, (c + 4, a + "D")))
                for letter, to in grammar[s].items() if f in "-t" else ():
                    more += [(to, (c + 3 * (f == "t"), a + "K"))] if letter == role[:1] else [(to, (c + 3 + 3 * (f == "t"), a + "R"))] if letter != "s" else []
            best = closed(min_of(more))
        cost, audit = min(best[s] for s in (0, 3) if s in best)
        known = [t for t, *_ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        fixed = "\n".join(f"{r}:{t}" for r, t in repair.repaired([x[1:] for x in own], audit))
        out.add((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(fixed.encode()).hexdigest()))
    return out


def inserted(grammar, state):
    one = [to for letter, to in grammar[state].items() if letter != "s"][0]
    return [(1, one), (2, [to for letter, to in grammar[one].items() if letter != "s"][0])]


def min_of(pairs):
    out = {}
    for s, v in pairs:
        out[s] = min(out.get(s, v), v)
    return out


@pytest.mark.parametrize("piece", [1024, 4])
def test_against_plain_python(spark, piece, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_ROWS", piece)
    r = random.Random(1)
    texts = ["Fine.", "Good!", "cut off", " ", "", "A longer one?", "what.\n", "no end \n", "é.", "Really?! "]
    rows = [(c, t, r.choice(["system"] + ["user", "assistant"] * 4), f"{r.choice(texts)}" if r.random() < 0.6 else f"{t} {r.random()}.", 1, True, "x", 2) for c in range(60) for t in range(c % 9)]
    rows += [(100, t, ("user", "assistant")[t % 2], r.choice(texts) if t % 3 else f"Turn {t}.", 1, True, "x", 2) for t in range(500)]
    rows += [(200, None, None, None, 1, True, "x", 2), (200, None, "user", "a.", 1, True, "x", 2), (200, 3, "", "b.", 1, True, "x", 2), (200, 9, "assistant", "c.", 1, True, "x", 2), (None, 4, "user", "lost.", 1, True, "x", 2), (None, None, "user", "lost.", 1, True, "x", 2)]
    rows += [(300, 1, "user", "Same.", 1, True, "x", 2)] * 40 + [(300, 2, "assistant", "long " * 300_000, 1, True, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = repair.repair(repair.damaged(df), dropped_col="dropped").collect()
    want = plain(rows)
    assert len(got) == len(want) == len({r[0] for r in rows})
    assert {tuple(x) for x in got} == want


def test_empty_table_and_other_costs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(none), dropped_col="dropped").isEmpty()
    one = spark.createDataFrame([(1, 0, "user", "Yes."), (1, 1, "user", "No.")], "conv_id int, turn int, role string, text string")
    assert [r["audit"] for r in repair.repair(one).collect()] == ["KR"]
    assert [r["audit"] for r in repair.repair(one, repair.Costs(rerole=9, insert=1)).collect()] == ["KIKI"]
    assert repair.repair(one).schema["conv_id"].dataType == one.schema["conv_id"].dataType
    all_gone = one.withColumn("dropped", F.lit(True))
    assert [tuple(r)[1:] for r in repair.repair(all_gone, dropped_col="dropped").collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
