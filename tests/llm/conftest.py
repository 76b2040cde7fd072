"""Small tables with the cases that operators have to define."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, score double, size string, id int, shard int, row_key string, held int, epoch int"
EXTRA = (1, 2.0, "x", 3, 4, "k", 5, 6)


def rows(texts, sources=None):
    """Rows of SCHEMA; the columns after n_chars are extra and clash with names that operators use."""
    out = []
    for i, t in enumerate(texts):
        source = sources[i] if sources else f"s{i % 3}"
        out.append((i, t, "en", source, None if t is None else len(t), *EXTRA))
    return out


def words(seed, n, kinds=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.7)) % kinds}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts: plain ones, exact and near copies, shared passages, null, empty, blank, short, odd spacing, long."""
    base = [words(s, 60 + 7 * s) for s in range(24)]
    passage = words(999, 60)
    near = base[3].split()
    near[10] = "changed"
    far = base[3].split()
    far[10::9] = ["x"] * len(far[10::9])
    return [
        *base,
        base[0],
        base[0],
        base[1].upper(),
        " ".join(near),
        " ".join(far),
        base[4] + " " + passage,
        passage + "\n" + base[5],
        None,
        "",
        " \t\n ",
        "one",
        "one",
        "two words",
        "  odd   spacing\x0b\x0chere  \n\n ends ",
        "a b " * 40,
        words(5000, 20_000),
        None,
    ]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    table = rows(corpus)
    table.append((None, "no id here", None, None, None, *[None] * len(EXTRA)))
    table.append(table[2])
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
