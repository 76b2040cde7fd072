import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridsignal.llm import packing

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a  b", "a \n b\n\nc", "été don't   x", "x<|endoftext|>y 12 3.5", "\t tab\r\n", "A" * 300 + " " * 50, "日本語 \U0001f600!?"])
def test_ids_are_those_of_the_tokenizer(plain, text):
    assert np.frombuffer(packing.encoder(PATH).encode(text), "<u4").tolist() == plain(text)


def test_every_id_lies_in_one_piece(spark, docs, corpus, plain):
    got = packing.pack_documents(docs, PATH).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in own)
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert total == 1024 or total & (total - 1) == 0
    for i, text in enumerate(corpus):
        ids = np.array([*plain(text or ""), 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        copies = 2 if i == 2 else 1
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert packing.pack_documents(docs.limit(0), PATH).isEmpty()


def test_examples_stay_whole_and_within_limits(spark):
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(1, 700)), int(r.integers(1, 5)), int(r.integers(0, 300))) for i in range(300)] + [(300, 5000, 1, 1), (301, None, None, None), (7, 10, 1, 1)]
    limits = packing.Limits(1024, 8, 400)
    got = packing.pack_examples(spark.createDataFrame(rows, "i long, t long, s long, l long"), "i", "t", "s", "l", limits).collect()
    assert sorted(g["i"] for g in got) == sorted(x[0] for x in rows)
    size = {x[0]: np.array([x[1] or 0, x[2] or 0, x[3] or 0]) for x in rows if x[0] != 7}
    sums = defaultdict(lambda: np.zeros(3))
    for g in got:
        if g["i"] not in (7, 300):
            sums[g["sequence_id"]] += size[g["i"]]
    assert all((s <= [1024, 8, 400]).all() for s in sums.values())
    assert len(sums) < 2.2 * max(sum(size[i][k] for i in size if i != 300) / c for k, c in enumerate((1024, 8, 400)))
