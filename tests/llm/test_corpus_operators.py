import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridsignal.llm import jaccard, lm, substrings
from gridsignal.llm.parts import unsqueeze_sorted
from tests.llm.conftest import EXTRA, SCHEMA, words

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def plain_removal(table, window):
    split = [(i, (t or "").encode().split()) for i, t in table]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_op1_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in substrings.op1_count_min_substrings(spark, str(tmp_path)).collect()]
    expected = plain_removal(rows_of(docs), 35)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r[2] for r in expected) > 500


def test_removal_keeps_columns_and_empty_tables(docs, no_docs):
    out = substrings.remove_repeats(docs, window=5)
    assert out.columns == [c for c in docs.columns if c != "part"] + ["n_words", "n_removed", "kept_text"]
    assert out.count() == docs.count()
    assert substrings.remove_repeats(no_docs).isEmpty()


def plain_scores(table):
    """All words, pairs and triples counted, none left out; p(w | uv) rests on p(w | v), and this on p(w)."""
    docs, c = [], [Counter() for _ in range(3)]
    for i, t in table:
        w = [*(t or "").encode().translate(LOWER).split(), b"\0end"]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        docs.append((i, w, held))
        if not held:
            c[0].update([*w, b"\0open"])
            c[1].update(zip([b"\0open", *w[:-1]], w, strict=True))
            c[2].update(zip([b"\0open", *w[:-2]][: len(w) - 1], w[:-1], w[1:], strict=True))
    n, v = sum(c[0].values()) - c[0][b"\0open"], len(c[0].keys() - {b"\0open"})
    out = []
    for i, w, held in docs:
        base = score = 0.0
        for k, y in enumerate(w):
            p = (c[0][y] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            x = w[k - 1] if k else b"\0open"
            p = (c[1][x, y] + 300 * p) / (c[0][x] + 300)
            if k:
                u = w[k - 2] if k > 1 else b"\0open"
                p = (c[2][u, x, y] + 3 * p) / (c[1][u, x] + 3)
            score += math.log10(p)
        out.append((i, held, len(w), sum(c[0][y] > 0 for y in w), n, base, score))
    return out


def test_op2_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in lm.op2_backoff_automaton(spark, str(tmp_path)).collect()), key=str)
    expected = sorted(plain_scores(rows_of(docs)), key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5:] == pytest.approx(e[5:], rel=1e-9)


def test_scores_of_empty_and_all_held_tables(spark, docs, no_docs):
    assert lm.score_documents(no_docs).isEmpty()
    held = docs.filter(F.col("doc_id").isin([i for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0]))
    got = lm.score_documents(held).collect()
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def plain_components(table, n, p, q):
    sets = []
    for _, t in table:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and q * both >= p * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(table):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(table)]


def family(seed, n_copies, edits, length=120):
    """A text and edited copies of it, each edited from the first or from the copy before."""
    import random

    r = random.Random(seed)
    base = words(seed, length, 5000).split()
    out, last = [" ".join(base)], base
    for k in range(n_copies):
        own = list(base if k % 2 else last)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
        last = own
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("n", "p", "q"), [(4, 85, 100), (5, 4, 5)])
def test_components_against_brute_force(spark, docs, n, p, q):
    texts = [t for s in range(6) for t in family(s, 25, 2 + 2 * s)] + [f"tiny {i % 4} text {i % 3}" for i in range(24)]
    more = spark.createDataFrame([(1000 + i, t, None, None, None, *EXTRA) for i, t in enumerate(texts)], SCHEMA)
    table = docs.union(more)
    got = sorted((tuple(r) for r in jaccard.similarity_components(table, n=n, p=p, q=q).collect()), key=str)
    expected = sorted(plain_components(rows_of(table), n, p, q), key=str)
    assert got == expected
    assert len({e[2] for e in expected}) < len(expected) - 40


def test_components_of_many_groups_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    texts = [t for s in range(4) for t in family(s, 25, 4 + 4 * s)]
    table = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(map(tuple, jaccard.similarity_components(table).collect()), key=str)
    assert got == sorted(plain_components(rows_of(table), 4, 85, 100), key=str)


def test_bands_cover_all_pairs():
    first, k, parts = jaccard.bands(85, 100, 5000)
    assert all(a < b for a, b in zip(first[:-1], first[1:], strict=True)) and (parts > k).all()
    for size in (1, 2, 7, 50, 333, 4999):
        for other in range(size, size * 100 // 85 + 1):
            a, b = (int((first <= x).sum()) - 1 for x in (size, other))
            assert b - a in (0, 1)
            assert 15 * (size + other) // 185 <= k[b]


def test_components_of_an_empty_table(no_docs):
    assert jaccard.similarity_components(no_docs).isEmpty()


def test_shingles_that_agree_in_48_bits():
    sets = jaccard.ShingleSets(pa.chunked_array([["one two three four five six"]]), 4)
    assert len(sets.number) == 3
    sets.number[:] = [1 << 20, (1 << 20) + 5, 1 << 40]
    got = unsqueeze_sorted(sets.blob(0), 3, np.uint64)
    assert got.tolist() == [16, 17, 1 << 24] and jaccard.linked(got, got, 1, 1)


def test_failure_arcs_are_followed_and_state_is_carried():
    texts = pa.chunked_array([["a b c a b d", "a b c", "x b c y y b d"]])
    tokens = lm.Tokens(texts)
    grams = lm.part_grams(tokens, 4)
    train = tokens.row == 0
    counts = (np.bincount(grams[0].of, [*train, 1]), np.bincount(grams[1].of, train), np.bincount(grams[2].of, train[~tokens.opens]))
    counts = tuple(c.astype(np.int64) for c in counts)
    automaton = lm.BackoffAutomaton(tokens, grams, counts, 7, 5)
    pair = lambda k: 1 + automaton.n_words + grams[1].of[k]
    state = np.array([pair(1), pair(1), automaton.opening])
    word = automaton.word[[2, 11, 11]]
    got = automaton.step(state, word)
    # "a b" has an arc for "c"; "x" was never seen, so every failure arc is followed down to the root
    assert state.tolist() == [pair(2), 1 + automaton.word[11], 1 + automaton.word[11]]
    assert got[1] == pytest.approx(math.log10(3 / (2 + 3)) + math.log10(300 / (2 + 300)) + math.log10(automaton.root[automaton.word[11]]))
    before = lm.PIECE
    whole = automaton.read(tokens)
    try:
        lm.PIECE = 3
        assert automaton.read(tokens).tolist() == whole.tolist()
    finally:
        lm.PIECE = before
