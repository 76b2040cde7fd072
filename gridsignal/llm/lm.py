"""Language-model scores from a weighted backoff automaton over words.

The model: trigrams, smoothed towards bigrams and these towards words (MacKay and Peto's hierarchical Dirichlet prior):
p(w | uv) = (c(uvw) + k3 p(w | v)) / (c(uv) + k3), p(w | v) = (c(vw) + k2 p(w)) / (c(v) + k2). As an automaton: states are the
root, the words and the pairs of words; a state has an arc for each word that followed it in training, weighted with the
smoothed probability, to the state of the last two words; its failure arc, weighted with the mass kept for other words,
leads to the state that is one word shorter. A text is read once from left to right: the state is carried along, where
it lacks an arc failure arcs are followed, and the logarithms of all arcs taken add up. No count is cut off.

The automaton is as large as the corpus allows and is never in one place. Texts are dealt to parts of bounded size, and
a part asks (see ``parts``) about just the words, pairs and triples of its texts; shards add the counts of all parts up
and answer with the totals. So every count comes from all training texts, and a task holds one part's texts and the part
of the automaton that they can reach.

Words travel as 64-bit numbers, pairs and triples as their shard and 44 bits (fewer beyond a million shards). A shard has
about a million keys, whatever the size of the corpus, so the chance that a pair or triple shares its number, and then
its count, with another one of its shard is 6e-8.

Defined results: null and empty texts are the end token alone; repeated rows all count and are all scored; without
training rows every probability comes from the smoothing alone; an empty table gives no rows; extra columns are ignored;
very long texts are read in pieces at a time, a piece's state being settled by the two words in front of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.labelled import chunks, fold
from gridsignal.llm.parts import MESSAGE, PART_BYTES, by_shard, in_parts, of_kind, part_count, runs, shard_of, squeeze, squeeze_sorted, table, unsqueeze, unsqueeze_sorted
from gridsignal.llm.text import BASE, Words, mixed

FOLDS, HELD = 10, 0
ADD, PRIOR_2, PRIOR_3 = 0.1, 300.0, 3.0
UNIGRAM, PAIR, TRIPLE = 0, 1, 2
#: Bits of a pair's or triple's key inside its shard.
GRAM_BITS = 44
#: Tokens of a text that are read in one go.
PIECE = 256
#: The numbers of the end token, and of the context that opens a text.
END, OPEN = np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7)


class Tokens:
    """Tokens of texts in order: ``token``, ``pair`` (with the one before), ``triple`` (with the two before, a text's first
    token aside), ``row``, ``first`` (one more than rows), ``opens`` (whether a text begins)."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        words = Words(texts, lower=True)
        rows = len(texts)
        self.token = np.insert(words.number, words.first[1:], END)
        before = np.insert(words.number, words.first[:-1], OPEN)
        self.first = words.first + np.arange(rows + 1)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        self.opens = np.zeros(len(self.token), bool)
        self.opens[self.first[:-1]] = True
        with np.errstate(over="ignore"):
            self.pair = mixed(before * BASE + self.token)
            self.triple = mixed(np.roll(self.pair, 1) * BASE + self.token)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, len(self.first) - 1)


def corpus_totals(docs: DataFrame, n_shards: int) -> tuple[int, int]:
    """Number of training tokens, and of different ones. ``docs``: text and held."""
    schema = pa.schema([("shard", pa.int32()), ("tokens", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pc.invert(batch.column("held")))
            for lo, hi in chunks(texts, PART_BYTES):
                keys, n = np.unique(Tokens(texts.slice(lo, hi - lo)).token, return_counts=True)
                rows = [(s, int(n[a:b].sum()), b - a, squeeze_sorted(keys[a:b])) for s, a, b in runs(shard_of(keys, n_shards))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def add(asked: pa.Table) -> pa.Table:
        keys = np.concatenate([unsqueeze_sorted(m["words"], m["n"], np.uint64) for m in asked.select(["n", "words"]).to_pylist()])
        return pa.table({"tokens": [pc.sum(asked.column("tokens")).as_py()], "kinds": [len(np.unique(keys))]})

    sent = docs.mapInArrow(count, "shard int, tokens long, n int, words binary")
    got = by_shard(sent, n_shards).applyInArrow(add, "tokens long, kinds long").agg(F.sum("tokens"), F.sum("kinds")).first()
    return int(got[0] or 0), int(got[1] or 0)


class Grams:
    """The different ones of some tokens' n-grams: ``number`` (sorted, by shard first), ``at`` (where each stands first),
    ``of`` (each token's). ``bits`` are kept of the key inside a shard, all without it."""

    def __init__(self, keys: np.ndarray, n_shards: int, bits: int | None = None):
        self.n_shards, self.bits = n_shards, None if bits is None else np.uint64(min(bits, 64 - (n_shards - 1).bit_length()))
        number = keys if bits is None else (shard_of(keys, n_shards) << self.bits) | (keys & self._local())
        self.number, self.at, self.of = np.unique(number, return_index=True, return_inverse=True)

    def _local(self) -> np.uint64:
        return (np.uint64(1) << self.bits) - np.uint64(1)

    def questions(self, part: int, kind: int, train: np.ndarray) -> list[tuple]:
        """``train``: whether each token's n-gram counts, or how often."""
        count = np.bincount(self.of, train, len(self.number)).astype(np.int64)
        shard, sent = (shard_of(self.number, self.n_shards), self.number) if self.bits is None else (self.number >> self.bits, self.number & self._local())
        return [(s, part, kind, b - a, squeeze_sorted(sent[a:b]), squeeze(count[a:b]), None) for s, a, b in runs(shard)]


def part_grams(tokens: Tokens, n_shards: int) -> tuple[Grams, Grams, Grams]:
    """Of words (OPEN is the last entry), pairs, and triples (of all tokens but those that open a text)."""
    return Grams(np.append(tokens.token, OPEN), n_shards), Grams(tokens.pair, n_shards, GRAM_BITS), Grams(tokens.triple[~tokens.opens], n_shards, GRAM_BITS)


def count_grams(questions: pa.Table) -> list[tuple]:
    """A shard's work: the counts of its keys over all parts, for each part that asked."""
    out = []
    for kind in (UNIGRAM, PAIR, TRIPLE):
        asked = of_kind(questions, kind)
        if asked:
            _, of = np.unique(np.concatenate([unsqueeze_sorted(m["a"], m["n"], np.uint64) for m in asked]), return_inverse=True)
            total = np.bincount(of, np.concatenate([unsqueeze(m["b"], m["n"], np.int64) for m in asked])).astype(np.int64)
            at = 0
            for m in asked:
                out.append((m["shard"], m["part"], kind, m["n"], squeeze(total[of[at : at + m["n"]]]), None, None))
                at += m["n"]
    return out


def counts_of(answers: pa.Table, kind: int) -> np.ndarray:
    got = [unsqueeze(m["a"], m["n"], np.int64) for m in of_kind(answers, kind)]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


class BackoffAutomaton:
    """The states and arcs that some texts can reach.

    State 0 is the root, then come the words, then the pairs. An arc's ``number`` is its state times the number of words
    plus its word; arcs are sorted by it, with ``weight`` (log10) and ``target``. ``fail`` and ``fail_weight`` are the states'.
    ``grams`` and ``counts``: of the texts' words, pairs and triples; ``n`` training tokens of ``v`` kinds.
    """

    def __init__(self, tokens: Tokens, grams: tuple[Grams, Grams, Grams], counts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, v: int):
        words, pairs, triples = grams
        count, count_2, count_3 = counts
        self.n_words, self.word, self.opening = len(words.number), words.of[:-1], 1 + words.of[-1]
        self.count = count
        self.root = (count + ADD) / (n + ADD * (v + 1))
        before = np.roll(self.word, 1)
        before[tokens.opens] = words.of[-1]
        last = self.word[pairs.at]
        p_2 = (count_2 + PRIOR_2 * self.root[last]) / (count[before[pairs.at]] + PRIOR_2)
        place = np.flatnonzero(~tokens.opens)[triples.at]
        context = pairs.of[place - 1]
        p_3 = (count_3 + PRIOR_3 * p_2[pairs.of[place]]) / (count_2[context] + PRIOR_3)
        first_pair = 1 + self.n_words
        seen_2, seen_3 = np.flatnonzero(count_2), np.flatnonzero(count_3)
        number = np.concatenate([np.arange(self.n_words), ((1 + before[pairs.at]) * self.n_words + last)[seen_2], ((first_pair + context) * self.n_words + self.word[place])[seen_3]])
        target = np.concatenate([1 + np.arange(self.n_words), first_pair + seen_2, (first_pair + pairs.of[place])[seen_3]])
        weight = np.log10(np.concatenate([self.root, p_2[seen_2], p_3[seen_3]]))
        order = np.argsort(number)
        self.number, self.target, self.weight = number[order], target[order], weight[order]
        self.fail = np.concatenate([np.zeros(first_pair, np.int64), 1 + last])
        self.fail_weight = np.concatenate([[0.0], np.log10(PRIOR_2 / (count + PRIOR_2)), np.log10(PRIOR_3 / (count_2 + PRIOR_3))])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Read one word from each state: the logarithms of the arcs taken; ``state`` becomes where they lead."""
        out = np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            now = state[todo]
            number = now * self.n_words + word[todo]
            arc = np.minimum(np.searchsorted(self.number, number), len(self.number) - 1)
            hit = self.number[arc] == number
            out[todo[hit]] += self.weight[arc[hit]]
            state[todo[hit]] = self.target[arc[hit]]
            todo, now = todo[~hit], now[~hit]
            out[todo] += self.fail_weight[now]
            state[todo] = self.fail[now]
        return out

    def read(self, tokens: Tokens) -> np.ndarray:
        """log10 of each token's probability, in one traversal of all texts, whose pieces advance side by side."""
        size = np.diff(tokens.first)
        pieces = -(-size // PIECE)
        row = np.repeat(np.arange(len(size)), pieces)
        within = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = tokens.first[row] + within * PIECE
        # the two tokens in front of a piece settle its state
        at = np.maximum(begin - 2, tokens.first[row])
        steps = np.minimum(begin + PIECE, tokens.first[row + 1]) - at
        order = np.argsort(-steps, kind="stable")
        begin, at, steps = begin[order], at[order], steps[order]
        state = np.where(within[order] == 0, self.opening, 0)
        out = np.zeros(len(tokens.token))
        for t in range(int(steps.max(initial=0))):
            live = int(np.searchsorted(-steps, -t))
            place = at[:live] + t
            got = self.step(state[:live], self.word[place])
            own = place >= begin[:live]
            out[place[own]] = got[own]
        return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """One row (columns of SCORES) for each row of ``docs`` (doc_id, text); rows of the held fold don't train."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold(F.col("doc_id"), folds) == held).alias("held"))
    n_parts = part_count(docs)
    n, v = corpus_totals(docs.select("text", "held"), n_parts)
    parted = in_parts(docs, n_parts, "doc_id", "text")

    def questions(data: pa.Table) -> pa.Table:
        part = int(data.column("part")[0].as_py())
        tokens = Tokens(data.column("text"))
        words, pairs, triples = part_grams(tokens, n_parts)
        trains = ~data.column("held").to_numpy()
        train = trains[tokens.row]
        out = words.questions(part, UNIGRAM, np.append(train.astype(float), trains.sum()))
        return table(out + pairs.questions(part, PAIR, train) + triples.questions(part, TRIPLE, train[~tokens.opens]))

    def finish(data: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(data.column("text"))
        counts = tuple(counts_of(answers, kind) for kind in (UNIGRAM, PAIR, TRIPLE))
        automaton = BackoffAutomaton(tokens, part_grams(tokens, n_parts), counts, n, v)
        rows = data.num_rows
        return pa.table(
            {
                "doc_id": data.column("doc_id"),
                "held_out": data.column("held"),
                "n_tokens": pa.array(np.diff(tokens.first), pa.int64()),
                "n_known": pa.array(tokens.sums(automaton.count[automaton.word] > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, n), pa.int64()),
                "base_score": pa.array(tokens.sums(np.log10(automaton.root[automaton.word]))),
                "score": pa.array(tokens.sums(automaton.read(tokens))),
            }
        )

    by_part = parted.groupBy("part")
    answers = by_shard(by_part.applyInArrow(questions, MESSAGE), n_parts).applyInArrow(lambda q: table(count_grams(q)), MESSAGE)
    return by_part.cogroup(answers.groupBy("part")).applyInArrow(finish, SCORES)


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a trigram backoff automaton trained on nine tenths of them."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_backoff_automaton": op2_backoff_automaton}
