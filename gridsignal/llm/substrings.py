"""Removal of repeated passages: windows of words, a count-min prefilter and exact groups.

A window is ``window`` consecutive words of one document. Every word covered by a window whose words also start
somewhere else, in the same document or another, is removed; windows are judged on the input.

First all windows go through the sketch (see ``parts``): estimates are never too low, so no repeated window is lost. Then
only windows estimated repeated are grouped exactly, by two independent 64-bit numbers of their words. Texts move once,
to their part; keys of windows move as compressed numbers.

Defined results: a null text has no words; a text shorter than a window keeps all its words; every row is a document of
its own, so rows repeated in full remove each other's windows; an empty table gives no rows; extra columns are carried
along (names part, n_words, n_removed and kept_text are replaced).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridsignal.llm.parts import MESSAGE, Sketch, by_shard, in_parts, joined_bits, merge_sketches, of_kind, part_count, runs, shard_of, squeeze, squeeze_bits, squeeze_sorted, table, unsqueeze, unsqueeze_bits, unsqueeze_sorted
from gridsignal.llm.text import Words, mixed, ngrams, same_row

WINDOW = 35
#: Bytes of text in a part: a window has two numbers and two places in the sketch, so parts are smaller than elsewhere.
WINDOW_PART_BYTES = 6 << 20
SKETCH, EXACT, MASK = 0, 4, 5
SECOND = np.uint64(0xD6E8FEB86659FD93)


def windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows, and the windows' numbers."""
    at = np.flatnonzero(same_row(words, window))
    return at, ngrams(words.number, window)[at]


def second_numbers(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    return ngrams(mixed(words.number ^ SECOND), window)[at]


class Distinct:
    """The different (first, second) numbers among some windows, sorted, and how each window maps to them."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.order = np.lexsort((second, first))
        a, b = first[self.order], second[self.order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.of = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.first, self.second = a[at], b[at]
        self.several = np.diff(np.append(at, len(a))) > 1

    def spread(self, bits: np.ndarray) -> np.ndarray:
        """From different keys back to windows."""
        out = np.zeros(len(self.order), bool)
        out[self.order] = bits[self.of] if len(bits) else False
        return out


def ask_exact(part: int, keys: Distinct, n_shards: int) -> list[tuple]:
    return [(shard, part, EXACT, hi - lo, squeeze_sorted(keys.first[lo:hi]), squeeze(keys.second[lo:hi]), squeeze_bits(keys.several[lo:hi])) for shard, lo, hi in runs(shard_of(keys.first, n_shards))]


def answer_exact(questions: pa.Table) -> list[tuple]:
    """A shard's work: which of the keys occur twice or more over all parts. Other messages pass through."""
    asked = of_kind(questions, EXACT)
    out = [tuple(m.values()) for m in of_kind(questions, MASK)]
    if asked:
        first = np.concatenate([unsqueeze_sorted(m["a"], m["n"], np.uint64) for m in asked])
        second = np.concatenate([unsqueeze(m["b"], m["n"], np.uint64) for m in asked])
        weight = np.concatenate([unsqueeze_bits(m["c"], m["n"]) for m in asked]).astype(np.int64) + 1
        keys = Distinct(first, second)
        total = np.bincount(keys.of, weight[keys.order])
        bits = keys.spread(total >= 2)
        at = 0
        for m in asked:
            out.append((m["shard"], m["part"], EXACT, m["n"], squeeze_bits(bits[at : at + m["n"]]), None, None))
            at += m["n"]
    return out


def covered(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window that begins at one of ``starts``."""
    edge = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, text_col: str = "text", key: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``, with n_words, n_removed and kept_text (kept words joined by one space).

    ``key``: columns whose hash deals rows to parts; any choice gives the same result.
    """
    docs = docs.drop("part", "n_words", "n_removed", "kept_text")
    n = part_count(docs, text_col, WINDOW_PART_BYTES)
    parted = in_parts(docs, n, *key, text_col)

    def part_of(data: pa.Table) -> int:
        return int(data.column("part")[0].as_py())

    def ordered(data: pa.Table) -> pa.Table:
        # a shuffle brings a part's rows in any order, each time another; masks need one order
        return data.sort_by([(c, "ascending") for c in (*key, text_col)])

    def sketch(data: pa.Table) -> pa.Table:
        words = Words(data.column(text_col))
        return table(Sketch(windows(words, window)[1], n).questions(part_of(data), SKETCH))

    def candidates(data: pa.Table, answers: pa.Table) -> pa.Table:
        if not data.num_rows:
            return table([])
        words = Words(ordered(data).column(text_col))
        at, number = windows(words, window)
        maybe = Sketch(number, n).repeated(answers, SKETCH)
        keys = Distinct(number[maybe], second_numbers(words, at[maybe], window))
        part = part_of(data)
        return table([*ask_exact(part, keys, n), (part % n, part, MASK, len(maybe), squeeze_bits(maybe), None, None)])

    names = [f.name for f in parted.schema if f.name != "part"]
    schema = T.StructType([parted.schema[f] for f in names]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def finish(data: pa.Table, answers: pa.Table) -> pa.Table:
        data = ordered(data)
        words = Words(data.column(text_col))
        at, number = windows(words, window)
        maybe = joined_bits(answers, MASK)
        at, number = at[maybe], number[maybe]
        keys = Distinct(number, second_numbers(words, at, window))
        gone = covered(words, at[keys.spread(joined_bits(answers, EXACT))], window)
        removed = np.bincount(words.doc[gone], minlength=data.num_rows)
        kept = []
        for row in range(data.num_rows):
            own = words.row_words(row)
            if removed[row]:
                own = compress(own, (~gone[words.first[row] : words.first[row + 1]]).tolist())
            kept.append(b" ".join(own).decode())
        out = data.select(names)
        for name, values in (("n_words", pa.array(words.counts(), pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept_text", pa.array(kept, pa.string()))):
            out = out.append_column(name, values)
        return out

    by_part = parted.groupBy("part")
    sketches = by_part.applyInArrow(sketch, MESSAGE)
    estimates = by_shard(sketches, n).applyInArrow(lambda q: table(merge_sketches(q, SKETCH)), MESSAGE)
    asked = by_part.cogroup(estimates.groupBy("part")).applyInArrow(candidates, MESSAGE)
    answers = by_shard(asked, n).applyInArrow(lambda q: table(answer_exact(q)), MESSAGE)
    return by_part.cogroup(answers.groupBy("part")).applyInArrow(finish, schema)


def op1_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows removed from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = remove_repeats(docs)

    def digest(batches):
        for batch in batches:
            hashes = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("kept_text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), pa.array(hashes)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return kept.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op1_count_min_substrings": op1_count_min_substrings}
ORACLES = {
    "op1_count_min_substrings": r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
         p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
         k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS window_text FROM p),
         r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY window_text) > 1),
         c AS (SELECT DISTINCT doc_id, i + o AS j FROM r, range(35) t(o)),
         e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
         kept AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY e.j) AS t FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
    """
}
