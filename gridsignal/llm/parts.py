"""Questions about keys of all rows, asked part by part: a sketch first, exact counts second.

Rows are dealt to parts of bounded size by a hash. A part asks about 64-bit keys (windows, n-grams, signatures) that its
rows hold; the questions are sorted, compressed and dealt to shards by the keys' range, and a shard's answers go back
as bits to the parts that asked. A key's occurrences inside a part travel as one question, so a key that a third of
all rows hold brings a shard one question from each part. Parts and shards grow in number with the input, not in size.

The sketch is count-min with saturating counters: a part's own sketch is the sorted list of the counters its keys hit,
shards add the parts' sketches up, and a key counts as repeated if all its counters reached 2. Estimates are never too
low, so no repeated key is lost.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from gridsignal.llm.text import mixed

_C = ctypes.CDLL(None)

#: Bytes of text in a part, about.
PART_BYTES = 8 << 20
#: Rows of counters, and counters of a shard in each.
DEPTH, WIDTH = 2, 1 << 23
SEEDS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]

#: Messages between parts and shards.
MESSAGE = "shard int, part int, kind int, n int, a binary, b binary, c binary"
NAMES = ["shard", "part", "kind", "n", "a", "b", "c"]
SCHEMA = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def give_back() -> None:
    """Return memory that this worker has freed to the system; a worker lives on and takes tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:
        trim(0)


def part_count(docs: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Parts for a table: by its bytes of text, two for each core at least."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(32))).first()[0] or 0
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // part_bytes))


def in_parts(docs: DataFrame, n_parts: int, *key: str) -> DataFrame:
    """``docs`` with ``part``, dealt to as many partitions as parts."""
    return docs.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(n_parts)).cast("int")).repartition(n_parts, "part")


def by_shard(messages: DataFrame, n_shards: int) -> GroupedData:
    """Messages dealt to as many partitions as shards: tasks grow in number with the input, whatever the session's setting."""
    return messages.repartition(n_shards, "shard").groupBy("shard")


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)] if rows else [pa.array([], t.type) for t in SCHEMA], schema=SCHEMA)


def squeeze(x: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, one plane for each byte of a number."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True) if len(x) else b""


def unsqueeze(blob: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(blob, n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).reshape(n)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def unsqueeze_sorted(blob: bytes, n: int, kind: type) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, n, kind), dtype=kind)


def squeeze_bits(bits: np.ndarray) -> bytes:
    return squeeze(np.packbits(bits))


def unsqueeze_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unsqueeze(blob, -(-n // 8), np.uint8), count=n).astype(bool)


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards are ranges of keys, so sorted keys are sorted by shard too."""
    return ((keys >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)


def runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal numbers."""
    if len(shards):
        first = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        yield from zip(shards[first].astype(np.int64).tolist(), first.tolist(), [*first[1:].tolist(), len(shards)], strict=True)


class Sketch:
    """The sketch of a part's keys. The same keys in the same order give the same questions, so answers can be matched."""

    def __init__(self, keys: np.ndarray, n_shards: int, width: int = WIDTH, depth: int = DEPTH):
        self.n_shards, self.size = n_shards, len(keys)
        self.rows = []
        for seed in SEEDS[:depth]:
            at = mixed(keys ^ seed)
            place = (shard_of(at, n_shards) << np.uint64(32)) | (at & np.uint64(width - 1))
            order = np.argsort(place, kind="stable")
            self.rows.append((order, place[order]))

    def questions(self, part: int, kind: int, adds: np.ndarray | None = None) -> list[tuple]:
        """``adds``: whether a key's occurrence counts (all do by default); kind + row of counters names the question."""
        out = []
        for row, (order, place) in enumerate(self.rows):
            for shard, lo, hi in runs(place >> np.uint64(32)):
                own = b"" if adds is None else squeeze_bits(adds[order[lo:hi]])
                out.append((shard, part, kind + row, hi - lo, squeeze_sorted(place[lo:hi].astype(np.uint32)), own, None))
        return out

    def repeated(self, answers: pa.Table, kind: int) -> np.ndarray:
        """For each key, whether it is estimated to occur twice or more."""
        out = np.ones(self.size, bool)
        for row, (order, _) in enumerate(self.rows):
            out[order] &= joined_bits(answers, kind + row)
        return out


def of_kind(answers: pa.Table, kind: int) -> list[dict]:
    """The messages of a kind, by shard."""
    mask = answers.column("kind").to_numpy() == kind
    return sorted(answers.filter(pa.array(mask)).to_pylist(), key=lambda m: m["shard"])


def joined_bits(answers: pa.Table, kind: int) -> np.ndarray:
    got = [unsqueeze_bits(m["a"], m["n"]) for m in of_kind(answers, kind)]
    return np.concatenate(got) if got else np.zeros(0, bool)


def merge_sketches(questions: pa.Table, kind: int, width: int = WIDTH, depth: int = DEPTH) -> list[tuple]:
    """A shard's work: add the parts' sketches up and answer, for each counter asked about, whether it reached 2."""
    out = []
    for row in range(depth):
        asked = [m | {"at": unsqueeze_sorted(m["a"], m["n"], np.uint32)} for m in of_kind(questions, kind + row)]
        counters = np.zeros(width, np.uint8)
        for m in asked:
            at = m["at"]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            adds = unsqueeze_bits(m["b"], m["n"]).astype(np.int64) if m["b"] else np.ones(m["n"], np.int64)
            own = np.minimum(np.add.reduceat(adds, first), 2).astype(np.uint8)
            counters[at[first]] = np.minimum(counters[at[first]] + own, 2)
        out += [(m["shard"], m["part"], m["kind"], m["n"], squeeze_bits(counters[m["at"]] >= 2), None, None) for m in asked]
    return out
