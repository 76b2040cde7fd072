"""Packing into sequences by vector bin packing with the dot-product heuristic.

An item is a vector (tokens, segments, loss-bearing tokens); a sequence has a limit in each dimension. A sequence is
filled with the item, among those that fit, whose dot product with the room left is largest, each dimension divided by
its limit. Instruction examples stay whole. Documents may be cut: their full runs of ``tokens`` ids are sequences of
their own, the remainders are packed, and when nothing fits an item is cut to fill the room. What can't be filled at
the end is cut at powers of two, so no sequence of documents has padding.

Every task packs what its input partition holds, in groups of a bounded number of items: no shuffle, no group that
grows with the data. Sequence numbers start at the partition's number times 2**40.

Defined results: a null text counts as an empty one, which is the closing id alone; repeated rows are packed each; an
empty table gives no rows; examples larger than a limit are packed alone in a sequence and keep their real sizes; null
sizes count as 0; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 1024
#: Remainders that are packed at once.
GROUP = 1024
CACHE = 200_000
END_ID = 0


@dataclass(frozen=True)
class Limits:
    tokens: int = SEQUENCE_TOKENS
    segments: int = 256
    loss: int = SEQUENCE_TOKENS

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


def best_fit(sizes: np.ndarray, alive: np.ndarray, room: np.ndarray, limits: np.ndarray) -> int:
    """The fitting item with the largest dot product with the room, -1 if none fits; the first of equals."""
    fits = alive & (sizes <= room).all(1)
    if not fits.any():
        return -1
    score = (sizes / limits) @ (room / limits)
    score[~fits] = -1.0
    return int(score.argmax())


def pack_vectors(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """Sequence number of each item (rows tokens, segments, loss), items whole."""
    cap = limits.vector()
    out = np.full(len(sizes), -1, np.int64)
    alive = np.ones(len(sizes), bool)
    number = 0
    for big in np.flatnonzero((sizes > cap).any(1)):
        out[big], alive[big] = number, False
        number += 1
    while alive.any():
        room = cap.copy()
        while (k := best_fit(sizes, alive, room, cap)) >= 0:
            out[k], alive[k] = number, False
            room -= sizes[k]
        number += 1
    return out


class DocumentPacker:
    """Packs pieces of documents; ``take`` adds a document's ids, ``flush`` packs what waits.

    Rows come out as (doc, start, length, crc32, doc_tokens, sequence, offset); ``rows`` empties the list.
    """

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.waiting: list[tuple] = []
        self.out: list[tuple] = []

    def take(self, doc: object, ids: bytes) -> None:
        total, step = len(ids) // 4, self.limits.tokens
        for at in range(0, total - total % step, step):
            self._emit([(doc, at, ids[4 * at : 4 * (at + step)], total)])
        if total % step:
            at = total - total % step
            self.waiting.append((doc, at, ids[4 * at :], total))
        if len(self.waiting) >= GROUP:
            self.flush(last=False)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, at, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, at, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def flush(self, last: bool) -> None:
        cap = self.limits.vector()
        items, self.waiting = self.waiting, []
        n = np.array([len(p[2]) // 4 for p in items], float)
        sizes = np.stack([n, np.ones(len(n)), n], 1) if len(n) else np.zeros((0, 3))
        alive = np.ones(len(items), bool)
        while alive.any():
            room, chosen = cap.copy(), []
            while (k := best_fit(sizes, alive, room, cap)) >= 0:
                chosen.append(items[k])
                room -= sizes[k]
                alive[k] = False
            left = int(min(room[0], room[2]))
            if left and room[1] >= 1 and alive.any():
                # every item left is longer than the room: cut one
                k = int(np.flatnonzero(alive)[0])
                doc, at, ids, total = items[k]
                chosen.append((doc, at, ids[: 4 * left], total))
                items[k] = (doc, at + left, ids[4 * left :], total)
                sizes[k, 0] -= left
                sizes[k, 2] -= left
                left = 0
            if left:
                if not alive.any() and not last:
                    self.waiting = chosen
                    return
                chosen, over = self._cut_at_power(chosen)
                items += over
                extra = np.array([[len(p[2]) // 4, 1, len(p[2]) // 4] for p in over], float).reshape(-1, 3)
                sizes, alive = np.concatenate([sizes, extra]), np.concatenate([alive, np.ones(len(over), bool)])
            self._emit(chosen)

    @staticmethod
    def _cut_at_power(pieces: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """The first 2**k ids, k as large as can be, and the pieces that are left over."""
        total = sum(len(p[2]) // 4 for p in pieces)
        room = 1 << (total.bit_length() - 1)
        kept, over = [], []
        for doc, at, ids, whole in pieces:
            n = min(room, len(ids) // 4)
            if n:
                kept.append((doc, at, ids[: 4 * n], whole))
            if 4 * n < len(ids):
                over.append((doc, at + n, ids[4 * n :], whole))
            room -= n
        return kept, over

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by the byte-level vocabulary in a tokenizer file.

    The merges of this vocabulary have their ids' order, so the file's ids serve as ranks. A space before a non-space
    always opens a new token: texts are split there and each word's ids are kept, which is several times faster than
    encoding whole texts; texts with other spacing are encoded whole. Strings of special tokens are ordinary text.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    _odd = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file["added_tokens"]}
        to_byte = byte_of()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self._coder = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._coder.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._odd.search(text):
            return self._whole(text)
        head, *words = text.split(" ")
        known = self._known
        if len(known) > CACHE:
            known.clear()
        parts = [self._whole(head)] if head else []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._whole(" " + word)
            parts.append(ids)
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a file, built once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """One row a piece (columns of PIECES). ``tokenizer``: the file's path on every worker."""
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        packer = DocumentPacker(limits, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.take(doc, code.encode(text.as_py() or "") + end)
            yield table(packer.rows())
        packer.flush(last=True)
        yield table(packer.rows())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, id_col: str, tokens: str, segments: str, loss: str, limits: Limits = Limits()) -> DataFrame:
    """``id_col`` and sequence_id of every example, packed whole under the three limits at once."""
    schema = examples.select(id_col).schema.add("sequence_id", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                sizes = np.stack([np.nan_to_num(part.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("_t", "_s", "_l")], 1)
                got = pack_vectors(sizes, limits) + number
                number = int(got.max()) + 1 if len(got) else number
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(got)], [id_col, "sequence_id"])

    return examples.select(id_col, F.col(tokens).alias("_t"), F.col(segments).alias("_s"), F.col(loss).alias("_l")).mapInArrow(run, schema)


def default_tokenizer() -> str:
    """The public vocabulary file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_vector_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or default_tokenizer())


QUERIES = {"op6_vector_packing": op6_vector_packing}
