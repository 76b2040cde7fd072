"""Rows of conversations in order, streamed through tasks of bounded memory.

Rows are dealt by ranges of (conversation, turn, ...), so a conversation of any length is spread over as many tasks as it
needs, and most conversations lie inside one. A task cuts its rows into pieces of bounded size, each of one conversation.
A piece is *whole* if it is certain to be all of its conversation: neither the first nor the last conversation of the task
(which may go on in another one) and not cut. What can be done for whole pieces is done where they are; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows and characters of a piece, about.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20


def in_order(rows: DataFrame, keys: list[str], more: list[str] | None = None) -> DataFrame:
    """Rows dealt by ranges of ``keys`` and sorted by them, then by ``more``; nulls first."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys, *(more or []))


def pieces(batches: Iterator[pa.RecordBatch], text_at: int, bound: Callable[[tuple], bool] = lambda row: False) -> Iterator[tuple[int, list[tuple], bool]]:
    """(number, rows, whole) of a task's pieces; the first column tells conversations apart, ``text_at`` is the text's place.

    Numbers ascend in the order of all rows, over tasks too. No cut is made after a row that is ``bound`` to the next one.
    """
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    of, begun, run, cut, size = None, False, 0, False, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and row[0] != of:
                if held:
                    yield number, held, run > 0 and not cut
                    number += 1
                held, run, cut, size = [], run + 1, False, 0
            of, begun = row[0], True
            held.append(row)
            size += len(row[text_at] or "")
            if (len(held) >= PIECE_ROWS or size >= PIECE_CHARS) and not bound(row):
                yield number, held, False
                number, held, cut, size = number + 1, [], True, 0
    if held:
        yield number, held, False


def batched(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 256, text_at: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") if text_at is not None else 0
        if len(held) >= at_once or size >= 8 * PIECE_CHARS:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
