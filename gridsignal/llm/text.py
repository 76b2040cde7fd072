"""Words and n-grams of whole batches of texts as 64-bit numbers, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Each byte value has a random odd 64-bit code; a word's
number is the mixed value of the polynomial of its bytes' codes, an n-gram's that of its words' numbers. Two different
words, or n-grams of different words, share a number with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240611)
BYTE_CODES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes hashed at once.
STEP = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for later calls."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a batch of texts, in order.

    ``number``: the words' numbers; ``doc``: the row of each; ``first``: where each row's words begin (one more entry than
    rows); ``starts`` and ``ends``: byte spans in ``data``. A null text has no words.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.data = LOWER[data] if lower else data
        self._spans()
        self.number = self._numbers()
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def _spans(self) -> None:
        n = len(self.data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            return
        inside = ~SEPARATOR[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1

    def _numbers(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + STEP, "right")))
            part = BYTE_CODES[self.data[lo : self.ends[j - 1]]]
            up, down = powers(len(part) + 1)
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            out[i:j] = (total[self.ends[i:j] - lo] - total[self.starts[i:j] - lo]) * down[self.starts[i:j] - lo]
            i = j
        return mixed(out)

    def counts(self) -> np.ndarray:
        """Number of words of each row."""
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def row_words(self, row: int) -> list[bytes]:
        """The words of one row."""
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().split()


def ngrams(number: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n-grams that begin at each word (fewer by n - 1), rows not told apart."""
    if len(number) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(number) + 1)
    total = np.zeros(len(number) + 1, np.uint64)
    np.cumsum(number * up[: len(number)], out=total[1:])
    return mixed((total[n:] - total[:-n]) * down[: len(number) - n + 1])


def same_row(words: Words, n: int) -> np.ndarray:
    """Whether the n-gram that begins at each word (fewer by n - 1) stays in its row."""
    if len(words.doc) < n:
        return np.zeros(0, bool)
    return words.doc[n - 1 :] == words.doc[: len(words.doc) - n + 1]


def document_fold(ids: list[object], folds: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``folds``; a null id counts as an empty text."""
    import zlib

    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % folds for i in ids], np.int64)
