"""Numpy view of a batch of texts: byte buffer, words, hashes and per-text sums.

Python workers get texts as Arrow string arrays.  These helpers work on the UTF-8
bytes of a whole slice at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a Python worker (a longer text is its own slice).
SLICE_BYTES = 1 << 20
#: Texts in a slice at most, so that a text's index fits in 12 bits.
SLICE_TEXTS = 4096

_SPACES = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def byte_set(*members: bytes | range) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    table = np.zeros(256, dtype=bool)
    for m in members:
        table[list(m)] = True
    return table


SPACE = byte_set(_SPACES)
UPPER = byte_set(range(65, 91))
LOWER = byte_set(range(97, 123))
DIGIT = byte_set(range(48, 58))
#: First byte of a code point.
LEAD = byte_set(range(128), range(192, 256))
#: A-Z to a-z, all other bytes as they are.
FOLD = np.where(UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (in place)."""
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    """Powers of the base for the bytes of one slice; longer spans are hashed slice by slice."""
    out = np.full(SLICE_BYTES + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a string array's values in its data; strings with 32-bit and with 64-bit offsets are read."""
    if not len(column):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each piece holds about SLICE_BYTES of ``column``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        off = offsets(col)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), at + SLICE_TEXTS, len(col))
            yield batch.slice(at, to - at)
            at = to


class Texts:
    """The bytes of a slice's texts (null: empty), one after the other."""

    def __init__(self, column: pa.Array, fold: bool = False):
        n = len(column)
        if column.null_count:
            column = column.fill_null("")
        if n:
            data = column.buffers()[2]
            off = offsets(column).astype(np.int64)
            buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        else:
            off, buf = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.n, self.off, self.buf = n, off - off[0], FOLD[buf] if fold else buf

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes of each text, without a long array of running totals."""
        out = np.zeros(self.n, dtype=np.int64)
        full = np.flatnonzero(np.diff(self.off))
        if len(full):
            out[full] = np.add.reduceat(mask.view(np.uint8), self.off[full], dtype=np.int64)
        return out

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes inside texts: starts, ends, and the runs' offsets per text."""
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        edge = np.zeros(len(member) + 1, dtype=bool)
        edge[self.off] = True
        before = np.empty_like(member)
        before[0] = False
        before[1:] = member[:-1]
        before &= ~edge[:-1]
        after = np.empty_like(member)
        after[-1] = False
        after[:-1] = member[1:]
        after &= ~edge[1:]
        starts = np.flatnonzero(member & ~before)
        ends = np.flatnonzero(member & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of ``[^\\x20\\x09-\\x0D]+``."""
        return self.spans(~SPACE[self.buf])

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each of the ordered, disjoint spans, the same wherever a span stands.

        Running sums are kept for SLICE_BYTES at a time, so a very long text needs no more of them.
        """
        out = np.zeros(len(starts), dtype=np.uint64)
        codes, powers, back = _byte_codes(), _powers(_BASE), _powers(_INVERSE)
        total = np.zeros(SLICE_BYTES + 1, dtype=np.uint64)
        i = 0
        while i < len(starts):
            begin = int(starts[i])
            j = int(np.searchsorted(ends, begin + SLICE_BYTES, "right"))
            if j <= i:  # one span longer than a slice
                out[i] = self._long_hash(begin, int(ends[i]))
                i += 1
                continue
            part = codes[self.buf[begin : ends[j - 1]]]
            part *= powers[: len(part)]
            np.cumsum(part, out=total[1 : len(part) + 1])
            out[i:j] = (total[ends[i:j] - begin] - total[starts[i:j] - begin]) * back[starts[i:j] - begin]
            i = j
        return mixed(out + (ends - starts).astype(np.uint64) * _ODD)

    def _long_hash(self, begin: int, end: int) -> int:
        total = 0
        for a in range(begin, end, SLICE_BYTES):
            part = _byte_codes()[self.buf[a : min(a + SLICE_BYTES, end)]]
            total += int((part * _powers(_BASE)[: len(part)]).sum()) * pow(_BASE, a - begin, 1 << 64)
        return total & ((1 << 64) - 1)


def span_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over consecutive pieces given by offsets; empty pieces give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def owners(off: np.ndarray) -> np.ndarray:
    """Index of the text of each element, from the elements' offsets per text."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def windows(hashes: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a text, and the runs' offsets per text.

    Run i of a text starts at its i-th word; texts with fewer words have none.
    """
    n = np.maximum(np.diff(off) - width + 1, 0)
    out = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=out[1:])
    first = np.repeat(off[:-1] - out[:-1], n) + np.arange(out[-1])
    total = np.zeros(out[-1], dtype=np.uint64)
    for k in range(width):
        total *= _ODD
        total += hashes[first + k]
    return mixed(total), out
