"""Pre-token spans of byte-level BPE, found on a whole slice of texts with numpy.

The pattern is the published one of byte-level BPE vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A span starts where the class of a character (letter, number, space, other) changes,
except that one blank before a word belongs to it and that contractions stand alone.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from asofspark.llm import grid

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: White space of the Unicode property White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _class_of(code: int) -> int:
    if code in _WHITE:
        return BLANK
    kind = unicodedata.category(chr(code))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; 255 where it isn't known yet."""
    table = np.full(0x110000, 255, dtype=np.uint8)
    table[:0x250] = [_class_of(c) for c in range(0x250)]
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    table = _classes()
    out = table[:256][buf]
    high = np.flatnonzero(buf >= 192)
    if len(high):
        lead = buf[high].astype(np.int64)
        size = np.where(lead >= 240, 4, np.where(lead >= 224, 3, 2))
        code = np.where(size == 4, lead & 7, np.where(size == 3, lead & 15, lead & 31))
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (buf[high[more] + k] & 63)
        kinds = table[code]
        if (kinds == 255).any():
            for c in np.unique(code[kinds == 255]):
                table[c] = _class_of(int(c))
            kinds = table[code]
        for k in range(4):
            out[high[size > k] + k] = kinds[size > k]
    return out


def found(t: grid.Texts, mark: bytes) -> np.ndarray:
    """Starts of the leftmost non-overlapping occurrences of a byte string inside texts."""
    data, out, at = t.buf.tobytes(), [], 0
    while (at := data.find(mark, at)) >= 0:
        edge = int(t.off[np.searchsorted(t.off, at, "right")])
        if at + len(mark) <= edge:
            out.append(at)
            at += len(mark)
        else:
            at += 1
    return np.array(out, dtype=np.int64)


def pretoken_spans(t: grid.Texts, special: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens of a slice, and their offsets per text.

    Where the text holds the special string, that is a span of its own and the texts on
    both sides are split as if they ended and began there.
    """
    buf, n = t.buf, len(t.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(t.n + 1, np.int64)
    kind = byte_classes(buf)
    first = np.zeros(n + 1, dtype=bool)
    first[t.off] = True
    fixed = found(t, special) if special else np.zeros(0, np.int64)
    if len(fixed):
        first[fixed] = first[fixed + len(special)] = True
    cut = np.ones(n + 1, dtype=bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut |= first
    # The last white character before a word: a blank joins the word, any other stands alone.
    word = np.flatnonzero(cut[1:n] & ~first[1:n] & (kind[:-1] == BLANK)) + 1
    joined = buf[word - 1] == 32
    cut[word[joined]] = False
    last = word - 1
    while (back := (buf[last] & 192) == 128).any():
        last = last - back
    cut[last] = True
    # Contractions: an apostrophe that starts a span, and its ending.
    mark = np.flatnonzero(cut[:n] & (buf == 39))
    if len(mark):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        edge = t.off[np.searchsorted(t.off, mark, "right")]
        done = np.zeros(len(mark), dtype=bool)
        for e in _ENDINGS:
            met = ~done & (mark + len(e) < edge)
            for k, c in enumerate(e):
                met &= padded[mark + 1 + k] == c
            at = mark[met]
            cut[at + 1] = False
            cut[at + 1 + len(e)] = True
            done |= met
    for k in range(1, len(special) if len(fixed) else 0):
        cut[fixed + k] = False
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, t.off)
