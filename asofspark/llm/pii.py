"""Operator 10: personal data by plain patterns and a linear-chain conditional random field.

The patterns find the regular forms.  The random field reads the words of the whole text
by their shapes and adds forms that no pattern fits ("jane (at) mail (dot) org",
"(017) 555 2713", "10[.]0[.]0[.]12"); its spans must hold what their kind needs (so many
digits, an address's parts) and not touch one of a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.crf import KINDS, Crf, _cue_table, shape_codes, train

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start at a run's first digit: what follows the run is the same for its other digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part of a match is the run before an at sign, as far as the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return out


_AT = re.compile(r"[(\[{]at[)\]}]|(?<!\w)at(?!\w)|@", re.I)
_DOT = re.compile(r"[(\[{]dot[)\]}]|(?<!\w)dot(?!\w)|\.", re.I)
_NUMBERS = re.compile(r"[0-9]+")


def _plausible(kind: int, words: str) -> bool:
    """Whether a span of the random field holds what its kind needs."""
    digits = _only_digits(words)
    if kind == 0:
        at = _AT.search(words)
        return bool(at and at.start() > 0 and _DOT.search(words, at.end()))
    if kind == 1:
        parts = _NUMBERS.findall(words)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and len(_NUMBERS.findall(words)) > 1


def _runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first word, last word) of the spans in a text's labels."""
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(labels):
        kind, begins = (labels[i] - 1) // 2, labels[i] % 2 == 1
        if not begins and out and out[-1][0] == kind and out[-1][2] == i - 1:
            out[-1] = (kind, out[-1][1], i)
        else:
            out.append((int(kind), int(i), int(i)))
    return out


class Finder:
    """Spans of a slice of texts."""

    def __init__(self, model: Crf):
        self.model, self.cues = model, _cue_table()

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int, bool]]]:
        """For each text (kind, start, end, found by a pattern), by kind, then start."""
        t = grid.Texts(column, fold=True)
        starts, ends, off = t.words()
        labels = self.model.label(*shape_codes(t, starts, ends, self.cues), off)
        marked = grid.span_sums(labels > 0, off) > 0
        numbered = t.sums(grid.DIGIT[t.buf]) > 0
        at_sign = t.sums(t.buf == 64) > 0
        out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(t.n)]
        for k in np.flatnonzero(marked | numbered | at_sign).tolist():
            text = column[k].as_py()
            found = [(*s, True) for s in base_spans(text)] if numbered[k] or at_sign[k] else []
            if marked[k]:
                found += self._added(text, t, starts[off[k] : off[k + 1]], ends[off[k] : off[k + 1]], labels[off[k] : off[k + 1]], int(t.off[k]), found)
            out[k] = sorted(found)
        return out

    @staticmethod
    def _added(text: str, t: grid.Texts, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, begin: int, base: list) -> list:
        taken, new = [(a, b) for _, a, b, _ in base], []
        for kind, i, j in _runs(labels):
            a = int(grid.LEAD[t.buf[begin : starts[i]]].sum())
            b = a + int(grid.LEAD[t.buf[starts[i] : ends[j]]].sum())
            while b > a and text[b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and text[a] in "\"'":
                a += 1
            if a < b and _plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                new.append((kind, a, b, False))
        return new


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end, base).

    Offsets are code points, ends exclusive; spans are ordered by kind (email, ip, card,
    phone), then start.  A null text counts as empty and has no span; texts of any length
    are read whole; repeated rows give repeated results; a null doc_id stays null; an empty table gives an empty result;
    extra columns are ignored.
    """
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for piece in grid.slices(batches, "_text"):
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in s] for s in finder.spans(piece.column(1))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, _SPAN)], names=["doc_id", "spans"])

    rows = docs.select("doc_id", docs[text].alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def scrubbed(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` and the text, with every span replaced by its kind in angle brackets.

    Where spans of two kinds overlap, the part that they cover together becomes one mark
    of the kind that starts first.  A null text stays null, an empty one empty; repeated rows give repeated results;
    an empty table gives an empty result; columns that aren't named are left out.
    """
    model = train()

    def masked(value: str, spans: list[tuple[int, int, int, bool]]) -> str:
        parts, done, open_ = [], 0, -1
        for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= open_:
                parts += [value[done:a], f"<{KINDS[kind].upper()}>"]
            done = open_ = max(open_, b)
        return "".join([*parts, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for piece in grid.slices(batches, "_text"):
            texts = piece.column(len(columns))
            spans = finder.spans(texts)
            if any(spans):
                hit = [k for k, s in enumerate(spans) if s]
                values = texts.to_pylist()
                for k in hit:
                    values[k] = masked(values[k], spans[k])
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], texts], names=[*columns, text])

    rows = docs.select(*columns, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{text}` string"]))
