"""Statistics of whole texts that the quality operators work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_chars", "n_upper", "n_lower", "n_high", "n_digits", "n_punct", "n_short", "n_long", "n_distinct", "n_same_next",
]

_SYMBOL = grid.byte_set(SYMBOLS)
_PUNCT = grid.byte_set(range(33, 48), range(58, 65), range(91, 97), range(123, 127)) & ~_SYMBOL
_HIGH = grid.byte_set(range(192, 256))
_DOC_BITS, _LOW_BITS = np.uint64(52), np.uint64((1 << 52) - 1)


def _repeated(keys: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks keys that a text holds more than once; and the number of distinct keys of each text.

    Sorting 52 bits of a key beside its text's index is fast.  It is done with the upper and
    with the lower bits; if any text's numbers of distinct keys differ, two keys have met
    by chance and the whole 64 bits are sorted.
    """
    texts = grid.owners(off).astype(np.uint64) << _DOC_BITS
    tagged, n = (keys >> np.uint64(12)) | texts, len(off) - 1

    def distinct_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        return new, np.bincount((ordered[new] >> _DOC_BITS).astype(np.int64), minlength=n)

    ordered = np.sort(tagged)
    new, distinct = distinct_of(ordered)
    if (distinct != distinct_of(np.sort((keys & _LOW_BITS) | texts))[1]).any():
        return _repeated_whole(keys, off)
    marked = np.zeros(len(keys), dtype=bool)
    twice = ordered[1:][~new[1:]]
    if len(twice):
        held = np.zeros(n, dtype=bool)
        held[(twice >> _DOC_BITS).astype(np.int64)] = True
        at = np.flatnonzero(np.repeat(held, np.diff(off)))
        place = np.minimum(np.searchsorted(twice, tagged[at]), len(twice) - 1)
        marked[at] = twice[place] == tagged[at]
    return marked, distinct


def _repeated_whole(keys: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = grid.owners(off)
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    marked = np.zeros(len(keys), dtype=bool)
    marked[order[1:][same]] = marked[order[:-1][same]] = True
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ~same
    return marked, np.bincount(owner[order][new], minlength=len(off) - 1)


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of an Arrow string array."""
    t = grid.Texts(column)
    starts, ends, off = t.words()
    hashes = t.hash_spans(starts, ends)
    lead = grid.LEAD[t.buf]
    out = {"n_words": np.diff(off), "n_chars": t.sums(lead), "word_chars": t.sums(lead & ~grid.SPACE[t.buf])}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", grid.UPPER), ("n_lower", grid.LOWER), ("n_high", _HIGH), ("n_digits", grid.DIGIT), ("n_punct", _PUNCT)):
        out[name] = t.sums(table[t.buf])

    lines, line_ends, line_off = t.spans(t.buf != 10)
    worded = np.searchsorted(starts, lines) < np.searchsorted(starts, line_ends)
    kept = np.concatenate([[0], np.cumsum(worded)])[line_off]
    _, distinct = _repeated(t.hash_spans(lines[worded], line_ends[worded]), kept)
    out["n_lines"] = np.diff(kept)
    out["n_dup_lines"] = out["n_lines"] - distinct

    runs, run_off = grid.windows(hashes, off, REPEAT_WINDOW)
    twice, _ = _repeated(runs, run_off)
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    at = at - np.repeat(run_off[:-1] - off[:-1], np.diff(run_off))[at]
    cover[at] += 1
    np.subtract.at(cover, at + REPEAT_WINDOW, 1)
    out["n_repeat_words"] = grid.span_sums(np.cumsum(cover[:-1]) > 0, off)

    _, out["n_distinct"] = _repeated(hashes, off)
    size = ends - starts
    out["n_short"], out["n_long"] = grid.span_sums(size <= 3, off), grid.span_sums(size > 20, off)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[off[:-1][np.diff(off) > 0]] = False
    out["n_same_next"] = grid.span_sums(same, off)
    return {name: np.asarray(out[name], dtype=np.int64) for name in COUNTS}


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and COUNTS (long) of every row; a null text counts as empty, no row is lost.  A text that is kept is sent to Python once."""
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    read = text if text in keep else "_text"
    at = rows.columns.index(read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, read):
            counts = count_texts(piece.column(at))
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], *(pa.array(v) for v in counts.values())], names=[*keep, *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(run, schema)
