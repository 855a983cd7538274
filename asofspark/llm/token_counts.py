"""Operator 5: token counts from pre-token frequencies.

A byte-level BPE token never crosses a pre-token, so the number of tokens of a text is
the sum over its distinct pre-tokens of (times it occurs) x (pieces it has).  Each task
keeps a table of the pre-tokens it has met with their numbers of pieces; every distinct
pre-token is given to the tokenizer once, the table is joined to the per-document
frequencies by hash, and the products are summed.  No token id is kept, and nothing is
shuffled: a join of (document, pre-token) rows across tasks would move more bytes than
the texts have.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.pretokens import pretoken_spans

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pre-tokens in a task's table at most; a full table is begun anew, which costs time only.
TABLE_ROWS = 1_000_000


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class PieceTable:
    """Numbers of pieces of the pre-tokens met so far, by 64-bit hash and length."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        kind = self.tokenizer.pre_tokenizer
        if type(kind).__name__ != "ByteLevel" or self.tokenizer.normalizer is not None:
            raise ValueError(f"{vocabulary} isn't a byte-level BPE without normalizer")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if len(special) > 1:
            raise ValueError(f"{vocabulary} has more than one added token")
        self.special = special[0].encode() if special else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.sizes, self.pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def join(self, keys: np.ndarray, sizes: np.ndarray, spelled) -> np.ndarray:
        """Pieces of each of the sorted distinct keys; ``spelled(i)`` gives the pre-token of keys[i], sizes[i] its bytes."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[place] == keys) & (self.sizes[place] == sizes) if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), np.int64)
        out[known] = self.pieces[place[known]]
        new = np.flatnonzero(~known)
        split = self.tokenizer.model.tokenize
        out[new] = [1 if (s := spelled(i)) == self.special else len(split(s.decode("latin-1").translate(_LETTERS))) for i in new.tolist()]
        if len(self.keys) + len(new) > TABLE_ROWS:
            self.clear()
        at = np.searchsorted(self.keys, keys[new])
        self.keys, self.sizes, self.pieces = np.insert(self.keys, at, keys[new]), np.insert(self.sizes, at, sizes[new]), np.insert(self.pieces, at, out[new])
        return out


def count_tokens(column: pa.Array, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text."""
    t = grid.Texts(column)
    starts, ends, off = pretoken_spans(t, table.special)
    keys = t.hash_spans(starts, ends)
    order = np.argsort(keys, kind="stable")
    ordered, size = keys[order], (ends - starts)[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (size[1:] != size[:-1])
    at = order[new]
    data, start, end = t.buf.tobytes(), starts[at].tolist(), ends[at].tolist()
    pieces = table.join(keys[at], ends[at] - starts[at], lambda i: data[start[i] : end[i]])
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    # The frequency of each distinct pre-token of a text, times its pieces.
    pairs, times = np.unique(grid.owners(off) * max(1, len(at)) + which, return_counts=True)
    owner, place = np.divmod(pairs, max(1, len(at)))
    total = np.bincount(owner, times * pieces[place], t.n)[: t.n] if len(at) else np.zeros(t.n)
    return np.diff(t.off), total.astype(np.int64)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizers library with special strings as it treats them by
    default and no token added.  A null text counts as empty (0 bytes, 0 tokens); texts
    of any length are read whole; repeated rows give repeated results; a null doc_id stays null; an empty table
    gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(vocabulary)
        for piece in grid.slices(batches, "_text"):
            size, tokens = count_tokens(piece.column(1), table)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", docs[text].alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
