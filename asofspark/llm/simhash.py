"""Operator 6: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2 bits have a common neighbour at 1 bit
or less from each.  So every distinct fingerprint emits its ball of radius 1 (itself and
64 variants); equal variants meet in a shuffle.  A variant has at most 65 fingerprints
around it, whatever the data, so no group is large, and all of one group lie within
2 bits of each other: linking neighbours in sorted order keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.components import connected_components
from asofspark.llm.storage import stored

SHINGLE, SEED, RADIUS = 3, 42, 2
_MASKS = [0, *(1 << k for k in range(63)), -(1 << 63)]


def spaced(t: grid.Texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The slice with one blank between the words of a text; the words' spans in it, and their offsets."""
    starts, ends, off = t.words()
    keep = ~grid.SPACE[t.buf]
    inner = np.ones(len(starts), dtype=bool)
    inner[off[:-1][np.diff(off) > 0]] = False
    gaps = starts[inner] - 1
    keep[gaps] = True
    clean = t.buf.copy()
    clean[gaps] = 32
    place = np.cumsum(keep)
    return clean[keep].tobytes(), place[starts] - 1, place[ends - 1], off


def fingerprints(column: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as signed 64-bit numbers; texts without words have 0."""
    from xxhash import xxh64_intdigest

    t = grid.Texts(column, fold=True)
    data, starts, ends, off = spaced(t)
    words = np.diff(off)
    n = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(off[:-1] - at[:-1], n) + np.arange(at[-1])
    last = np.minimum(first + width, np.repeat(off[1:], n)) - 1
    spans = zip(starts[first].tolist(), ends[last].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in spans), dtype=np.uint64, count=int(at[-1]))
    out = np.zeros(t.n, dtype=np.uint64)
    places = np.uint64(1) << np.arange(64, dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for k in np.flatnonzero(n):
        votes = bits[at[k] : at[k + 1]].sum(axis=0, dtype=np.int64)
        out[k] = places[2 * votes > n[k]].sum()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints(piece.column(1)))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", docs[text].alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def near_pairs(prints: DataFrame) -> DataFrame:
    """Links (a < b) between distinct fingerprints ``fp`` that connect all within RADIUS bits.

    Of the fingerprints around one variant, each is linked to the next larger.
    """
    ball = F.explode(F.transform(F.array(*[F.lit(m) for m in _MASKS]), lambda m: F.col("fp").bitwiseXOR(m)))
    met = prints.select("fp", ball.alias("variant")).select("variant", "fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"))
    return met.where("a is not null").select("a", F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def simhash_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id that is reachable over links of at most RADIUS
    differing bits.  A null or blank text has fingerprint zero and is linked like any
    other; a null doc_id never is a component_id unless the component has no other.  Texts of any length are
    read whole; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
    """
    rows = stored(with_fingerprints(docs, text))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_pairs(prints.select("fp")))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(component, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
