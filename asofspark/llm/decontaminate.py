"""Operator 8: benchmark decontamination by size-partitioned MinHash containment.

A test item is short and a document may be long, so their Jaccard similarity is tiny even
where the item stands in the document whole; containment is what has to be searched.
Items are partitioned by their number of distinct shingles.  An item is known by the
smallest hashes of its shingles (a bottom-k MinHash sketch), with k set by its partition:
a document that contains a share of 0.8 lacks few shingles, so if k exceeds what it may
lack it must hold at least k minus that many of the sketch.  A search for that many hits
therefore finds every contained item, whatever the document's length.

Documents look their shingles up in a Bloom filter of all sketches; only the documents with
hits go on, to the exact join with the sketches.  Any document that has enough of a sketch has one
of its few rarest hashes, so only these are joined: a phrase that many items share brings
no pairs unless an item has nothing rarer.  Candidate pairs are verified by the exact
containment of shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.storage import stored

WIDTH = 5
#: Containment as a fraction, for exact comparison.
SHARE = (4, 5)
#: Sketch hashes above what a containing document may lack: the hits that a candidate needs at least (if it has so many).
HITS = 4
#: Bits of the filter for each sketch hash (a long document asks for many shingles, so that a chance hit must be rare), and the
#: logarithms of its least and largest size (16 MB; beyond it, the filter only lets more documents through to the exact join).
BITS_A_HASH, FILTER_BITS = 2048, (22, 27)

#: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = grid.LOWER | grid.UPPER | grid.DIGIT | grid.byte_set(range(128, 256))
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def may_lack(n: int) -> int:
    """Shingles of n that a containing text may lack."""
    return n - -(-SHARE[0] * n // SHARE[1])


def sketch_size(n: int) -> int:
    """Hashes kept of an item: set by the largest size of its partition [2^c, 2^(c+1))."""
    return min(n, may_lack((1 << n.bit_length()) - 1) + HITS)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the words' offsets per text."""
    t = grid.Texts(column, fold=True)
    starts, ends, off = t.spans(WORD[t.buf])
    return t.hash_spans(starts, ends), off


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def shingles(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _sketched(items: DataFrame) -> DataFrame:
    """ik, item_id, _item, width, n, need, sketch of every item that has a word; a shorter item is one shingle of its own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_item"):
            hashes, off = word_hashes(piece.column(2))
            width = np.minimum(np.diff(off), WIDTH)
            sets = []
            for a, b, w in zip(off[:-1], off[1:], width, strict=True):
                runs = grid.windows(hashes[a:b], np.array([0, b - a]), int(w))[0] if w else hashes[:0]
                sets.append(np.unique(runs))
            kept = [h[: sketch_size(len(h))] if len(h) else h for h in sets]
            need = [len(k) - may_lack(len(h)) for h, k in zip(sets, kept, strict=True)]
            cols = [pa.array(width), pa.array([len(h) for h in sets], pa.int64()), pa.array(need, pa.int64()), pa.array([k.view(np.int64).tolist() for k in kept], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *cols], names=["ik", "item_id", "_item", "width", "n", "need", "sketch"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"ik long, item_id {kind}, _item string, width long, n long, need long, sketch array<long>").where("n > 0")


def _probes(sketches: DataFrame) -> DataFrame:
    """ik, h: of each sketch the hashes that fewest items share; who has ``need`` of the sketch has one of them."""
    shared = sketches.groupBy("h").agg(F.count("ik").alias("items"))
    rank = F.row_number().over(Window.partitionBy("ik").orderBy("items", "h"))
    return sketches.join(shared, "h").withColumn("_r", rank).where("_r <= kept - need + 1").select("ik", "h")


def bit_table(sketches: DataFrame) -> np.ndarray:
    """Bloom filter of the sketches, two bits for each hash; its size follows their number."""
    size = min(max((BITS_A_HASH * sketches.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    mask = (1 << size) - 1
    places = F.explode(F.array(F.expr(f"(h & {mask}) + 1"), F.expr(f"(shiftrightunsigned(h, {size}) & {mask}) + 1")))
    bits = sketches.select(places.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    table = np.zeros(1 << size >> 3, dtype=np.uint8)
    for k, b in bits.collect():  # 4,096 rows of 4 KB at most
        table[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(b), dtype=np.uint8)
    return table


def _hits(docs: DataFrame, table: np.ndarray, widths: list[int]) -> DataFrame:
    """Documents with hashes in the filter: doc_id, _text, n (shingles of WIDTH words), hits."""
    size = np.uint64(len(table).bit_length() + 2)
    mask = (np.uint64(1) << size) - np.uint64(1)

    def held(places: np.ndarray) -> np.ndarray:
        return (table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_text"):
            hashes, word_off = word_hashes(piece.column(1))
            owners, met = [], []
            for w in widths:
                runs, off = grid.windows(hashes, word_off, w)
                at = np.flatnonzero(held(runs & mask))
                at = at[held((runs[at] >> size) & mask)]
                owners.append(np.searchsorted(off, at, "right") - 1)
                met.append(runs[at])
            owner, hit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, met))
            order = np.lexsort((hit, owner))
            owner, hit = owner[order], hit[order].view(np.int64)
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])
            owner, hit = owner[new], hit[new]
            rows, first = np.unique(owner, return_index=True)
            some = piece.take(pa.array(rows))
            found = pa.ListArray.from_arrays(pa.array(np.append(first, len(hit)).astype(np.int32)), pa.array(hit))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.maximum(np.diff(word_off) - WIDTH + 1, 0)[rows]), found], names=["doc_id", "_text", "n", "hits"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _text string, n long, hits array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    """Exact containment of each candidate pair; those below SHARE go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, held = None, [], {}
        for piece in grid.slices(batches, "_text"):
            rows = []
            for text, item in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                if text != last:
                    last, words, held = text, words_of(text), {}
                asked = words_of(item)
                width = min(WIDTH, len(asked))
                if width not in held:
                    held[width] = shingles(words, width)
                asked = shingles(asked, width)
                rows.append((len(asked), len(asked & held[width])))
            n, shared = np.array(rows, dtype=np.int64).reshape(-1, 2).T
            out = pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(n), pa.array(shared), pa.array(shared / np.maximum(n, 1))], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])
            yield out.filter(pa.array(SHARE[1] * shared >= SHARE[0] * n))

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_shingles long, n_shared long, containment double")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """One row for each document and test item that it contains: doc_id, item_id, n_shingles, n_shared, containment.

    A shingle is WIDTH words of ASCII letters and digits (case folded) and non-ASCII
    characters; an item is contained if the document has 4/5 of its distinct shingles.  An
    item of fewer words is one shingle, found where its words stand in a row.  Null texts
    count as empty; items without a word are in no result, nor are documents that contain
    nothing.  Texts of any length are read whole.  Repeated rows of either table give
    repeated results, equal items of different ids each their own row; a null id stays null; an empty table on
    either side gives an empty result; extra columns are ignored.
    """
    items = stored(_sketched(benchmark.select(F.monotonically_increasing_id().alias("ik"), "item_id", F.col(item_text).alias("_item"))))
    sketches = items.select("ik", "need", F.size("sketch").alias("kept"), F.explode("sketch").alias("h"))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WIDTH numbers at most
    probes = stored(_probes(sketches))
    found = stored(_hits(docs.select("doc_id", docs[text].alias("_text")), bit_table(probes), widths).withColumn("rid", F.monotonically_increasing_id()))
    met = found.select("rid", F.explode("hits").alias("h")).join(probes, "h").select("rid", "ik").distinct()
    pairs = met.join(items.select("ik", "item_id", "_item", "width", F.col("n").alias("_n")), "ik").join(found.select("rid", "doc_id", "_text", "n"), "rid")
    pairs = pairs.where((F.col("width") < WIDTH) | (SHARE[1] * F.col("n") >= SHARE[0] * F.col("_n")))
    return _verified(pairs.select("doc_id", "item_id", "_text", "_item"))
