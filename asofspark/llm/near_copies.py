"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash.

Texts with the same words are grouped first.  Each other text gets a SimHash of its distinct shingles: a print of
PRINT bits and blocks of code bits, more and longer ones for more documents.  A shingle votes on every bit with a hashed byte
(not with a sign, so that sets of four shingles behave like large ones), and the margin of a bit is how far its votes are from a tie.

At a similarity of 0.8 some 15 % of the bits differ, so balls of one or two bits don't reach such pairs.  They differ in bits
of small margin, though: a block's ball holds the FLIPS codes that flip some of its WEAK bits of least margin.  Two texts
meet in the middle, where their balls of a block have a code in common; all blocks miss a pair at 0.8 with
a probability of 2e-6 at most, and any closer one with less.  Codes travel, not balls: a code goes to
the ranges of codes that its ball touches, and balls are built there.  Texts that meet are linked if their prints
differ in no more than RADIUS bits (missed at 0.8: below 1e-6) and the sizes of their sets allow the similarity.

A family of near copies meets in many codes, and all its pairs would be a square for each.  So a range of codes gives
only a tree of what it links: one row for each text that isn't the first of its tree.  All trees together make classes, in which
every two texts that were linked in any code lie.  Each class is compared once, all with all, by the exact similarity of
its texts' shingle sets over an inverted index, in pairs of blocks of bounded size, and only links that connect come back.
Only texts of classes are read for that, and a text goes to as many tasks as its class has other blocks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.components import connected_components
from asofspark.llm.decontaminate import bit_table
from asofspark.llm.simhash import spaced
from asofspark.llm.storage import discard, stored

WIDTH = 5
#: Jaccard similarity as a fraction, for exact comparison.
SHARE = (4, 5)
#: Bits of the print; two texts at SHARE differ in more than RADIUS of them with a probability below 1e-6.
PRINT, RADIUS, SEED = 128, 42, 42
#: Blocks by the bits of their codes: a pair at SHARE meets in none with a probability of 2e-6 at most.
BLOCKS = dict(zip(range(20, 33), (7, 7, 8, 9, 10, 11, 12, 13, 15, 16, 18, 19, 21), strict=True))
#: Bits of a code beyond those that number the documents: a ball then meets few others by chance.
SPARE = 8
#: Bits of least margin that a ball flips, and its codes.
WEAK, FLIPS = 8, 64
#: Documents to a range of codes, about; a power of two of ranges, from 4 to 64.
RANGE_DOCS = 1 << 17
#: Codes sorted at once.
CODES = 1 << 22
#: Texts of a code whose pairs are all tried at once, and those of different components among which they are; of more, a tree is sought step by step.
SMALL, MIDDLE = 8, 32
#: Texts and their bytes of a class in one block, on average at most; two blocks are compared in one task.
BLOCK, BLOCK_BYTES = 400, 8 << 20
#: Compression of the texts of candidates; the highest common level makes them 6 % smaller than level 3.
LEVEL = 19
#: Entries of the inverted index read, or prints compared, at once.
READ = 1 << 20


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, grid.Texts]:
    """Hashes of all WIDTH-word shingles, and their offsets per text; shorter texts have none."""
    t = grid.Texts(column, fold=True)
    starts, ends, off = t.words()
    return *grid.windows(t.hash_spans(starts, ends), off, WIDTH), t


def distinct(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, and their offsets."""
    owner = grid.owners(off)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(off) - 1))])


def votes(hashes: np.ndarray, off: np.ndarray, bits: int) -> np.ndarray:
    """(texts, bits) sums of the shingles' votes, each from -255 to 255; off must hold no empty text.

    Four bytes are summed at once in the 16-bit lanes of a word, over 256 shingles at most.
    """
    words = -(-bits // 8)
    flips, odds = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 128), dtype=np.uint64)
    n = np.diff(off)
    parts = -(-n // 256)
    part_off = np.concatenate([[0], np.cumsum(parts)])
    starts = np.repeat(off[:-1] - 256 * part_off[:-1], parts) + 256 * np.arange(part_off[-1])
    lanes, out = np.uint64(0x00FF00FF00FF00FF), np.empty((len(n), words * 8), dtype=np.int64)
    for w in range(words):
        drawn = grid.mixed((hashes ^ flips[w]) * (odds[w] | np.uint64(1)))
        for k, half in enumerate((drawn & lanes, (drawn >> np.uint64(8)) & lanes)):
            sums = np.add.reduceat(half, starts).view(np.uint16).reshape(-1, 4)
            out[:, 8 * w + 4 * k : 8 * w + 4 * k + 4] = np.add.reduceat(sums, part_off[:-1], axis=0, dtype=np.int64)
    return (2 * out - 255 * n[:, None])[:, :bits]


def entry_type(blocks: int) -> np.dtype:
    return np.dtype([("print", "<u8", PRINT // 64), ("code", "<u4", blocks), ("weak", "u1", (blocks, WEAK))])


def simhashes(hashes: np.ndarray, off: np.ndarray, bits: int) -> np.ndarray:
    """Print, codes of ``bits`` bits and their WEAK bits of least margin, the least first; hashes are distinct, off holds no empty text."""
    blocks = BLOCKS[bits]
    sums = votes(hashes, off, PRINT + blocks * bits)
    out = np.zeros(len(off) - 1, dtype=entry_type(blocks))
    out["print"] = np.packbits(sums[:, :PRINT] > 0, axis=1).view("<u8")
    sums = sums[:, PRINT:].reshape(-1, blocks, bits)
    out["code"] = ((sums > 0) * (1 << np.arange(bits))).sum(axis=2)
    out["weak"] = np.argsort(np.abs(sums), axis=2, kind="stable")[:, :, :WEAK]
    return out


@lru_cache(maxsize=1)
def flipped() -> tuple[tuple[int, ...], ...]:
    """The FLIPS sets of ranks among the WEAK bits with the least sums, the empty set first."""
    every = (c for n in range(WEAK + 1) for c in itertools.combinations(range(WEAK), n))
    return tuple(sorted(every, key=lambda c: (sum(c) + len(c), len(c), c))[:FLIPS])


def ball(code: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """(codes, FLIPS) codes of each one's ball."""
    bit = np.uint32(1) << weak.astype(np.uint32)
    out = np.repeat(code[:, None], FLIPS, axis=1)
    for k, ranks in enumerate(flipped()):
        for r in ranks:
            out[:, k] ^= bit[:, r]
    return out


def word_keys(t: grid.Texts) -> list[bytes]:
    """128-bit digest of each text's words."""
    data, starts, ends, off = spaced(t)
    some = np.diff(off) > 0
    spans = [(0, 0)] * t.n
    for k in np.flatnonzero(some):
        spans[k] = (int(starts[off[k]]), int(ends[off[k + 1] - 1]))
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in spans]


def packed(column: pa.Array) -> pa.Array:
    """Each text (null: empty) compressed; texts travel and lie in this form."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return pa.array([pack((text or "").encode()) for text in column.to_pylist()], pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(data).decode() for data in column.to_pylist()], pa.large_string())


def _numbered(keys: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(keys), dtype="<i8")[::2]


def _sketched(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, key (of the words), h (its first bits), size (the text's bytes), n (distinct shingles) and sketch (none if there is no shingle) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_text"):
            hashes, off, t = shingle_hashes(piece.column(1))
            hashes, off = distinct(hashes, off)
            full = np.flatnonzero(np.diff(off))
            sketch: list[bytes | None] = [None] * t.n
            if len(full):
                for k, entry in zip(full, simhashes(hashes, off[np.append(full, t.n)], bits), strict=True):
                    sketch[k] = entry.tobytes()
            keys = word_keys(t)
            cols = [pa.array(keys, pa.binary()), pa.array(_numbered(keys)), pa.array(np.diff(t.off)), pa.array(np.diff(off)), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([piece.column(0), *cols], names=["doc_id", "key", "h", "size", "n", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key binary, h long, size long, n long, sketch binary")


def candidates(found: np.ndarray, block_bits: int, range_bits: int, part: int, last: bool, small: int, middle: int) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]], bool]:
    """Pairs of rows of ``found`` that meet in a code of range ``part``, groups (h, rows) that stay, and whether a group had but neighbours tried.

    Of rows with one root no pair is taken; ``small`` and ``middle`` are SMALL and MIDDLE.  Only the ``last`` time groups stay.
    """
    node, root, size, prints = found["node"], found["root"], found["n"], found["print"]
    pairs, groups, partly = [], [], False

    def near(a: np.ndarray, b: np.ndarray) -> None:
        ok = root[a] != root[b]
        a, b = a[ok], b[ok]
        ok = SHARE[1] * np.minimum(size[a], size[b]) >= SHARE[0] * np.maximum(size[a], size[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= RADIUS
        pairs.append(np.unique(np.minimum(a, b)[ok] * len(found) + np.maximum(a, b)[ok]))

    turns = 1 + len(found) * FLIPS // CODES
    step = max(1, CODES // FLIPS)
    for turn in range(turns):
        some = []
        for at in range(0, len(found), step):
            codes = ball(found["code"][at : at + step], found["weak"][at : at + step])
            mine = (codes >> np.uint32(block_bits - range_bits)) == part
            if turns > 1:
                mine &= (codes * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(turns) == turn
            row, column = np.nonzero(mine)
            some.append((codes[row, column], row + at))
        codes, rows = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], rows[order]
        start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(codes)))
        for d in range(1, small):
            for k in range(small - d):
                at = start[(length <= small) & (length > k + d)] + k
                near(rows[at], rows[at + d])
        for at, n in zip(start[length > small], length[length > small], strict=True):
            group = rows[at : at + n]
            group = group[np.lexsort((node[group], root[group]))]
            if root[group[0]] == root[group[-1]]:
                continue
            if last and n <= middle:
                near(*(group[x] for x in np.triu_indices(n, 1)))
                continue
            near(group[:-1], group[1:])
            partly = True
            if last:
                same = node[group].astype(np.uint64)
                groups.append((int(grid.mixed(same + np.uint64(1)).sum().view(np.int64)), group))
    return pairs, groups, partly


def tree(found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows of ``found``) that join all of ``rows`` which chains of close prints and fitting sizes join.

    A row is compared with those that weren't reached before it, so that the work on a family is in proportion to it.
    """
    size, prints = found["n"], found["print"]
    left, ends = rows, ([np.zeros(0, rows.dtype)], [np.zeros(0, rows.dtype)])
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            after = []
            at = 0
            while at < len(front) and len(left):
                some = front[at : at + max(1, READ // len(left))]
                at += len(some)
                close = np.bitwise_count(prints[some][:, None] ^ prints[left]).sum(axis=2, dtype=np.int64) <= RADIUS
                close &= SHARE[1] * np.minimum(size[some][:, None], size[left]) >= SHARE[0] * np.maximum(size[some][:, None], size[left])
                hit = close.any(axis=0)
                ends[0].append(some[close.argmax(axis=0)[hit]])
                ends[1].append(left[hit])
                after.append(left[hit])
                left = left[~hit]
            front = np.concatenate(after)
    return np.concatenate(ends[0]), np.concatenate(ends[1])


def firsts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 to n - 1 that links (a, b) join each of them to."""
    first = np.arange(n)
    while (first[a] != first[b]).any():
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, first[a], least)
        np.minimum.at(first, first[b], least)
        while (first[first] != first).any():
            first = first[first]
    return first


def _met(prints: DataFrame, bits: int, count: int) -> DataFrame:
    """Links (a, b) among prints (node, n, sketch): for each block and range of codes trees of the nodes that meet there."""
    blocks = BLOCKS[bits]
    range_bits = min(6, max(2, (count // RANGE_DOCS).bit_length()))
    limits = SMALL, MIDDLE
    fields = [("node", "<i8"), ("n", "<i4"), ("print", "<u8", PRINT // 64), ("code", "<u4"), ("weak", "u1", WEAK)]
    entry, rooted = np.dtype(fields), np.dtype([*fields, ("root", "<i8")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=entry_type(blocks))
            out, slots, held_by = np.zeros(len(known), dtype=entry), [], []
            for k, name in enumerate(("node", "n")):
                out[name] = batch.column(k).to_numpy()
            out["print"] = known["print"]
            for t in range(blocks):
                out["code"], out["weak"] = known["code"][:, t], known["weak"][:, t]
                parts = ball(out["code"], out["weak"]) >> np.uint32(bits - range_bits)
                touched = np.bitwise_or.reduce(np.uint64(1) << parts.astype(np.uint64), axis=1)
                for part in range(1 << range_bits):
                    mine = out[(touched >> np.uint64(part)) & np.uint64(1) > 0]
                    if len(mine):
                        slots.append((t << range_bits) + part)
                        held_by.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(held_by, pa.binary())], names=["slot", "held"])

    def meet(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        dealt = np.frombuffer(b"".join(table.column("held").to_pylist()), dtype=entry)
        found = np.zeros(len(dealt), dtype=rooted)
        for name in entry.names:
            found[name] = dealt[name]
        found["root"] = found["node"]
        found.sort(order="node")
        pairs, groups, _ = candidates(found, bits, range_bits, slot & ((1 << range_bits) - 1), True, *limits)
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        links = [(codes // len(found), codes % len(found)), *(tree(found, rows) for _, rows in groups)]
        first = firsts(*(np.concatenate(x) for x in zip(*links, strict=True)), len(found))
        more = np.flatnonzero(first != np.arange(len(found)))
        return pa.table({"a": found["node"][first[more]], "b": found["node"][more]})

    dealt = prints.where("sketch is not null").select("node", "n", "sketch").mapInArrow(deal, "slot int, held binary")
    return dealt.groupBy("slot").applyInArrow(meet, "a long, b long").distinct()


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """node and packed (a text of its words) for the rows node, key, h of ``need``; other texts are left after their words are known."""
    table = bit_table(need)
    bits = np.uint64(len(table).bit_length() + 2)
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def held(places: np.ndarray) -> np.ndarray:
        return (table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for piece in grid.slices(batches, "_text"):
            keys = word_keys(grid.Texts(piece.column(1), fold=True))
            h = _numbered(keys).view(np.uint64)
            at = [k for k in np.flatnonzero(held(h & mask) & held((h >> bits) & mask)) if not (keys[k] in seen or seen.add(keys[k]))]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.binary()), packed(piece.column(1).take(pa.array(at, pa.int64())))], names=["key", "packed"])

    return docs.mapInArrow(run, "key binary, packed binary").join(need.select("node", "key"), "key").groupBy("node").agg(F.any_value("packed").alias("packed"))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, in order."""
    hashes, off, _ = shingle_hashes(column)
    return [np.unique(hashes[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]


def similar(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``shared`` of two sets' ``sizes`` (their sum) is a similarity of SHARE at least."""
    return (shared > 0) & (SHARE[1] * shared >= SHARE[0] * (sizes - shared))


def connecting(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) between similar sets that join all components which any similar pair joins."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    held, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(place))])
    part = np.unique(roots, return_inverse=True)[1]
    at, links = np.concatenate([[0], np.cumsum(size)]), []
    for k in range(1, len(sets)):
        if (part == part[0]).all():
            break
        shared = np.zeros(len(sets), dtype=np.int64)
        mine = place[at[k] : at[k + 1]]
        for some in np.array_split(mine, 1 + len(mine) * len(sets) // READ):
            n = start[some + 1] - start[some]
            first = np.repeat(start[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(held[first], minlength=len(sets))
        for m in np.flatnonzero(similar(shared[:k], size[:k] + size[k])):
            if part[m] != part[k]:
                links.append((int(nodes[m]), int(nodes[k])))
                part[part == part[m]] = part[k]
    return links


def _linked(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components ``root`` of each (h, i, j) group's nodes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [x for piece in grid.slices(iter(table.to_batches()), "packed") for x in shingle_sets(unpacked(piece.column(5)))]
        links = connecting(table.column("node").to_numpy(), table.column("root").to_numpy(), sets)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    known = groups.join(texts, "node").select("h", "i", "j", "node", "root", "packed")
    return known.groupBy("h", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _apart(met: DataFrame) -> DataFrame:
    """h, i, j, node, root: groups with several roots, dealt over pairs of blocks.

    Every pair of a group meets in a pair of blocks, and a pair of equal blocks is needed only where there is no other.
    """
    sizes = met.groupBy("h").agg(F.count("node").alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    met = met.join(sizes.select("h", F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("bytes") / BLOCK_BYTES, F.col("n")))).cast("int").alias("blocks")), "h").withColumn("k", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("k").cast("int"))))
    return met.withColumn("o", other).select("h", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "node", "root")


def near_copy_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id.

    component_id is the smallest doc_id that is reachable over near copies.  Texts with the
    same words (none, for null and blank ones) are copies, whatever their length; a null
    doc_id never is a component_id unless the component has no other.  Repeated rows give repeated results, an empty
    table an empty one, and extra columns are ignored.  The result is a stored table;
    the tables that it was made of are deleted.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(stored(df))
        return made[-1]

    count = docs.count()
    bits = min(max(BLOCKS), max(min(BLOCKS), max(1, count - 1).bit_length() + SPARE))
    plain = docs.select("doc_id", docs[text].alias("_text"))
    rows = keep(_sketched(plain, bits))
    first = F.min_by(F.struct("h", "size", "n", "sketch"), "size")
    prints = rows.groupBy("key").agg(F.min("doc_id").alias("least"), first.alias("_first")).select("key", "least", "_first.*")
    prints = keep(prints.withColumn("node", F.monotonically_increasing_id()))

    classes = connected_components(_met(prints, bits, count)).withColumnRenamed("root", "_class")
    classes = keep(prints.join(classes, "node").select("node", "key", "h", "size", "_class"))
    texts = keep(_texts(plain, classes))
    groups = classes.select(F.col("_class").alias("h"), "node", "size", F.col("node").alias("root"))
    roots = keep(connected_components(_linked(_apart(groups), texts)))
    rooted = prints.join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = keep(rooted.join(component, "root").select("key", "component_id"))
    groups = stored(rows.join(named, "key").select("doc_id", "component_id"))
    for table in made:
        discard(table)
    return groups
