"""Operator 2: byte-level context-tree weighting.

Each byte is eight binary decisions; every decision has a Krichevsky-Trofimov (KT) estimate
in each of the contexts of 0 to DEPTH bytes before it, and the context tree weights them
all.  After training the tree is fixed, so a byte's probability depends on its DEPTH + 1
bytes only, and the model of a corpus is a table of such grams.

The work is dealt so that nothing holds the corpus or its model whole.  Texts stay in
blocks of neighbouring rows of a file, whatever splits these are read in.  A block sends
its distinct grams and words with their training counts; these are summed over all
blocks.  The two deepest levels of the tree are weighted in groups of grams with the same last
four bytes of context (65,536 grams at most), streamed in sorted order; the log weights
of their nodes are summed into depth 3, those of depth 3 into 2, and so on, as grouped sums.
Every block gets back the values of its own grams and words, with which it scores its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.storage import stored

DEPTH = 5
#: Depth from which levels are tables of nodes; the levels below it are weighted in groups of grams.
UPPER = 3
#: Bytes of a file in a block, on average.
BLOCK_BYTES = 8 << 20
#: Grams that are weighted at once (groups are kept whole), and blocks in a row of a gram's list.
CHUNK, LIST = 20_000, 4096
#: Keys that a task gathers before it merges equal ones, and distinct keys at which it sends them.
MERGE_KEYS, SEND_KEYS = 1_000_000, 4_000_000
SMOOTH = 0.1
_END_WORD = np.uint64(2**64 - 1)
_WORD_BIT = np.uint64(1 << 63)
_TAG = np.uint64(52)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _blocked(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, held_out, _text and the block of each row.

    A block is a run of rows of a Parquet file, so many that it has about BLOCK_BYTES.  Both the file's name and the
    row's place in it are the same in every scan, however the file is split and whatever executors are there.  Rows of
    other origin are stored first.
    """
    chosen = docs.select("doc_id", F.col(text).alias("_text"))
    place = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "row_index", "file_size")]
    try:
        rows = docs.select("doc_id", F.col(text).alias("_text"), *place)
    except AnalysisException:
        rows = stored(chosen).select("*", *place)
    files = rows.groupBy("_file_path").agg(F.first("_file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    size, n = files.agg(F.sum("size"), F.sum("n")).first()  # reads no column
    run = F.floor(F.col("_row_index") / max(1, round(BLOCK_BYTES * (n or 0) / (size or 1))))
    block = F.pmod(F.xxhash64("_file_path", run), F.lit(2**31 - 1))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_text", block.cast("int").alias("block"))


def gram_keys(t: grid.Texts) -> tuple[np.ndarray, np.ndarray]:
    """DEPTH + 1 bytes that end at each byte of a text and at its end mark (byte 0), and the keys' offsets.

    A text is preceded by zero bytes.
    """
    off = t.off + np.arange(t.n + 1)
    padded = np.zeros(off[-1], dtype=np.uint64)
    inside = np.ones(off[-1], dtype=bool)
    inside[off[1:] - 1] = False
    padded[inside] = t.buf
    keys = padded.copy()
    begins = off[:-1]
    back = padded
    for d in range(1, DEPTH + 1):
        shifted = np.zeros_like(back)
        shifted[1:] = back[:-1]
        shifted[begins] = 0
        keys |= shifted << np.uint64(8 * d)
        back = shifted
    return keys, off


def word_keys(t: grid.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word, and of the end after a text's words; and their offsets."""
    starts, ends, off = t.words()
    hashes = t.hash_spans(starts, ends) | _WORD_BIT
    whole = off + np.arange(t.n + 1)
    out = np.full(whole[-1], _END_WORD, dtype=np.uint64)
    inside = np.ones(whole[-1], dtype=bool)
    inside[whole[1:] - 1] = False
    out[inside] = hashes
    return out, whole


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _distinct(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in a training text.  Sorting the two kinds apart is faster than with an index."""
    sure, rest = np.sort(keys[learned]), np.sort(keys[~learned])
    new = np.flatnonzero(np.concatenate([[True], sure[1:] != sure[:-1]])) if len(sure) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(sure)))
    other = rest[np.concatenate([[True], rest[1:] != rest[:-1]])] if len(rest) else rest
    return _summed(np.concatenate([sure[new], other]), np.concatenate([times, np.zeros(len(other), np.int64)]))


def _asked(rows: DataFrame) -> DataFrame:
    """block, key, n: the distinct grams and words of each block with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def merged(block: int) -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in parts[block]]), np.concatenate([n for _, n in parts[block]]))

        def sent() -> Iterator[pa.RecordBatch]:
            for block in list(parts):
                keys, counts = merged(block)
                del parts[block]
                for a in range(0, len(keys), 100_000):
                    k, n = keys[a : a + 100_000].view(np.int64), counts[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, dtype=np.int32)), pa.array(k), pa.array(n)], names=["block", "key", "n"])

        for piece in grid.slices(batches, "_text"):
            blocks = np.asarray(piece.column(2))
            for block in np.unique(blocks).tolist():
                part = piece if (blocks == block).all() else piece.filter(pa.array(blocks == block))
                learned = ~part.column(0).to_numpy(zero_copy_only=False)
                t = grid.Texts(part.column(1), fold=True)
                for keys, off in (gram_keys(t), word_keys(t)):
                    parts.setdefault(block, []).append(_distinct(keys, np.repeat(learned, np.diff(off))))
                    held += len(parts[block][-1][0])
            if held > MERGE_KEYS:
                parts = {block: [merged(block)] for block in parts}
                distinct = sum(len(p[0][0]) for p in parts.values())
                held = distinct // 2
                if distinct > SEND_KEYS:  # a block may be sent in pieces: they are summed with all others
                    yield from sent()
                    held = 0
        yield from sent()

    return rows.select("held_out", "_text", "block").mapInArrow(run, "block int, key long, n long")


def _folded(asked: DataFrame) -> DataFrame:
    """key, n (over all blocks), lead, blocks: for each gram and word the blocks that hold it.

    A key that many blocks hold has several rows of LIST blocks; one of them is marked as ``lead``.
    Partitions come sorted by key and are read as a stream; a key's last rows wait for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            cols = [np.asarray(b.column(k)) for k in range(3)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            kept = [c[cut:] for c in cols]
            if cut:
                yield rows(*(c[:cut] for c in cols))
        if kept is not None and len(kept[0]):
            yield rows(*kept)

    def rows(keys: np.ndarray, blocks: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        total, pieces = np.add.reduceat(n, first), -(-size // LIST)
        at = np.repeat(first - LIST * (np.cumsum(pieces) - pieces), pieces) + LIST * np.arange(pieces.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)).astype(np.int32)), pa.array(blocks))
        lead = np.zeros(len(at), dtype=bool)
        lead[np.cumsum(pieces) - pieces] = True
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.repeat(total, pieces)), pa.array(lead), lists], names=["key", "n", "lead", "blocks"])

    ordered = asked.select("key", "block", "n").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, n long, lead boolean, blocks array<int>")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5: Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the KT block probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Decision nodes of the contexts of one depth: counts, KT and weighted probabilities.

    ``of`` gives each gram's eight nodes; ``context`` and ``node`` identify a node.
    """

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        steps = np.arange(8)
        place = (1 << steps) | (symbol[:, None] >> (8 - steps))
        self.bit = (symbol[:, None] >> (7 - steps)) & 1
        code, of = np.unique((context[:, None] * 256 + place).ravel(), return_inverse=True)
        self.of, self.context, self.node = of.reshape(-1, 8), code // 256, code % 256
        weight = np.repeat(n, 8).astype(float)
        one = np.bincount(self.of.ravel(), weight * self.bit.ravel(), len(code))
        self.n1, self.n0 = one, np.bincount(self.of.ravel(), weight, len(code)) - one

    def weigh(self, below: np.ndarray | None) -> None:
        """Weighted log probability, and the share of the node's own estimate; below: the children's sum."""
        self.log_e = kt_log(self.n0, self.n1)
        if below is None:
            self.log_w, self.own = self.log_e, np.ones(len(self.log_e))
        else:
            self.log_w = np.logaddexp(self.log_e, below) - np.log(2)
            self.own = 1 / (1 + np.exp(np.clip(below - self.log_e, -700, 700)))

    def probability(self) -> np.ndarray:
        """KT probability of each gram's eight bits at these contexts."""
        one = ((self.n1 + 0.5) / (self.n0 + self.n1 + 1.0))[self.of]
        return np.where(self.bit == 1, one, 1 - one)

    def seen(self) -> np.ndarray:
        return (self.n0 + self.n1 > 0)[self.of]


def _deepest(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of depth UPPER + 1 to DEPTH, weighted, for whole groups of their shallowest context."""
    symbol = keys & 255
    levels: list[Level] = []
    below: Level | None = None
    for depth in range(DEPTH, UPPER, -1):
        _, context = np.unique((keys >> 8) & ((1 << (8 * depth)) - 1), return_inverse=True)
        level = Level(context, symbol, n)
        if below is None:
            level.weigh(None)
        else:
            parent = np.empty(len(below.log_w), dtype=np.int64)
            parent[below.of.ravel()] = level.of.ravel()
            level.weigh(np.bincount(parent, below.log_w, len(level.n0)))
        levels.append(level)
        below = level
    return levels[::-1]


def _upper_codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node codes (context of depth UPPER times 256, and the node) of each gram's eight decisions, and their bits."""
    steps = np.arange(8)
    symbol = (keys & 255)[:, None]
    context = (keys >> 8) & ((1 << (8 * UPPER)) - 1)
    return context[:, None] * 256 + ((1 << steps) | (symbol >> (8 - steps))), (symbol >> (7 - steps)) & 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups (``deep``), about CHUNK grams at once; no group has more than 65,536."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows > CHUNK:
            whole = pa.concat_tables(held).combine_chunks()
            group = whole.column("deep").to_numpy()
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
            if cut:
                yield whole.slice(0, cut)
            held, rows = [whole.slice(cut)], len(group) - cut
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def _ordered(rows: DataFrame, *within: str) -> DataFrame:
    """Rows in partitions of their context of depth UPPER, in order of it and of the context one byte deeper."""
    return rows.repartition("wide").sortWithinPartitions("wide", *within, "deep")


_WIDE, _DEEP = (f"shiftright(key, 8) & {(1 << (8 * d)) - 1}" for d in (UPPER, UPPER + 1))


def _nodes(sums: DataFrame) -> DataFrame:
    """code, n0, n1, share (of the node's own estimate), log_w from code, n0, n1, below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n0, n1, below = (b.column(c).to_numpy() for c in ("n0", "n1", "below"))
            log_e = kt_log(n0, n1)
            share = 1 / (1 + np.exp(np.clip(below - log_e, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("code"), b.column("n0"), b.column("n1"), pa.array(share), pa.array(np.logaddexp(log_e, below) - np.log(2))], names=["code", "n0", "n1", "share", "log_w"])

    return sums.mapInArrow(run, "code long, n0 double, n1 double, share double, log_w double")


def _parents(nodes: DataFrame, depth: int) -> DataFrame:
    """code, n0, n1, below of the nodes at ``depth``: sums over those one byte deeper."""
    code = F.expr(f"(shiftright(code, 8) & {(1 << (8 * depth)) - 1}) * 256 + (code & 255)")
    return nodes.groupBy(code.alias("code")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))


def _root(two: DataFrame) -> np.ndarray:
    """For depth 1 (256 x 256) and depth 0 (the same for every byte): each node's zeros, ones and share, as [depth, 3, 256, 256]."""
    found = _parents(two, 1).toPandas()  # 65,280 rows at most
    one = np.zeros((3, 256, 256))
    at = found["code"].to_numpy() // 256, found["code"].to_numpy() % 256
    for k, c in enumerate(("n0", "n1", "below")):
        one[k][at] = found[c]
    log_e = kt_log(one[0], one[1])
    log_w = np.logaddexp(log_e, one[2]) - np.log(2)
    one[2] = 1 / (1 + np.exp(np.clip(one[2] - log_e, -700, 700)))
    zero = np.stack([one[0].sum(axis=0), one[1].sum(axis=0), log_w.sum(axis=0)])
    zero[2] = 1 / (1 + np.exp(np.clip(zero[2] - kt_log(zero[0], zero[1]), -700, 700)))
    return np.stack([np.broadcast_to(zero[:, None, :], one.shape), one])


def _topped(three: DataFrame, two: DataFrame) -> DataFrame:
    """wide, node, top for each node of depth UPPER: what the shallower levels give to each bit, the weight that they leave, and its own estimate and share."""
    root = _root(two)
    outer = F.expr(f"(shiftright(code, 8) & {(1 << (8 * (UPPER - 1))) - 1}) * 256 + (code & 255)")
    both = three.select("code", "n0", "n1", "share", outer.alias("outer")).join(two.selectExpr("code AS outer", "n0 AS m0", "n1 AS m1", "share AS own"), "outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n0, n1, share, m0, m1, own = (b.column(c).to_numpy() for c in ("code", "n0", "n1", "share", "m0", "m1", "own"))
            last, node = (code >> 8) & 255, code & 255
            levels = [tuple(t[last, node] for t in root[d]) for d in (0, 1)] + [(m0, m1, own), (n0, n1, share)]
            bits, rest = [np.zeros(len(code)), np.zeros(len(code))], np.ones(len(code))
            for (a0, a1, weight), (b0, b1, _) in zip(levels[:-1], levels[1:], strict=True):
                # Where a deeper context has never been met, the estimate of the shorter one stands.
                mine = rest * np.where(b0 + b1 > 0, weight, 1.0)
                p = (a1 + 0.5) / (a0 + a1 + 1.0)
                bits = [bits[0] + mine * (1 - p), bits[1] + mine * p]
                rest = rest - mine
            cols = [pa.array(x) for x in (*bits, rest, (n1 + 0.5) / (n0 + n1 + 1.0), share)]
            top = pa.StructArray.from_arrays(cols, names=_TOP)
            yield pa.RecordBatch.from_arrays([pa.array(code >> 8), pa.array(node.astype(np.int32)), top], names=["wide", "node", "top"])

    return both.mapInArrow(run, f"wide long, node int, top {_TOP_TYPE}")


_TOP = ["zero", "one", "rest", "p", "share"]
_TOP_TYPE = "struct<" + ", ".join(f"{c}: double" for c in _TOP) + ">"


def _weighted(grams: DataFrame) -> DataFrame:
    """key, value: log10 probability of each gram's last byte after the others."""
    placed = grams.selectExpr("key", "n", f"{_WIDE} AS wide", f"{_DEEP} AS deep")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            keys, n = part.column("key").to_numpy(), part.column("n").to_numpy()
            level = _deepest(keys, n)[0]
            codes, bit = _upper_codes(keys)
            code, at = np.unique(codes.ravel(), return_inverse=True)
            weight = np.repeat(n, 8).astype(float)
            n1 = np.bincount(at, weight * bit.ravel(), len(code))
            parent = np.empty(len(level.log_w), dtype=np.int64)
            parent[level.of.ravel()] = at
            below = np.bincount(parent, level.log_w, len(code))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(at, weight, len(code)) - n1), pa.array(n1), pa.array(below)], names=["code", "n0", "n1", "below"])

    parts = _ordered(placed).select("key", "n", "deep").mapInArrow(summed, "code long, n0 double, n1 double, below double")
    three = stored(_nodes(parts.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])))
    two = stored(_nodes(_parents(three, UPPER - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tops = np.zeros(0, np.int64), np.zeros((5, 0))
        for part in _chunks(batches):
            wide, node = part.column("wide").to_numpy(), part.column("node")
            is_top = node.is_valid().to_numpy()
            if is_top.any():  # nodes come before the grams of their context; those of the last context stay for the next part
                some = part.filter(pa.array(is_top)).combine_chunks()
                code = some.column("wide").to_numpy() * 256 + some.column("node").to_numpy()
                values = np.stack([x.to_numpy() for x in some.column("top").combine_chunks().flatten()])
                known, tops = np.concatenate([known, code]), np.concatenate([tops, values], axis=1)
                order = np.argsort(known)
                known, tops = known[order], tops[:, order]
            if not is_top.all():
                rows = part.filter(pa.array(~is_top))
                keys = rows.column("key").to_numpy()
                levels = _deepest(keys, rows.column("n").to_numpy())
                mixed, seen = levels[-1].probability(), levels[-1].seen()
                for level in levels[-2::-1]:
                    own = np.where(seen, level.own[level.of], 1.0)
                    mixed = own * level.probability() + (1 - own) * mixed
                    seen = level.seen()
                codes, bit = _upper_codes(keys)
                zero, one, rest, p, share = tops[:, np.searchsorted(known, codes)]
                own = np.where(seen, share, 1.0)
                mixed = np.where(bit == 1, one, zero) + rest * (own * np.where(bit == 1, p, 1 - p) + (1 - own) * mixed)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(mixed).sum(axis=1))], names=["key", "value"])
            stay = known >> 8 == wide[-1]
            known, tops = known[stay], tops[:, stay]

    nodes = _topped(three, two).withColumns({"deep": F.lit(-1).cast("long"), "key": F.lit(None).cast("long"), "n": F.lit(None).cast("long"), "is_gram": F.lit(False)})
    both = nodes.unionByName(placed.withColumns({"node": F.lit(None).cast("int"), "top": F.lit(None).cast(_TOP_TYPE), "is_gram": F.lit(True)}))
    return _ordered(both, "is_gram").select("wide", "deep", "key", "n", "node", "top").mapInArrow(run, "key long, value double")


class _Answers:
    """Values of a block's grams and words."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if len(keys) and (not len(self.keys) or (self.keys[place] != keys).any()):
            raise RuntimeError("a block has rows that were not in it when it was counted: the table changes while it is read")
        return self.values[place]


def _gram_sums(keys: np.ndarray, off: np.ndarray, answers: _Answers) -> np.ndarray:
    """Sum of the values of each text's grams.  A gram has 48 bits, so it is sorted together with its text's index."""
    tagged = np.sort(keys | (grid.owners(off).astype(np.uint64) << _TAG))
    first = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]])) if len(tagged) else np.zeros(0, np.int64)
    times, pairs = np.diff(np.append(first, len(tagged))), tagged[first]
    value = answers.of((pairs & ((np.uint64(1) << _TAG) - np.uint64(1))).view(np.int64))
    return np.bincount((pairs >> _TAG).astype(np.int64), times * value, len(off) - 1)


def _scored(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_sum, score, n_bytes of every row.

    A block's answers come before its rows, which are then scored as they stream by.
    """

    def scored(docs: pa.RecordBatch, known: _Answers) -> pa.RecordBatch:
        t = grid.Texts(docs.column("_text"), fold=True)
        score = _gram_sums(*gram_keys(t), known)
        words, off = word_keys(t)
        distinct, which = np.unique(words.view(np.int64), return_inverse=True)
        count = known.of(distinct)[which]
        cols = [np.diff(off), grid.span_sums(count > 0, off), grid.span_sums(np.log10(count + SMOOTH), off), score, np.diff(t.off)]
        return pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("held_out"), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "score", "n_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, known = None, [], None
        for piece in grid.slices(batches, "_text"):
            block, is_doc = np.asarray(piece.column("block")), piece.column("held_out").is_valid().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((block[1:] != block[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(block)], strict=True):
                part = piece.slice(a, b - a)
                if block[a] != current:
                    current, parts, known = block[a], [], None
                if is_doc[a]:
                    if known is None:
                        keys, values = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
                        parts, known = [], _Answers(keys, values)
                    yield scored(part, known)
                else:
                    parts.append((part.column("key").to_numpy(), part.column("value").to_numpy()))

    kind = rows.schema["doc_id"].dataType
    empty = answers.select("block", "key", "value", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("_text"))
    asked = rows.select("block", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "doc_id", "held_out", "_text")
    both = empty.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("held_out").isNotNull())
    return both.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_sum double, score double, n_bytes long")


def context_tree_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    A-Z are lower-cased first.  ``score`` is the log10 probability of the text's bytes and its
    end under the context tree, and ``bits_per_byte`` their code length, divided by the bytes and the
    end; ``base_score`` is the log10 probability of its words and end under smoothed word
    frequencies.  A null text counts as empty (its end alone is scored).  Without training
    rows every decision has probability 1/2 and no word is known.  Texts of any length are
    read whole.  Repeated rows give repeated results, a null doc_id stays null (and counts as
    the empty text in the split), an empty table gives an empty result; extra columns are ignored.
    """
    rows = _blocked(docs, text)
    table = stored(_folded(_asked(rows)))
    words = table.where("key < 0")
    n, v = words.where("lead").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    values = stored(_weighted(table.where("key >= 0 and lead")))
    known = words.select("key", F.col("n").cast("double").alias("value"), "blocks").unionByName(table.where("key >= 0").join(values, "key").select("key", "value", "blocks"))
    answers = known.select(F.explode("blocks").alias("block"), "key", "value")
    size = F.lit(float(np.log10(n + SMOOTH * (v + 1))))
    return _scored(rows, answers).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * size).alias("base_score"), "score",
        "n_bytes", (F.col("score") * F.lit(-float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
