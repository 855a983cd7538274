"""Operator 13: prefix trie of conversations from adaptive radix trees over turn ids.

A turn's id is 16 bytes of the sha256 of its role and text, big-endian as it stands, so a
conversation is a byte string of fixed-width ids.  Every task inserts its share into a radix
tree and gives the tree's turn-aligned prefixes with their members' number and least id; equal
prefixes of different tasks meet in one grouped sum.  A hot conversation or first turn is one
row a task there.  Long conversations go in segments of SEGMENT turns, each under the digest of
what stands before it.  The digest of a prefix is the sum of hashes of (position, turn id)
modulo 2^128, so that segments are summed up independently of each other.  Sums over subtrees
double the distance to an ancestor each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm.radix_tree import RadixTree
from asofspark.llm.storage import discard, stored

ID_BYTES = 16
#: Turns of a segment.
SEGMENT = 128
#: Bytes of a task's tree, about; a full tree is given out and a new one begun.
TREE_BYTES = 16 << 20
#: Ids of members that are joined into one row before they are hashed in order.
CHUNK = 8192
_WHOLE = (1 << 128) - 1


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``at`` (0, 1, ...): the row's place in the order of its key's rows; ``key`` is the first column, a long.

    Rows are sorted over ranges of key and order, so that a hot key is many tasks' work.  Places count within a task;
    for keys that go on in further tasks (at most one a border), the counts of their earlier tasks are added.
    """
    assert rows.columns[0] == key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = np.asarray(batch.column(0), dtype=np.int64)
            if not len(keys):
                continue
            new = np.ones(len(keys), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = last is None or keys[0] != last
            run_of = np.cumsum(new)
            begin = np.concatenate([[-seen], np.flatnonzero(new)])  # run 0 goes on from the batch before
            at = np.arange(len(keys)) - begin[run_of]
            last, seen = keys[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(len(keys), task), pa.int32())], names=[*batch.schema.names, "at", "_task"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stored(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, at long, _task int"))
    parts = placed.groupBy(key, "_task").agg(F.count(F.lit(1)).alias("_n"))
    tasks = Window.partitionBy(key).orderBy("_task")
    before = parts.withColumn("_before", F.sum("_n").over(tasks.rowsBetween(Window.unboundedPreceding, -1))).where("_before > 0")
    return placed.join(F.broadcast(before.drop("_n")), [key, "_task"], "left").withColumn("at", F.col("at") + F.coalesce("_before", F.lit(0))).drop("_task", "_before")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, chars) of every row with a conv_id; a null role or text becomes empty.  Texts go no further than this."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    tid = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES))
    chosen = conversations.where("conv_id is not null")
    return chosen.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), tid.alias("tid"), F.length(text).cast("long").alias("chars"))


def rebuilt(conversations: DataFrame, block: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, tid, chars) of all rebuilt turns, depth from 1 on; and (conv_id, own) of all conversations.

    Conversation c begins with the first h turns of conversation c - c % block, h = crc32(c) % shared, and goes on with
    its own turns after the first h.  Equal turn numbers are ordered by the turns' ids, repeated rows are turns of their own.
    """
    placed = stored(numbered(turns(conversations), "conv_id", "turn", "tid").select("conv_id", "at", "tid", "chars"))
    skip: Column = F.crc32(F.col("conv_id").cast("string")) % shared
    base: Column = F.col("conv_id") - F.col("conv_id") % block
    known = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = placed.where((F.col("at") < shared - 1) & (F.col("conv_id") == base)).select(F.col("conv_id").alias("base"), "at", "tid", "chars")
    first = known.select("conv_id", skip.alias("h"), base.alias("base")).join(heads, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "tid", "chars")
    short = known.where((F.col("conv_id") == base) & (F.col("own") < shared - 1)).select(F.col("conv_id").alias("base"), F.col("own").alias("_given"))
    absent = known.select(base.alias("base")).distinct().join(known.select(F.col("conv_id").alias("base")), "base", "left_anti").withColumn("_given", F.lit(0).cast("long"))
    rest = placed.withColumn("h", skip).where("at >= h").withColumn("base", base).join(short.unionByName(absent), "base", "left")
    depth = F.col("at") - F.col("h") + F.least("h", F.coalesce("_given", F.lit(shared).cast("long"))) + 1
    return first.unionByName(rest.select("conv_id", depth.alias("depth"), "tid", "chars")), known


def _hash(depth: int, tid: bytes) -> int:
    return int.from_bytes(hashlib.sha256(depth.to_bytes(8, "big") + tid).digest()[:16], "big")


def segments(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, seg, before, key, chars, last): the ids of up to SEGMENT turns, and the digest of all turns before them (null: none)."""
    seg = ((F.col("depth") - 1) / SEGMENT).cast("long")
    packed = rows.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("depth", "tid", "chars"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chars, sums = [], [], []
            for begin, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = [t["tid"] for t in listed]
                keys.append(b"".join(ids))
                chars.append([t["chars"] for t in listed])
                total = sum(_hash(begin * SEGMENT + k, i) for k, i in enumerate(ids, 1)) & _WHOLE
                sums.append([total >> shift & 0xFFFFFFFF for shift in (96, 64, 32, 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(chars, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))], names=["conv_id", "seg", "key", "chars", "limbs"])

    cut = stored(packed.mapInArrow(run, "conv_id long, seg long, key binary, chars array<long>, limbs array<long>"))
    along = Window.partitionBy("conv_id").orderBy("seg")  # one row for SEGMENT turns
    before = F.array(*(F.sum(F.col("limbs")[k]).over(along.rowsBetween(Window.unboundedPreceding, -1)) for k in range(4)))
    linked = cut.select("conv_id", "seg", F.when(F.col("seg") > 0, before).alias("before"), F.lead("seg").over(along).isNull().alias("last"))
    without = known.select("conv_id").join(cut.where("seg = 0").select("conv_id"), "conv_id", "left_anti")
    empty = without.selectExpr("conv_id", "0L as seg", "cast(null as array<long>) as before", "cast('' as binary) as key", "cast(array() as array<long>) as chars", "true as last")
    return cut.drop("limbs").join(linked, ["conv_id", "seg"]).select("conv_id", "seg", "before", "key", "chars", "last").unionByName(empty)


def shared_prefixes(parts: DataFrame) -> DataFrame:
    """(node, depth, up, n_convs, least, chars, ends) by task: a node's digest, its parent's, members and the last text's length.

    Rows with ``ends`` name a conversation (in least) whose last turn is the node's; the others sum up over tasks.
    """

    def given(tree: RadixTree, chars: dict[bytes, int], stops: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        digests: dict[bytes, int] = {}
        rows: list[tuple] = []
        for prefix, n, least in tree.prefixes(ID_BYTES):
            if len(prefix) < 2 * ID_BYTES:
                continue
            seg = int.from_bytes(prefix[:ID_BYTES], "big")
            depth = seg * SEGMENT + len(prefix) // ID_BYTES - 2
            if len(prefix) == 2 * ID_BYTES:
                digests[prefix] = int.from_bytes(prefix[ID_BYTES:], "big")
                if seg == 0:
                    rows.append((prefix[ID_BYTES:], 0, None, n, least, 0, False))
                continue
            up, tid = digests[prefix[:-ID_BYTES]], prefix[-ID_BYTES:]
            digests[prefix] = mine = (up + _hash(depth, tid)) & _WHOLE
            rows.append((mine.to_bytes(16, "big"), depth, up.to_bytes(16, "big"), n, least, chars[tid], False))
        rows.extend((digests[key].to_bytes(16, "big"), int.from_bytes(key[:ID_BYTES], "big") * SEGMENT + len(key) // ID_BYTES - 2, None, 0, conv, 0, True) for conv, key in stops)
        names = ["node", "depth", "up", "n_convs", "least", "chars", "ends"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for a in range(0, len(rows), 16_384):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[a : a + 16_384], strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, chars, stops = RadixTree(), {}, []
        for batch in batches:
            for row in batch.to_pylist():
                limbs = row["before"] or (0, 0, 0, 0)
                start = sum(limb << shift for limb, shift in zip(limbs, (96, 64, 32, 0), strict=True)) & _WHOLE
                key = row["seg"].to_bytes(ID_BYTES, "big") + start.to_bytes(ID_BYTES, "big") + row["key"]
                tree.insert(key, row["conv_id"])
                chars.update((row["key"][k * ID_BYTES : (k + 1) * ID_BYTES], n) for k, n in enumerate(row["chars"]))
                if row["last"]:
                    stops.append((row["conv_id"], key))
                if tree.bytes > TREE_BYTES:
                    yield from given(tree, chars, stops)
                    tree, chars, stops = RadixTree(), {}, []
        yield from given(tree, chars, stops)

    return parts.mapInArrow(run, "node binary, depth long, up binary, n_convs long, least long, chars long, ends boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the sha256 of the members' ids in ascending order, joined by commas.

    Ids are sorted over ranges of node and id, so a hot node's are many tasks' work, and joined into rows of CHUNK; a
    hash runs through a node's rows one after the other and keeps nothing but its state.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            rows = []
            while at < len(nodes):
                to = at + 1
                while to < len(nodes) and to - at < CHUNK and nodes[to] == nodes[at]:
                    to += 1
                rows.append((nodes[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["node", "ends_sha256"])
                done = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    chunks = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """(node, values): each value summed over the node and all below it; ``nodes`` has node, up (null at the root), depth.

    Round k adds to a node what its descendants 2^k levels down have gathered so far, and doubles the distance: the
    rounds grow with the logarithm of the depth.
    """
    state = stored(nodes.select("node", F.col("up").alias("far"), *values))
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(levels).bit_length()):
        reaching = state.where("far is not null")
        below = reaching.groupBy(F.col("far").alias("node")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        further = reaching.select("node", "far").join(state.select(F.col("node").alias("far"), F.col("far").alias("_further")), "far").select("node", F.col("_further"))
        after = state.drop("far").join(below, "node", "left").join(further, "node", "left")
        new = stored(after.select("node", F.col("_further").alias("far"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)))
        discard(state)
        state = new
    return state.drop("far")


def conversation_trie(conversations: DataFrame, block: int = 100, shared: int = 6) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``).

    node and parent (digests), conv_id (its smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  A null role or text counts as empty, a null turn comes first; a row without
    conv_id belongs to no conversation and is left out.  Ties in turn go by the turns' ids (a hash of role and text), repeated rows are
    turns of their own; texts of any length enter as a hash; without conversations there is no node, not even the root; extra
    columns are ignored.
    """
    rows, known = rebuilt(conversations, block, shared)
    shares = stored(shared_prefixes(segments(rows, known)))
    nodes = shares.where("not ends").groupBy("node").agg(F.min("depth").alias("depth"), F.min("up").alias("up"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("conv_id"), F.max("chars").alias("chars"))
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = stored(counted.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")))
    sums = subtree_sums(counted, "n_leaves", "saved_tokens")
    digests = end_digests(shares.where("ends").select("node", F.col("least").alias("conv_id")))
    parents = counted.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    whole = counted.drop("n_leaves", "saved_tokens", "chars").join(sums, "node").join(digests, "node", "left").join(parents, "up", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "node", F.col("up").alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
