"""Operator 11: exact k-means over a vector-approximation file.

Vectors become integers, and their approximations a few bits a component: the cell of a
component between fixed edges.  Tables looked up by component, cell and centroid give an
interval of the squared distance to every centroid (less that to the centroids' mean, which
is the same for all).  Where one centroid's upper bound lies under all other lower bounds,
the approximation decides; whole vectors are fetched only where intervals overlap or where the
decision differs from the round before, and only their differences enter the sums.  So a round
reads the approximations (56 bytes for 64 components) and joins the vectors that it needs from
a table bucketed by row, which isn't shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.llm.storage import bucketed, shared_dir

#: Bits of a cell's number.
BITS = 7
#: Vectors whose quantiles give the edges of cells (at most; the edges steer effort only, results are exact).
EDGE_SAMPLE = 20_000
#: Vectors of a bucket of the table, about, and its buckets at least and at most.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 250_000, 8, 16_384
#: Components are at most this large, so that a squared distance of up to 64 of them fits in a long.
LARGEST = 1 << 27
#: Vectors that are compared at once.
AT_ONCE = 4096


def integers(column: pa.Array, scale: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold ``size`` finite components, and floor(scale * x) of those."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten()
    whole = np.ones(len(flat), dtype=bool) if not flat.null_count else np.asarray(flat.is_valid())
    x = np.asarray(flat.fill_null(0), dtype=np.float64).reshape(len(rows), size)
    ok = np.isfinite(x).all(axis=1) & whole.reshape(len(rows), size).all(axis=1)
    q = np.floor(x[ok] * scale)
    if len(q) and np.abs(q).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}: squared distances don't fit in a long")
    return rows[ok], q.astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller one) and squared distance of each integer vector."""
    best, least = np.zeros(len(q), np.int64), np.full(len(q), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        d = ((q - c) ** 2).sum(axis=1)
        better = d < least
        best[better], least[better] = k, d[better]
    return best, least


def packed(cells: np.ndarray, bits: int) -> np.ndarray:
    """(vectors, bytes): the cells' numbers, ``bits`` each, one after the other."""
    shifts = np.arange(bits, dtype=np.uint8)
    return np.packbits(((cells[:, :, None] >> shifts) & 1).reshape(len(cells), -1), axis=1)


def unpacked(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    shifts = np.arange(bits, dtype=np.uint8)
    return (np.unpackbits(data, axis=1, count=size * bits).reshape(len(data), size, bits) << shifts).sum(axis=2, dtype=np.uint8)


class Cells:
    """Edges of each component's cells; cell j holds the integers from lows[j] to highs[j]."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        n = 1 << bits
        cuts = np.quantile(sample, np.linspace(0, 1, n + 1)[1:-1], axis=0).T.astype(np.int64)  # (components, n - 1)
        self.bits, self.cuts = bits, np.clip(cuts, low[:, None], high[:, None])
        self.lows = np.concatenate([low[:, None], self.cuts + 1], axis=1)
        self.highs = np.concatenate([self.cuts, high[:, None]], axis=1)

    def of(self, q: np.ndarray) -> np.ndarray:
        """Cell of every component: the number of edges below it."""
        return np.stack([np.searchsorted(cut, q[:, d], "left") for d, cut in enumerate(self.cuts)], 1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(components, cells, centroids) least and largest value of (x - c)^2 - (x - m)^2 over a cell's integers x.

        m is the centroids' rounded mean.  Its distance is the same for all centroids, so that the intervals of the
        differences overlap only where those of distances do, but they are as narrow as c is near to m, not to x.
        The difference is linear in x: its extremes are at a cell's ends.
        """
        c, m = centroids.T[:, None, :], np.round(centroids.mean(axis=0)).astype(np.int64)[:, None, None]
        ends = [(x[:, :, None] - c) ** 2 - (x[:, :, None] - m) ** 2 for x in (self.lows, self.highs)]
        return np.minimum(*ends), np.maximum(*ends)

    def decided(self, cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The centroid that is nearest whatever the vectors' exact components are, or -1."""
        out = np.empty(len(cells), np.int64)
        for a in range(0, len(cells), AT_ONCE):
            part = cells[a : a + AT_ONCE]
            least, most = (np.zeros((len(part), table.shape[2]), np.int64) for table in tables)
            for d in range(part.shape[1]):
                least += tables[0][d][part[:, d]]
                most += tables[1][d][part[:, d]]
            k = most.argmin(axis=1)
            rows = np.arange(len(part))
            bound = most[rows, k]
            least[rows, k] = np.iinfo(np.int64).max
            out[a : a + AT_ONCE] = np.where(bound < least.min(axis=1), k, -1) if least.shape[1] > 1 else k
        return out


def _lists(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), size)


class VectorFile:
    """Two tables: approximations (rid, cells), and whole integer vectors bucketed by rid."""

    def __init__(self, vectors: DataFrame, id_col: str, vector: str, size: int, scale: int, bits: int):
        spark = vectors.sparkSession
        self.spark, self.size, self.bits = spark, size, bits
        self.id_type = vectors.schema[id_col].dataType.simpleString()
        root = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        self._write_integers(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v")), f"{root}/plain", scale)
        plain = spark.read.schema(f"rid long, vec_id {self.id_type}, q array<int>").parquet(f"{root}/plain")
        self.count, low, high = self._range(plain)
        self.buckets = int(min(MAX_BUCKETS, max(MIN_BUCKETS, self.count // BUCKET_ROWS)))
        self.cells = self._edges(plain, low, high) if self.count else None
        self.full = bucketed(plain, "rid", self.buckets)  # joins on rid don't shuffle it
        self.plain = plain
        if self.cells is not None:
            self._write_cells(plain, f"{root}/cells")
        self.near = spark.read.schema("rid long, cells binary").parquet(f"{root}/cells") if self.cells is not None else None

    def _write_integers(self, vectors: DataFrame, path: str, scale: int) -> None:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, q = integers(batch.column(1), scale, size)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(q.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["vec_id", "q"])

        kept = vectors.mapInArrow(run, f"vec_id {self.id_type}, q array<int>")
        kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "q").write.parquet(path)  # numbers are fixed from here on

    def _range(self, plain: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of vectors, and least and largest integer of each component, from one row a batch."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = _lists(batch.column(0), size)
                    yield pa.RecordBatch.from_pydict({"n": [len(q)] * size, "d": np.arange(size), "lo": q.min(axis=0), "hi": q.max(axis=0)})

        found = plain.select("q").mapInArrow(run, "n long, d long, lo long, hi long").groupBy("d").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rows = sorted(found.collect())  # one row a component
        return (rows[0]["n"] if rows else 0), np.array([r["lo"] for r in rows], np.int64), np.array([r["hi"] for r in rows], np.int64)

    def _edges(self, plain: DataFrame, low: np.ndarray, high: np.ndarray) -> Cells:
        sample = plain.select("q", F.xxhash64("rid").alias("h")).orderBy("h").limit(EDGE_SAMPLE).collect()
        return Cells(np.array([r["q"] for r in sample], np.int64), low, high, self.bits)

    def _write_cells(self, plain: DataFrame, path: str) -> None:
        cells, size, bits = self.cells, self.size, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = packed(cells.of(_lists(batch.column(1), size)), bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in data], pa.binary())], names=["rid", "cells"])

        plain.select("rid", "q").mapInArrow(run, "rid long, cells binary").write.parquet(path)

    def first(self, k: int, salt: str) -> np.ndarray:
        """The k vectors with the smallest sha256 of salt and id (equal hashes: by components), fewer if there are fewer."""
        key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        rows = self.plain.select("q", key.alias("h")).orderBy("h", "q").limit(k).collect()
        return np.array([r["q"] for r in rows], np.int64).reshape(len(rows), self.size)

    def _decisions(self, before: np.ndarray | None, now: np.ndarray, changed_only: bool) -> DataFrame:
        """(rid, old, new) by the approximations, -1 where intervals overlap; with changed_only without rows that stay where they are."""
        cells, size, bits = self.cells, self.size, self.bits
        tables = [None if c is None else cells.tables(c) for c in (before, now)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                mine = unpacked(data, size, bits)
                old, new = (np.full(len(mine), -1) if t is None else cells.decided(mine, t) for t in tables)
                rows = np.flatnonzero((old < 0) | (old != new)) if changed_only else np.arange(len(mine))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(old[rows], pa.int32()), pa.array(new[rows], pa.int32())], names=["rid", "old", "new"])

        return self.near.mapInArrow(run, "rid long, old int, new int")

    def moved(self, before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By centroid: how its number of vectors and their sum change from the assignment to ``before`` (None: no assignment) to that to ``now``."""
        size, k = self.size, len(now)
        source = self.plain.select("q", F.lit(-1).alias("old"), F.lit(-1).alias("new")) if before is None else self.full.join(self._decisions(before, now, True), "rid").select("q", "old", "new")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _lists(batch.column(0), size)
                change = np.zeros((k, size + 1), np.int64)
                for sign, known, centroids in ((-1, batch.column(1), before), (1, batch.column(2), now)):
                    if centroids is None:
                        continue
                    at = np.array(known, np.int64)
                    open_rows = np.flatnonzero(at < 0)
                    at[open_rows] = nearest(q[open_rows], centroids)[0]
                    for c in np.unique(at):
                        mine = q[at == c]
                        change[c] += sign * np.concatenate([[len(mine)], mine.sum(axis=0)])
                c, d = np.nonzero(change)
                yield pa.RecordBatch.from_pydict({"c": c, "d": d, "v": change[c, d]})

        total = source.mapInArrow(run, "c long, d long, v long").groupBy("c", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        out = np.zeros((k, size + 1), dtype=object)
        for row in total.collect():  # k * (size + 1) rows at most
            out[row["c"], row["d"]] = int(row["v"])
        return out[:, 0], out[:, 1:]

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""
        size = self.size
        source = self.full.join(self._decisions(None, centroids, False).select("rid", "new"), "rid").select("vec_id", "q", "new")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, at = _lists(batch.column(1), size), np.array(batch.column(2), np.int64)
                open_rows = np.flatnonzero(at < 0)
                at[open_rows] = nearest(q[open_rows], centroids)[0]
                distance = ((q - centroids[at]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

        return source.mapInArrow(run, f"vec_id {self.id_type}, cluster int, distance long")


def vector_clusters(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:", bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of ``size`` components, none null or not finite; a null vector or one of another length is left
    out.  A null id counts as the empty text in the choice of first centroids and is kept; equal hashes are ordered by
    components, so repeated rows may give equal centroids, of which the smaller number takes all.  With fewer than k
    vectors there are as many centroids, without any the result is empty.  A component beyond LARGEST / scale is an
    error.  Extra columns are ignored.
    """
    file = VectorFile(vectors, id_col, vector, size, scale, bits)
    if not file.count:
        return vectors.sparkSession.createDataFrame([], f"vec_id {file.id_type}, cluster int, distance long"), np.zeros((0, size), np.int64)
    before, now = None, file.first(k, salt)
    counts, sums = np.zeros(len(now), dtype=object), np.zeros((len(now), size), dtype=object)
    for _ in range(rounds):
        n, s = file.moved(before, now)
        counts, sums = counts + n, sums + s
        after = np.array([sums[c] // counts[c] if counts[c] else now[c] for c in range(len(now))], dtype=np.int64).reshape(now.shape)
        before, now = now, after
    return file.assigned(now), now


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia and inertia (sums of distance) and centroid_sha256 (of the components, joined by commas)."""
    spark = assigned.sparkSession
    digests = [(c, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    names = spark.createDataFrame(digests, T.StructType.fromDDL("cluster int, centroid_sha256 string"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    per_cluster = assigned.groupBy("cluster").agg(exact("distance").alias("_c"))
    total = per_cluster.agg(exact("_c").cast("long").alias("inertia"))
    known = per_cluster.select("cluster", F.col("_c").cast("long").alias("cluster_inertia")).join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))  # one row a centroid; total is one row
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
