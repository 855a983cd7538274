"""Statistics of all pairs of symbols by block Gram matrices.

A symbol's rows are one array; symbols are dealt into blocks of bounded size, and two blocks meet in
one task, where matrix products give the sums of products of all their pairs at once.  So a
symbol is sent once for every partner block, and no row is made for a pair and bar.  Symbols of a group with equal
bars are one class (copies()), of which only the smallest is sent: their pairs have the same statistics.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of a block, on average at most.
BLOCK = 64


def copies(bars: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, symbol, first, last, members: each symbol's class, the symbols of its group (symbol, grp) with equal (dt, close) rows: the smallest and the largest of them, and their number."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("dt"), F.col("close"))))
    keys = bars.groupBy("symbol").agg(F.sha2(listed.cast("string"), 256).alias("_key"))
    w = Window.partitionBy("grp", "_key")
    x = keys.join(groups.select("symbol", F.col("grp").cast("string").alias("grp")).distinct(), "symbol")
    return x.select("grp", "symbol", F.min("symbol").over(w).alias("first"), F.max("symbol").over(w).alias("last"), F.count(F.lit(1)).over(w).alias("members"))


def _arrays(panel: DataFrame, value: str) -> DataFrame:
    """symbol, first, v: the rows of each symbol as one array from its row ``first`` on (panel rows have no gaps; a missing value is NaN)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(math.nan)).alias("v"))))
    x = panel.groupBy("symbol").agg(listed.alias("_l"))
    return x.select("symbol", F.col("_l")[0]["i"].alias("first"), F.transform("_l", lambda r: r["v"]).alias("v"))


def _met(arrays: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """grp, i, j, k, symbol, last, first, v: every two blocks of a group's symbols, each pair of blocks one group of rows."""
    last = F.col("last") if "last" in groups.columns else F.col("symbol")
    x = arrays.join(groups.select("symbol", "grp", last.alias("last")).distinct(), "symbol")
    sizes = x.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    x = x.join(sizes, "grp").withColumn("_k", F.pmod(F.xxhash64("symbol"), F.col("_blocks")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return x.select("grp", F.least("_k", "_o").alias("i"), F.greatest("_k", "_o").alias("j"), F.col("_k").alias("k"), "symbol", "last", "first", "v")


def _matrix(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, symbols) values from the common first row on, NaN where a symbol has none, and the symbols' names in order."""
    rows = sorted(rows, key=lambda r: r["symbol"])
    begin, end = min(r["first"] for r in rows), max(r["first"] + len(r["v"]) for r in rows)
    out = np.full((end - begin, len(rows)), np.nan)
    for k, r in enumerate(rows):
        out[r["first"] - begin : r["first"] - begin + len(r["v"]), k] = r["v"]
    return out, np.array([r["symbol"] for r in rows], dtype=object)


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Values and names of all symbols of two blocks, the pairs that belong to them (a before the last of b's class; without classes, a < b), and the first row."""
    rows = table.to_pylist()
    values, names = _matrix(rows)
    of = {r["symbol"]: r["k"] for r in rows}
    block = np.array([of[s] for s in names])
    a, b = np.triu_indices(len(names), 1)
    mine = (block[a] != block[b]) if rows[0]["i"] != rows[0]["j"] else np.ones(len(a), bool)
    a, b = a[mine], b[mine]
    last = {r["symbol"]: r["last"] for r in rows}
    back = names[b] < np.array([last[s] for s in names], dtype=object)[a]  # a pair of their copies has the other order
    a, b = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
    return values, names, a, b, min(r["first"] for r in rows)


def pair_statistics(panel: DataFrame, groups: DataFrame, value: str = "px", least: int = 60, block: int = BLOCK) -> DataFrame:
    """grp, a, b, n, beta, alpha, adf_t, half_life of all pairs a < b of a group's symbols (symbol, grp) over the panel (symbol, idx, value).

    beta and alpha are least squares of a on b over the rows that both have; adf_t is the t of the residual's lagged level in
    its difference on 1, the level and the lagged difference; half_life is -ln 2 over the slope of the difference on the
    level, infinite where that isn't negative.  With a column ``last`` in ``groups`` (of copies()) symbols stand for classes, and a pair
    comes in each order that members of the two have.  A symbol has every row from its first on, as in a padded panel.  Pairs
    of fewer than ``least`` rows, or whose b doesn't vary, are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        x, names, a, b, _ = _pairs(table.combine_chunks())
        there = np.isfinite(x)
        x = np.where(there, x - np.nanmean(np.where(there, x, np.nan), axis=0), 0.0)  # a constant less leaves all but alpha; it keeps sums small
        centre = np.array([np.mean(np.array(r["v"])[np.isfinite(r["v"])]) for r in sorted(table.to_pylist(), key=lambda r: r["symbol"])])
        m = there.astype(float)
        n, s = m.T @ m, x.T @ m  # s[p, q]: sum of p over the rows that p and q have
        xx, xy = (x * x).T @ m, x.T @ x
        na, sa, sb = n[a, b], s[a, b], s[b, a]
        vb = xx[b, a] - sb * sb / np.maximum(na, 1)
        ok = (na >= least) & (vb > 1e-12 * np.maximum(xx[b, a], 1e-300))
        a, b, na, sa, sb, vb = (v[ok] for v in (a, b, na, sa, sb, vb))
        beta = (xy[a, b] - sa * sb / na) / vb
        alpha = (sa - beta * sb) / na + centre[a] - beta * centre[b]
        # Per symbol: level before the row, difference, difference before; sums of products of any two of them, over rows on which both symbols have them.
        lag1, lag2 = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([np.zeros((2, x.shape[1])), x[:-2]])
        had1 = np.vstack([np.zeros((1, x.shape[1])), m[:-1]]) * m
        had2 = np.vstack([np.zeros((2, x.shape[1])), m[:-2]]) * had1

        def moments(mask: np.ndarray, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Rows, and centred sums of products (terms, terms, pairs) of the residual's terms: those of a less beta times those of b."""
            terms = [t * mask for t in terms]
            rows = (mask.T @ mask)[a, b]
            one = np.stack([(t.T @ mask)[a, b] - beta * (t.T @ mask)[b, a] for t in terms])
            two = np.empty((len(terms), len(terms), len(a)))
            for p, t in enumerate(terms):
                for q, u in enumerate(terms):
                    cross, own = t.T @ u, (t * u).T @ mask
                    two[p, q] = own[a, b] - beta * (cross[a, b] + cross[b, a]) + beta * beta * own[b, a]
            return rows, two - one[:, None] * one[None] / np.maximum(rows, 1)

        with np.errstate(all="ignore"):
            rows, c = moments(had2, [lag1, x - lag1, lag1 - lag2])
            d = c[0, 0] * c[2, 2] - c[0, 2] ** 2
            b1, b2 = (c[0, 1] * c[2, 2] - c[2, 1] * c[0, 2]) / d, (c[2, 1] * c[0, 0] - c[0, 1] * c[0, 2]) / d
            adf = b1 / np.sqrt((c[1, 1] - b1 * c[0, 1] - b2 * c[2, 1]) / (rows - 3) * c[2, 2] / d)
            _, h = moments(had1, [lag1, x - lag1])
            theta = h[0, 1] / h[0, 0]
            half = np.where(theta < 0, -math.log(2) / theta, np.inf)
        number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
        grp = table.column("grp")[0].as_py()
        return pa.table({"grp": pa.array([grp] * len(a), pa.string()), "a": pa.array(names[a], pa.string()), "b": pa.array(names[b], pa.string()), "n": pa.array(na.astype(np.int64)),
                         "beta": number(beta), "alpha": number(alpha), "adf_t": number(adf), "half_life": number(half)})

    known = _met(_arrays(panel, value), groups.withColumn("grp", F.col("grp").cast("string")), block)
    return known.groupBy("grp", "i", "j").applyInArrow(run, "grp string, a string, b string, n long, beta double, alpha double, adf_t double, half_life double")


def is_cointegrated(columns, critical: float = -3.34, shortest: float = 5, longest: float = 252):
    """Whether a residual rejects a unit root, with a positive hedge ratio and a half-life in range: of Spark columns or arrays by name."""
    return (columns["adf_t"] < critical) & (columns["beta"] > 0) & (columns["half_life"] >= shortest) & (columns["half_life"] <= longest)


def cointegrated(statistics: DataFrame, critical: float = -3.34, shortest: float = 5, longest: float = 252) -> DataFrame:
    """Pairs of pair_statistics() that is_cointegrated() accepts."""
    return statistics.where(is_cointegrated(statistics, critical, shortest, longest))


def block_covariances(panel: DataFrame, marks: list[int], n: int = 63, year: int = 252, groups: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """mark, a, b, cov: annual covariance of each pair a <= b over the n rows up to each mark, where both have all n returns.

    ``marks`` are rows of the calendar; ``groups`` (symbol, grp) limits the pairs to those of a group.
    """
    one = panel.select("symbol").distinct().withColumn("grp", F.lit("")) if groups is None else groups.select("symbol", F.col("grp").cast("string").alias("grp"))

    def run(table: pa.Table) -> pa.Table:
        x, names, a, b, begin = _pairs(table.combine_chunks())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i == j:
            a, b = np.triu_indices(len(names))
        out = []
        for mark in marks:
            lo, hi = mark - n + 1 - begin, mark + 1 - begin
            if lo < 0 or hi > len(x):
                continue
            w = x[lo:hi]
            whole = np.isfinite(w).all(axis=0)
            w = np.where(whole, w, 0.0)
            w = w - w.mean(axis=0)
            cov = w.T @ w * (year / (n - 1))
            ok = whole[a] & whole[b]
            out.append((np.full(ok.sum(), mark), names[a[ok]], names[b[ok]], cov[a[ok], b[ok]]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, object), np.zeros(0)]
        return pa.table({"mark": pa.array(cols[0], pa.int64()), "a": pa.array(cols[1], pa.string()), "b": pa.array(cols[2], pa.string()), "cov": pa.array(cols[3], pa.float64())})

    known = _met(_arrays(panel, "ret"), one, block)
    return known.groupBy("grp", "i", "j").applyInArrow(run, "mark long, a string, b string, cov double")
