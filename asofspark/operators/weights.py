"""Portfolio weights: dated tables (run_id, dt, symbol, w); a rebalance without rows is all cash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inverse_vol_weights(signals: DataFrame, by: tuple[str, ...] = ("run_id", "mark")) -> DataFrame:
    """w = strength / vol, scaled to a gross of 1; rows of (by, symbol, strength, vol)."""
    raw = signals.withColumn("w", F.try_divide(F.col("strength"), F.col("vol"))).where("w is not null and w <> 0")
    gross = F.sum(F.abs("w")).over(Window.partitionBy(*by))
    return raw.withColumn("w", F.col("w") / gross)


def vol_target(weights: DataFrame, cov: DataFrame, target: float, max_gross: float = 1.0, by: tuple[str, ...] = ("run_id", "mark")) -> DataFrame:
    """Scales each basket by min(target / portfolio volatility, max_gross); 1 if it has no volatility.

    ``cov`` has each pair once (a <= b); pairs apart count twice.
    """
    one = weights.select(*by, F.col("symbol").alias("a"), F.col("w").alias("wa"))
    two = weights.select(*by, F.col("symbol").alias("b"), F.col("w").alias("wb"))
    pairs = cov.join(one, ["mark", "a"]).join(two, [*by, "b"])
    part = F.col("wa") * F.col("wb") * F.col("cov") * F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    scale = pairs.groupBy(*by).agg(F.sqrt(F.sum(part)).alias("pvol"))
    ratio = F.when(F.col("pvol") > 0, F.least(target / F.col("pvol"), F.lit(max_gross))).otherwise(1.0)
    return weights.join(scale, list(by), "left").withColumn("w", F.col("w") * ratio).drop("pvol")


def top_k(signals: DataFrame, k: int, by: tuple[str, ...], order: str) -> DataFrame:
    """The k best rows of each group; ties by symbol."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), "symbol"))
    return signals.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def spanning_order(dist: np.ndarray) -> np.ndarray:
    """Leaf order of single linkage, from the edges of a minimum spanning tree in order of length.

    Joining two trees appends the younger one's leaves (leaves count by index, joined trees by
    the time of their making); edges of equal length are taken by their ends.
    """
    n = len(dist)
    one, two = np.triu_indices(n, 1)
    tree, born, leaves = np.arange(n), list(range(n)), {k: [k] for k in range(n)}
    for e in np.lexsort((two, one, dist[one, two])):
        x, y = sorted((int(tree[one[e]]), int(tree[two[e]])), key=born.__getitem__)
        if x == y:
            continue
        leaves[x] += leaves.pop(y)
        tree[leaves[x]] = x
        born[x] = max(born) + 1
        if len(leaves) == 1:
            break
    return np.array(next(iter(leaves.values())) if n else [], dtype=np.int64)


def bisection_weights(cov: np.ndarray) -> np.ndarray:
    """Weights of assets in their order: every level halves all spans at once.

    A span's risk under inverse-variance weights is a block sum of one matrix over the square of a sum, so
    both come from running totals.
    """
    n = len(cov)
    inverse = 1 / np.diag(cov)
    blocks = np.zeros((n + 1, n + 1))
    blocks[1:, 1:] = (cov * np.outer(inverse, inverse)).cumsum(axis=0).cumsum(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(inverse)])
    risk = lambda a, b: (blocks[b, b] - blocks[a, b] - blocks[b, a] + blocks[a, a]) / (sums[b] - sums[a]) ** 2
    w, begin, end = np.ones(n), np.array([0]), np.array([n])
    while (wide := end - begin > 1).any():
        begin, end = begin[wide], end[wide]
        middle = begin + (end - begin) // 2
        left = risk(middle, end) / (risk(begin, middle) + risk(middle, end))
        for a, m, b, share in zip(begin, middle, end, left, strict=True):
            w[a:m] *= share
            w[m:b] *= 1 - share
        begin, end = np.concatenate([begin, middle]), np.concatenate([middle, end])
    return w


def hrp_weights(cov: DataFrame) -> DataFrame:
    """Hierarchical risk parity of each mark's covariance matrix (mark, a, b, cov): one matrix of assets a group, a few hundred at most."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["a"], rows["b"]]))
        i, j = np.searchsorted(names, rows["a"]), np.searchsorted(names, rows["b"])
        matrix = np.zeros((len(names), len(names)))
        matrix[i, j] = matrix[j, i] = rows["cov"]
        scale = np.sqrt(np.diag(matrix))
        order = spanning_order(np.sqrt(np.maximum(0.5 - 0.5 * matrix / scale / scale[:, None], 0)))
        return pd.DataFrame({"mark": rows["mark"].iloc[0], "symbol": names[order], "w": bisection_weights(matrix[np.ix_(order, order)])})

    return cov.groupBy("mark").applyInPandas(solve, f"mark {cov.schema['mark'].dataType.simpleString()}, symbol string, w double")


def ext_vol_weights(signals: DataFrame, vols: DataFrame, by: tuple[str, ...] = ("run_id", "mark")) -> DataFrame:
    """inverse_vol_weights() with volatilities of another panel (mark, symbol, vol).

    A signal without a volatility there raises an error when the result is computed; the test rides on the join, as one more column.
    """
    known = vols.select("mark", "symbol", F.col("vol").alias("_v"), F.lit(True).alias("_known"))
    x = signals.drop("vol").join(known, ["mark", "symbol"], "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no volatility of "), "symbol", F.lit(" at "), F.col("mark").cast("string"))).cast("double")).otherwise(F.col("_v"))
    return inverse_vol_weights(x.withColumn("vol", checked), by).drop("_v", "_known")


def risk_parity_split(returns: DataFrame) -> DataFrame:
    """leg, w: inverse volatilities over the rows that all legs have; rows of (leg, dt, ret)."""
    legs = returns.select("leg").distinct().agg(F.count(F.lit(1)).alias("_k"))
    full = returns.where("ret is not null").groupBy("dt").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(legs), F.col("_n") == F.col("_k")).select("dt")
    vol = returns.join(full, "dt").groupBy("leg").agg((1 / F.stddev_samp("ret")).alias("_iv"))
    return vol.withColumn("w", F.col("_iv") / F.sum("_iv").over(Window.partitionBy())).drop("_iv")


def blend_weights(legs: list[tuple[DataFrame, float]], by: tuple[str, ...] = ("mark",)) -> DataFrame:
    """Sum of weighted legs by name; what is nearly zero goes."""
    rows = None
    for leg, share in legs:
        part = leg.select(*by, "symbol", (F.col("w") * share).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*by, "symbol").agg(F.sum("w").alias("w")).where(F.abs("w") >= 1e-9)


def stack_weights(sleeve: DataFrame, fund: str, multiple: float, by: tuple[str, ...] = ("mark",)) -> DataFrame:
    """1 / multiple in a levered fund, the rest in the sleeve."""
    lead = sleeve.select(*by).distinct().select(*by, F.lit(fund).alias("symbol"), F.lit(1 / multiple).alias("w"))
    return blend_weights([(sleeve, 1 - 1 / multiple), (lead, 1.0)], by)


def park_cash(weights: DataFrame, cash: str, by: tuple[str, ...] = ("mark",), least: float = 0.005) -> DataFrame:
    """Adds what the weights leave, if it is above ``least``, as a row of the cash symbol."""
    left = weights.groupBy(*by).agg((1 - F.sum("w")).alias("w")).where(F.col("w") > least)
    return weights.select(*by, "symbol", "w").unionByName(left.select(*by, F.lit(cash).alias("symbol"), "w"))


def band_trades(current: DataFrame, target: DataFrame, band: float, least: float = 0.005) -> DataFrame:
    """symbol, cur, tgt, new, trade: positions move to the near edge of a band around the target.

    A name without a target is sold whole; moves of ``least`` or less aren't made.
    """
    x = current.select("symbol", F.col("w").alias("cur")).join(target.select("symbol", F.col("w").alias("tgt")), "symbol", "full_outer").fillna(0.0, ["cur", "tgt"])
    wide = band * F.abs("tgt")
    x = x.withColumn("new", F.greatest(F.col("tgt") - wide, F.least(F.col("tgt") + wide, F.col("cur"))))
    return x.withColumn("trade", F.when(F.abs(F.col("new") - F.col("cur")) > least, F.col("new") - F.col("cur")).otherwise(0.0))


def buffered_weights(current: DataFrame, target: DataFrame, band: float, cap: float = 1.0) -> DataFrame:
    """One rebalance: current weights clipped to bands around their targets, scaled down to the gross cap."""
    x = band_trades(current, target, band, 0.0).select("symbol", F.col("new").alias("w")).where("w <> 0")
    gross = F.sum(F.abs("w")).over(Window.partitionBy())
    return x.withColumn("w", F.col("w") * F.least(F.lit(1.0), cap / gross))


def order_sheet(weights: DataFrame, prices: DataFrame, capital: float, fractional: bool = True) -> DataFrame:
    """Target money, shares (4 places, or whole) and cost of each name, and the residue above 1 as a cash row."""
    x = weights.join(prices, "symbol").withColumn("target", F.col("w") * capital)
    shares = F.round(F.col("target") / F.col("price"), 4) if fractional else F.floor(F.col("target") / F.col("price")).cast("double")
    x = x.withColumn("shares", shares).withColumn("cost", F.col("shares") * F.col("price")).select("symbol", "target", "shares", "cost")
    left = x.agg((F.lit(capital) - F.sum("cost")).alias("cost")).where("cost > 1")
    return x.unionByName(left.select(F.lit("CASH").alias("symbol"), F.col("cost").alias("target"), F.col("cost").alias("shares"), "cost"))


def weight_guards(weights: DataFrame, cap: float, long_only: bool, by: tuple[str, ...] = ("mark",)) -> DataFrame:
    """Baskets that break a rule: a short in a long-only book, or too large a sum (or gross)."""
    least, total = F.min("w"), F.sum("w") if long_only else F.sum(F.abs("w"))
    x = weights.groupBy(*by).agg(least.alias("least"), total.alias("total"))
    rule = F.when((F.col("least") < 0) & F.lit(long_only), "short").when(F.col("total") > cap + 1e-9, "cap")
    return x.withColumn("rule", rule).where("rule is not null")


def posture(weights: DataFrame, defensive: list[str], by: tuple[str, ...] = ("mark",)) -> DataFrame:
    """Deployed weight, and the shares of it in defensive and in other names."""
    total = F.sum(F.abs("w"))
    safe = F.sum(F.when(F.col("symbol").isin(defensive), F.abs("w")).otherwise(0.0))
    return weights.groupBy(*by).agg(total.alias("deployed"), F.try_divide(safe, total).alias("defensive"), (1 - F.try_divide(safe, total)).alias("risk"))


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Pairs a < b of symbols within a group (an industry); the pairs are the result, so the join makes no row more."""
    one, two = members.select("grp", F.col("symbol").alias("a")), members.select("grp", F.col("symbol").alias("b"))
    return one.join(two, "grp").where("a < b")


def pair_positions(spread: DataFrame, entry: float, leave: float, stop: float, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Adds position (-1, 0, 1): flat until the z-score passes ``entry``; left inside ``leave`` or beyond ``stop`` (leave <= entry <= stop).

    No row needs the state before it: a score inside ``leave`` closes, one between ``entry`` and
    ``stop`` makes sure that a position is open, and one beyond ``stop`` opens or closes in turn.  So whether a
    position is open follows from the last of the first two kinds and the number of the
    third since then; its side is that of the row where it was opened.
    """
    w = Window.partitionBy(*by).orderBy("idx")
    size = F.abs("z")
    fixed = F.when(size < leave, False).when((size > entry) & (size <= stop), True)
    x = spread.withColumns({"_fixed": fixed, "_turns": F.sum((F.coalesce(size, F.lit(0.0)) > stop).cast("int")).over(w)})
    since = F.col("_turns") - F.coalesce(F.last(F.when(F.col("_fixed").isNotNull(), F.col("_turns")), ignorenulls=True).over(w), F.lit(0))
    x = x.withColumn("_open", F.coalesce(F.last("_fixed", ignorenulls=True).over(w), F.lit(False)) != (since % 2 == 1))
    opened = F.col("_open") & ~F.coalesce(F.lag("_open").over(w), F.lit(False))
    x = x.withColumn("_side", F.when(opened, F.when(F.col("z") > 0, -1).otherwise(1)))
    side = F.last("_side", ignorenulls=True).over(w)
    return x.withColumn("position", F.when(F.col("_open"), side).otherwise(0)).drop("_fixed", "_turns", "_open", "_side")
