"""Cross-sectional ranks, composites, funnels and baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.functions import factors as fx


def pct_rank(value: str, ascending: bool = True, by: Sequence[str] = ()) -> Column:
    """Average rank of ties over the number of values, times 100; NULL for a missing value or group."""
    groups = [F.col(c) for c in by]
    w = Window.partitionBy(*groups, F.col(value).isNull())
    rank = F.rank().over(w.orderBy(F.col(value).asc() if ascending else F.col(value).desc()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    present = F.col(value).isNotNull()
    for g in groups:
        present = present & g.isNotNull()
    return F.when(present, 100.0 * (rank + (ties - 1) / 2.0) / F.count(F.lit(1)).over(w))


def with_factors(names: DataFrame) -> DataFrame:
    return names.withColumns({k: f() for k, f in fx.ALL.items()})


def screen_funnel(names: DataFrame, low: float, high: float, excluded: Sequence[str] = (), z_min: float = 1.81, m_max: float = -1.78) -> DataFrame:
    """Adds altman_z, beneish_m and drop_reason: the first test that a name fails, NULL if none."""
    x = names.withColumns({"altman_z": fx.altman_z(), "beneish_m": fx.beneish_m()})
    reason = (
        F.when(F.col("market_cap").isNull() | ~F.col("market_cap").between(low, high), "cap")
        .when(F.col("sector").isin(*excluded) if excluded else F.lit(False), "sector")
        .when(F.col("altman_z") < z_min, "altman_z")
        .when(F.col("beneish_m") > m_max, "beneish_m")
    )
    return x.withColumn("drop_reason", reason)


def ranked(names: DataFrame, places: dict[str, tuple[str, bool]], by: Sequence[str], digits: int | None = None) -> DataFrame:
    """Adds the pct_rank() of each (value, ascending), at ``digits`` decimals of the value."""
    if digits is None:
        return names.withColumns({out: pct_rank(v, up, by) for out, (v, up) in places.items()})
    x = names.withColumns({f"_{out}": F.round(v, digits) + F.lit(0.0) for out, (v, _) in places.items()})
    return x.withColumns({out: pct_rank(f"_{out}", up, by) for out, (_, up) in places.items()}).drop(*[f"_{out}" for out in places])


def composite(names: DataFrame, weights: dict[str, float], by: Sequence[str] = ("as_of", "sector"), least: int = 4, digits: int | None = None) -> DataFrame:
    """Percentiles in the good direction (factor_pct) and their weighted mean over the factors present, ``least`` at least.

    Values are ranked at ``digits`` decimals: sums of money differ beyond them by the order of their rows, and equal companies tie.
    """
    x = ranked(names, {f"{f}_pct": (f, not fx.LOWER_BETTER[f]) for f in weights}, by, digits)
    total, share, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for f, w in weights.items():
        there = F.col(f"{f}_pct").isNotNull()
        total, share = total + F.coalesce(F.col(f"{f}_pct") * w, F.lit(0.0)), share + F.when(there, w).otherwise(0.0)
        n = n + there.cast("int")
    return x.withColumns({"n_factors": n, "composite": F.when(n >= least, total / share)})


WEIGHTS = {"ev_ebit": 0.2, "price_fcf": 0.2, "roic": 0.2, "gm_stability": 0.2, "net_debt_ebitda": 0.2}


def long_screen(names: DataFrame, low: float, high: float, excluded: Sequence[str] = (), by: Sequence[str] = ("as_of", "sector"), digits: int | None = None) -> DataFrame:
    """Names that pass the funnel with factors, percentiles, composite and place within their date."""
    passed = screen_funnel(names, low, high, excluded).where("drop_reason is null")
    scored = composite(with_factors(passed), WEIGHTS, by, digits=digits)
    order = F.col("composite") if digits is None else F.round("composite", digits)
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(order.desc_nulls_last(), "ticker"))
    return scored.withColumn("place", place)


def short_screen(names: DataFrame, low: float, high: float, excluded: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Three legs without scrubs: 100 - composite, low Z, high M (whole universe); score is the mean of those present."""
    x = screen_funnel(names, low, high, excluded).where("drop_reason is null or drop_reason in ('altman_z', 'beneish_m')")
    x = composite(with_factors(x), WEIGHTS, digits=digits).withColumn("leg_value", 100.0 - F.col("composite"))
    x = ranked(x, {"leg_z": ("altman_z", False), "leg_m": ("beneish_m", True)}, ("as_of",), digits)
    legs = ["leg_value", "leg_z", "leg_m"]
    n = sum((F.col(c).isNotNull().cast("int") for c in legs), F.lit(0))
    return x.withColumns({"legs": n, "score": F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in legs), F.lit(0.0)), n)})


def top_n(ranked: DataFrame, by: Sequence[str], order: str, n: int | None = None, share: float | None = None, key: str = "symbol") -> DataFrame:
    """Equal weights of the best names of each group: ``n`` of them, or the floor of a share, one at least; ties by key."""
    there = ranked.where(F.col(order).isNotNull())
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.desc(order), key))
    size = F.lit(n) if n is not None else F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * share))
    picked = there.withColumns({"_place": place, "_size": size}).where("_place <= _size")
    return picked.withColumn("w", 1.0 / F.count(F.lit(1)).over(w)).drop("_place", "_size")


def basket_diff(now: DataFrame, before: DataFrame, key: str = "symbol") -> DataFrame:
    """status (added, dropped, held) of each name, and the turnover in percent of the current number."""
    a, b = now.select(F.col(key), F.lit(1).alias("_a")), before.select(F.col(key), F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "dropped").otherwise("held")
    return both.select(key, status.alias("status"))


def turnover_percent(diff: DataFrame) -> DataFrame:
    moved, held = F.count_if(F.col("status") != "held"), F.count_if(F.col("status") != "dropped")
    return diff.agg(F.round(F.try_divide(100.0 * moved, held)).alias("turnover_pct"))


def long_short_book(long: DataFrame, short: DataFrame, n: int) -> DataFrame:
    """+0.5/n of the n best longs and -0.5/n of the n best shorts with two legs that aren't long."""
    a = long.where((F.col("place") <= n) & F.col("composite").isNotNull()).select("as_of", "ticker", F.lit(0.5 / n).alias("w"))
    left = short.where("legs >= 2").join(a.select("as_of", "ticker"), ["as_of", "ticker"], "left_anti")
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "ticker"))
    b = left.withColumn("_p", place).where(F.col("_p") <= n).select("as_of", "ticker", F.lit(-0.5 / n).alias("w"))
    return a.unionByName(b)
