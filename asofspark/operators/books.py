"""Books made of other operators: schedules, sweeps, walk-forward and research panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.operators import timeseries as ts

YEAR = 252


def letf_return(r: Column, rf: Column, leverage: float, spread: float = 0.004, fee: float = 0.0095) -> Column:
    """Daily return of a levered fund: L r - (L - 1)(rf + spread) / 252 - fee / 252."""
    return leverage * r - (leverage - 1) * (rf + spread) / YEAR - fee / YEAR


def levered_return(r: Column, rf: Column, leverage: float, spread: float) -> Column:
    return leverage * r - (leverage - 1) * (rf + spread) / YEAR


def stacked_return(r: Column, overlay: Column, rf: Column, share: float, spread: float) -> Column:
    return r + share * overlay - share * (rf + spread) / YEAR


def trade_cost(shares: Column, price: Column, bps: float) -> Column:
    return F.abs(shares) * price * bps / 1e4


def market_cap_latest(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """ticker, market_cap: last close times shares, where shares aren't 0."""
    last = prices.groupBy("ticker").agg(F.max_by("close", "dt").alias("close"))
    return last.join(shares, "ticker").where("shares <> 0").select("ticker", (F.col("close") * F.col("shares")).alias("market_cap"))


def entry_prices(picks: DataFrame, prices: DataFrame) -> DataFrame:
    """Price on the first panel date on or after each pick's date, else its stored price if that is positive.

    Picks and prices of a symbol are one ordered stream; each pick looks forward to the next price.
    """
    none = F.lit(None).cast("double")
    both = prices.where("px is not null").select("symbol", "dt", F.lit(1).alias("_k"), "px", none.alias("price"))
    both = both.unionByName(picks.select("symbol", F.col("lock_date").alias("dt"), F.lit(0).alias("_k"), none.alias("px"), "price"))
    ahead = Window.partitionBy("symbol").orderBy("dt", "_k").rowsBetween(0, Window.unboundedFollowing)
    x = both.withColumn("_p", F.first("px", ignorenulls=True).over(ahead)).where("_k = 0")
    return x.select(F.col("dt").alias("lock_date"), "symbol", F.coalesce("_p", F.when(F.col("price") > 0, F.col("price"))).alias("entry"))


def carry_weights(yields: DataFrame, by: str = "mark") -> DataFrame:
    """Positive yield over volatility, scaled to a gross of 1; rows of (mark, symbol, ttm_yield, vol)."""
    raw = yields.where("ttm_yield > 0").withColumn("w", F.try_divide(F.col("ttm_yield"), F.col("vol"))).where("w is not null")
    return raw.select(by, "symbol", (F.col("w") / F.sum("w").over(Window.partitionBy(by))).alias("w"))


def momentum_schedule(panel: DataFrame, market: str, skip: int, look: int, ma: int, n: int, every: int | None = None, least: int = 10) -> DataFrame:
    """mark, symbol, w: the n best momentum names at equal weight; one row with a NULL symbol if the market is below its mean.

    Rebalances are on the first row of every month, or on rows whose number ``every`` divides.  Only names with a close on the row itself can be bought; a row with fewer than ``least`` such names has no basket.
    """
    regime = ts.market_regime(panel.where(F.col("symbol") == market), ma).select(F.col("idx").alias("mark"), "risk_on")
    first = F.trunc("dt", "month") != F.trunc(F.lag("dt").over(ts.by_symbol()), "month") if every is None else F.col("idx") % every == 0
    x = panel.withColumns({"mom": ts.momentum(skip, look), "_first": first}).where(F.col("_first") & (F.col("idx") >= skip + look) & F.col("mom").isNotNull() & F.col("close").isNotNull())
    w = Window.partitionBy("mark")
    x = x.drop("_first").withColumnRenamed("idx", "mark").withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    x = x.withColumn("_p", F.row_number().over(w.orderBy(F.desc("mom"), "symbol"))).where(F.col("_p") <= n).join(regime, "mark")
    on = x.where("risk_on").select("mark", "symbol", (1.0 / F.count(F.lit(1)).over(w)).alias("w"))
    off = x.where("not risk_on").select("mark").distinct().select("mark", F.lit(None).cast("string").alias("symbol"), F.lit(0.0).alias("w"))
    return on.unionByName(off)


def basket_since_lock(locks: DataFrame, prices: DataFrame) -> DataFrame:
    """Weighted return of each lock's basket from its own entry to now."""
    now = prices.groupBy("symbol").agg(F.max_by("px", "dt").alias("_now"))
    x = locks.join(now, "symbol", "left").withColumn("_r", F.coalesce(F.try_divide(F.col("_now"), F.col("price")) - 1, F.lit(0.0)))
    return x.groupBy("book", "lock_date").agg(F.sum(F.col("w") * F.col("_r")).alias("since_lock"))


def rebalance_orders(current: DataFrame, target: DataFrame, prices: DataFrame, capital: float, band: float, cash: str, least: float = 1.0, substitutes: DataFrame | None = None) -> DataFrame:
    """symbol, side (BUY, SELL, SKIP), shares, dollars: trades that leave their bands, names that stay inside, and what is left in the cash name.

    ``substitutes`` (symbol, instead) names what is traded for a target that can't be bought.
    """
    from asofspark.operators.weights import band_trades

    if substitutes is not None:
        target = target.join(substitutes, "symbol", "left").select(F.coalesce("instead", "symbol").alias("symbol"), "w").groupBy("symbol").agg(F.sum("w").alias("w"))
    moves = band_trades(current, target, band)
    x = moves.where("trade <> 0").select("symbol", (F.col("trade") * capital).alias("dollars"))
    left = x.agg((-F.sum("dollars")).alias("dollars")).where(F.abs("dollars") > least).select(F.lit(cash).alias("symbol"), "dollars")
    x = x.unionByName(left).groupBy("symbol").agg(F.sum("dollars").alias("dollars")).join(prices, "symbol", "left")
    x = x.select("symbol", F.when(F.col("dollars") > 0, "BUY").otherwise("SELL").alias("side"), F.round(F.abs("dollars") / F.col("price"), 4).alias("shares"), F.abs("dollars").alias("dollars"))
    inside = moves.where("trade = 0 and new <> cur").select("symbol", F.lit("SKIP").alias("side"), F.lit(0.0).alias("shares"), F.abs((F.col("new") - F.col("cur")) * capital).alias("dollars"))
    return x.unionByName(inside)


def split_search(grid: DataFrame, split: int) -> DataFrame:
    """symbol, run_id of the best in-sample run (rows before ``split``), with its in- and out-of-sample growth.

    ``grid`` has one row a run and bar: (symbol, run_id, idx, x), x the log return that the run earns there.
    """
    part = F.col("idx") < split
    res = grid.groupBy("symbol", "run_id").agg(F.sum(F.when(part, F.col("x"))).alias("in_sample"), F.sum(F.when(~part, F.col("x"))).alias("out_sample"))
    return res.withColumn("_p", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("in_sample"), "run_id"))).where("_p = 1").drop("_p")


def walk_forward(grid: DataFrame, train: int, test: int, start: int) -> DataFrame:
    """symbol, fold, run_id, trained, earned: for each test window the run that was best in the ``train`` rows before it.

    Windows are rows of a small table; all of them are scored in one grouped pass.
    """
    span = grid.agg(F.max("idx").alias("_end"))
    folds = span.select(F.explode(F.sequence(F.lit(start), F.col("_end"), F.lit(test))).alias("fold"))
    each = folds.select("fold", F.explode(F.sequence(F.col("fold") - train, F.col("fold") + test - 1)).alias("idx"))
    x = grid.join(each, "idx")  # by the row itself, so that no range is searched
    before = F.col("idx") < F.col("fold")
    res = x.groupBy("symbol", "fold", "run_id").agg(F.sum(F.when(before, F.col("x"))).alias("trained"), F.sum(F.when(~before, F.col("x"))).alias("earned"))
    return res.withColumn("_p", F.row_number().over(Window.partitionBy("symbol", "fold").orderBy(F.desc_nulls_last("trained"), "run_id"))).where("_p = 1").drop("_p")


def breadth(ranks: DataFrame, ns: list[int], fwd: str = "fwd") -> DataFrame:
    """n, long, long_short: mean return of the n best names by mean percentile, and less that of the n worst."""
    score = ranks.where("pct is not null").groupBy("date", "name", fwd).agg(F.round(F.avg("pct"), 9).alias("score"))
    w = Window.partitionBy("date")
    x = score.withColumns({"_t": F.row_number().over(w.orderBy(F.desc("score"), "name")), "_b": F.row_number().over(w.orderBy("score", "name"))})
    out = None
    for n in ns:
        top, low = F.avg(F.when(F.col("_t") <= n, F.col(fwd))), F.avg(F.when(F.col("_b") <= n, F.col(fwd)))
        row = x.groupBy("date").agg(top.alias("t"), (top - low).alias("s")).agg(F.lit(n).alias("n"), F.avg("t").alias("long"), F.avg("s").alias("long_short"))
        out = row if out is None else out.unionByName(row)
    return out


def switched_mix(legs: DataFrame, w: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, dt, equity, switches: w in leg a while ``on`` was true the row before, else in leg c; the rest in leg b; daily weights."""
    o = Window.partitionBy(*by).orderBy("dt")
    x = legs.withColumn("_on", F.coalesce(F.lag("on").over(o), F.lit(True)))
    r = w * F.when(F.col("_on"), F.col("ra")).otherwise(F.col("rc")) + (1 - w) * F.col("rb")
    moved = F.coalesce((F.col("_on") != F.lag("_on").over(o)).cast("int"), F.lit(0))
    x = x.withColumns({"_r": r, "_m": moved})
    return x.select(*by, "dt", (10_000.0 * F.product(1 + F.col("_r")).over(o)).alias("equity"), F.sum("_m").over(o).cast("long").alias("switches"))


def normalize_canonical(rows: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """NaN to NULL, lists without missing elements, and the tax rate within [0, 0.6]."""
    none = lambda c: F.when(~F.isnan(c), F.col(c))
    x = rows.withColumns({c: none(c) for c in scalars} | {c: F.filter(c, lambda v: v.isNotNull() & ~F.isnan(v)) for c in lists})
    rate = F.col("tax_rate")
    return x.withColumn("tax_rate", F.when(rate < 0, 0.0).when(rate > 0.6, 0.6).otherwise(rate)) if "tax_rate" in scalars else x


def validate_canonical(rows: DataFrame, scalars: list[str]) -> DataFrame:
    """ticker, field, rule of NaN values, infinities, and tax rates outside [0, 0.6]."""
    x = rows.unpivot(["ticker"], scalars, "field", "v")
    rule = F.when(F.isnan("v"), "nan").when(F.abs("v") == F.lit(float("inf")), "infinite").when((F.col("field") == "tax_rate") & ~F.col("v").between(0.0, 0.6), "range")
    return x.select("ticker", "field", rule.alias("rule")).where("rule is not null")


def universe(*tables: DataFrame) -> DataFrame:
    """Tickers that all tables have."""
    out = tables[0].select("ticker").distinct()
    for t in tables[1:]:
        out = out.intersect(t.select("ticker"))
    return out
