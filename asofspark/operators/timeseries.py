"""Rolling signals over panel rows (symbol, idx, dt, px, ret, ...).

Windows are by symbol and calendar row; a rolling value is NULL until its window is full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("idx")


def rolling(agg, value: str | Column, n: int, by: WindowSpec | None = None) -> Column:
    """``agg`` of the last n rows, where all n have a value."""
    value = F.col(value) if isinstance(value, str) else value
    w = (by or by_symbol()).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def sma_cross(fast: int, slow: int, px: str = "px") -> Column:
    """1 where the fast mean is above the slow one, else 0; 0 until the slow window is full."""
    if fast >= slow:
        raise ValueError("fast must be below slow")
    return F.when(rolling(F.avg, px, fast) > rolling(F.avg, px, slow), 1.0).otherwise(0.0)


def sma_grid(panel: DataFrame, params: Sequence[tuple[int, int]]) -> DataFrame:
    """run_id (fast-slow), fast, slow, symbol, idx, dt, px, signal for all pairs with fast < slow.

    One window a distinct length; pairs are then unfolded from an array.
    """
    pairs = [(f, s) for f, s in params if f < s]
    lengths = sorted({n for p in pairs for n in p})
    means = panel.select("symbol", "idx", "dt", "px", *[rolling(F.avg, "px", n).alias(f"m{n}") for n in lengths])
    each = [F.struct(F.lit(f"{f}-{s}").alias("run_id"), F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.when(F.col(f"m{f}") > F.col(f"m{s}"), 1.0).otherwise(0.0).alias("signal")) for f, s in pairs]
    return means.select("symbol", "idx", "dt", "px", F.explode(F.array(*each)).alias("p")).select("symbol", "idx", "dt", "px", "p.*")


def wf_signal(grid: DataFrame, schedule: DataFrame) -> DataFrame:
    """Within each test window (start, end, fast, slow) the signal of its pair; flat outside."""
    s = schedule.select("start", "end", F.col("fast").alias("_f"), F.col("slow").alias("_s"))
    days = s.withColumn("dt", F.explode(F.expr("sequence(start, end)"))).withColumnsRenamed({"_f": "fast", "_s": "slow"})
    met = grid.join(days, ["fast", "slow", "dt"])
    days = grid.select("symbol", "idx", "dt").distinct()
    return days.join(met.select("symbol", "idx", "signal"), ["symbol", "idx"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))


def month_start(calendar: DataFrame) -> DataFrame:
    """Adds the flag of the first row of a month; the very first row is none."""
    before = F.lag("dt").over(Window.orderBy("idx"))
    return calendar.withColumn("month_start", F.coalesce(F.trunc("dt", "month") != F.trunc(before, "month"), F.lit(False)))


def cycle_bar(every: int, offset: int, warmup: int) -> Column:
    return (F.col("idx") % every == offset) & (F.col("idx") >= warmup)


def momentum(skip: int, look: int, px: str = "px") -> Column:
    """Price ``skip`` rows ago over the price ``look`` rows before that, less 1."""
    return F.try_divide(F.lag(px, skip).over(by_symbol()), F.lag(px, skip + look).over(by_symbol())) - 1


def tsmom_sign(look: int) -> Column:
    return F.when(momentum(0, look) > 0, 1.0).when(momentum(0, look).isNotNull(), 0.0)


def trend_strength(panel: DataFrame, looks: Sequence[int], hurdle: str | None = None, long_short: bool = False) -> DataFrame:
    """Adds strength: the mean over lookbacks of whether momentum beats the hurdle symbol's (0 if it has none).

    With ``long_short`` what doesn't beat it counts -1.  A symbol that misses a lookback has none.
    """
    x = panel.withColumns({f"_m{n}": momentum(0, n) for n in looks})
    if hurdle is not None:
        h = x.where(F.col("symbol") == hurdle).select("idx", *[F.col(f"_m{n}").alias(f"_h{n}") for n in looks])
        x = x.join(h, "idx", "left").where(F.col("symbol") != hurdle)
    low = -1.0 if long_short else 0.0
    total = F.lit(0.0)
    for n in looks:
        over = F.col(f"_m{n}") - (F.coalesce(f"_h{n}", F.lit(0.0)) if hurdle is not None else F.lit(0.0))
        total = total + F.when(over > 0, 1.0).when(over.isNotNull(), low)
    return x.withColumn("strength", total / len(looks)).drop(*[f"_m{n}" for n in looks], *[f"_h{n}" for n in looks])


def rolling_vol(n: int = 63, year: int = 252) -> Column:
    return rolling(F.stddev_samp, "ret", n) * year**0.5


def yang_zhang(panel: DataFrame, n: int = 63, year: int = 252) -> DataFrame:
    """Adds yz_vol: overnight variance, open-to-close variance and the Rogers-Satchell mean, annualized."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    before = F.lag("close").over(by_symbol())
    x = panel.withColumns({"_o": F.log(F.col("open") / before), "_c": F.log(F.col("close") / F.col("open"))})
    rs = F.log(F.col("high") / F.col("close")) * F.log(F.col("high") / F.col("open")) + F.log(F.col("low") / F.col("close")) * F.log(F.col("low") / F.col("open"))
    var = rolling(F.var_samp, "_o", n) + k * rolling(F.var_samp, "_c", n) + (1 - k) * rolling(F.avg, rs, n)
    return x.withColumn("yz_vol", F.sqrt(F.when(var > 0, var).when(var.isNotNull(), 0.0) * year)).drop("_o", "_c")


def rolling_cov(returns: DataFrame, rebalances: DataFrame, n: int = 63, year: int = 252) -> DataFrame:
    """Annual covariance of each pair a <= b over the n rows up to each rebalance idx: mark, a, b, cov.

    Only the rows of rebalance windows are joined, by the shared row, so the cost is the
    windows times the pairs.
    """
    spans = rebalances.select(F.col("idx").alias("mark"))
    rows = returns.where("ret is not null").select("symbol", "idx", "ret")
    each = spans.distinct().select("mark", F.explode(F.sequence(F.col("mark") - (n - 1), F.col("mark"))).alias("idx"))
    inside = rows.join(each, "idx")
    left = inside.select("mark", "idx", F.col("symbol").alias("a"), F.col("ret").alias("ra"))
    right = inside.select("mark", "idx", F.col("symbol").alias("b"), F.col("ret").alias("rb"))
    pairs = left.join(right, ["mark", "idx"]).where("a <= b").groupBy("mark", "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.count(F.lit(1)).alias("n"))
    return pairs.where(F.col("n") == n).select("mark", "a", "b", (F.col("cov") * year).alias("cov"))


def ttm_yield(panel: DataFrame, posted: DataFrame, n: int = 252) -> DataFrame:
    """Adds ttm_yield: amounts posted in the last n rows over the price."""
    x = panel.join(posted, ["symbol", "dt"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    return x.withColumn("ttm_yield", F.try_divide(rolling(F.sum, "amount", n), F.col("px")))


def market_regime(panel: DataFrame, ma: int, compare: str = ">", lag: int = 0) -> DataFrame:
    """Adds risk_on: price against its mean by ``compare``, ``lag`` rows ago; on until the mean exists."""
    mean = rolling(F.avg, "px", ma)
    met = {">": F.col("px") > mean, ">=": F.col("px") >= mean, "<": F.col("px") < mean}[compare]
    x = panel.withColumn("_on", F.coalesce(~met if compare == "<" else met, F.lit(True)))
    return x.withColumn("risk_on", F.coalesce(F.lag("_on", lag).over(by_symbol()), F.lit(True)) if lag else F.col("_on")).drop("_on")


def vol_managed(panel: DataFrame, target: float, n: int = 126, cap: float = 2.0) -> DataFrame:
    """Adds leverage (target over realized, capped, one row late) and the compounded growth under it."""
    level = F.try_divide(F.lit(target), rolling_vol(n))
    x = panel.withColumn("_lev", F.when(level > cap, cap).otherwise(level))
    x = x.withColumn("leverage", F.coalesce(F.lag("_lev").over(by_symbol()), F.lit(0.0))).drop("_lev")
    growth = F.exp(F.sum(F.log(1 + F.col("leverage") * F.coalesce("ret", F.lit(0.0)))).over(by_symbol()))
    return x.withColumn("growth", growth)


def rotation_returns(panel: DataFrame, ma: int, leverage: float, bps: float, rf: float = 0.0, year: int = 252) -> DataFrame:
    """Adds hold and rot_ret: the levered return while the price was above its mean the row before, else the bill's, less costs."""
    x = panel.withColumn("_up", F.when(F.col("px") > rolling(F.avg, "px", ma), 1.0).otherwise(0.0))
    x = x.withColumn("hold", F.coalesce(F.lag("_up").over(by_symbol()), F.lit(0.0)))
    moved = F.abs(F.col("hold") - F.coalesce(F.lag("hold").over(by_symbol()), F.lit(0.0)))
    levered = leverage * F.coalesce("ret", F.lit(0.0)) - (leverage - 1) * rf / year
    return x.withColumn("rot_ret", F.when(F.col("hold") == 1.0, levered).otherwise(rf / year) - moved * bps / 1e4 * leverage).drop("_up")


def breadth_gate(panel: DataFrame, canaries: Sequence[str], months: Sequence[int], every: int) -> DataFrame:
    """idx, bad, exposure: weighted momentum of each canary, the number at or below 0, and 1 - bad/2.

    Set at cycle rows, held between, and applied one row later.
    """
    weights = (12, 4, 2, 1)
    score = sum((w * momentum(0, n) for w, n in zip(weights, months, strict=True)), F.lit(0.0)) / sum(weights)
    x = panel.where(F.col("symbol").isin(*canaries)).withColumn("score", score)
    row = x.groupBy("idx").agg(F.count_if(F.col("score") <= 0).alias("bad"), F.count("score").alias("n"))
    w = Window.orderBy("idx")
    set_at = F.when((F.col("idx") % every == 0) & (F.col("n") == len(canaries)), 1 - F.col("bad") / 2.0)
    held = row.withColumn("_held", F.last(set_at, ignorenulls=True).over(w))
    return held.select("idx", "bad", F.lag("_held").over(w).alias("exposure"))


def rsrs_gate(panel: DataFrame, n: int = 18, look: int = 600, every: int = 21, edge: float = 0.7) -> DataFrame:
    """Adds beta (slope of high on low), its z-score and the gate: 1 above the edge, 0 below minus it, else held."""
    w = by_symbol().rowsBetween(1 - n, 0)
    x = panel.withColumn("beta", F.when(F.count(F.col("high")).over(w) == n, F.regr_slope("high", "low").over(w)))
    x = x.withColumn("z", F.try_divide(F.col("beta") - rolling(F.avg, "beta", look), rolling(F.stddev_samp, "beta", look)))
    at = F.col("idx") % every == 0
    set_at = F.when(at & (F.col("z") > edge), 1.0).when(at & (F.col("z") < -edge), 0.0)
    return x.withColumn("gate", F.last(set_at, ignorenulls=True).over(by_symbol()))


def running_median(panel: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the median of all values of the symbol up to the row (missing ones don't count; null before the first).

    Symbols stream by in the order of their rows.  The lower and the upper half of what was seen are two heaps, so a row
    costs the logarithm of their size, where a window over all rows so far would sort them anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, low, high = None, [], []  # low: negated, its largest value first
        for batch in batches:
            medians = []
            for symbol, v in zip(batch.column("symbol").to_pylist(), batch.column(value).to_pylist(), strict=True):
                if symbol != owner:
                    owner, low, high = symbol, [], []
                if v is not None:
                    if low and v <= -low[0]:
                        heapq.heappush(low, -v)
                    else:
                        heapq.heappush(high, v)
                    if len(low) > len(high):
                        heapq.heappush(high, -heapq.heappop(low))
                    elif len(high) > len(low) + 1:
                        heapq.heappush(low, -heapq.heappop(high))
                medians.append(None if not high else high[0] if len(high) > len(low) else (high[0] - low[0]) / 2)
            yield batch.append_column(out, pa.array(medians, pa.float64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields), f"`{out}` double"])
    return panel.repartition("symbol").sortWithinPartitions("symbol", "idx").mapInArrow(run, schema)


def dynamic_leverage(panel: DataFrame, n: int = 63, warm: int = 252, every: int = 21, most: float = 2.3) -> DataFrame:
    """Adds leverage: most x (median volatility so far / volatility), within [1, most], set at cycle rows and held."""
    x = running_median(panel.withColumn("_vol", rolling_vol(n)), "_vol", "_median")
    median = F.when(F.count("_vol").over(by_symbol()) >= warm, F.col("_median"))
    level = F.greatest(F.lit(1.0), F.least(F.lit(most), most * F.try_divide(median, F.col("_vol"))))
    set_at = F.when((F.col("idx") % every == 0) & median.isNotNull(), level)
    return x.withColumn("_set", set_at).withColumn("leverage", F.last("_set", ignorenulls=True).over(by_symbol())).drop("_vol", "_median", "_set")


def unsmoothed(panel: DataFrame) -> DataFrame:
    """Adds phi (lag-1 autocorrelation by symbol) and the unsmoothed return (r - phi r_before) / (1 - phi)."""
    x = panel.withColumn("_before", F.lag("ret").over(by_symbol()))
    phi = x.groupBy("symbol").agg(F.corr("ret", "_before").alias("phi"))
    return x.join(phi, "symbol").withColumn("unsmoothed", F.try_divide(F.col("ret") - F.col("phi") * F.col("_before"), 1 - F.col("phi"))).drop("_before")


def spread_z(panel: DataFrame, a: str, b: str, beta: float, n: int = 60) -> DataFrame:
    """idx, spread (a - beta b) and its z-score over the last n rows."""
    one = panel.sparkSession.createDataFrame([(f"{a}|{b}", a, b, float(beta))], "pair string, a string, b string, beta double")
    return pair_spreads(panel, one, n).select("idx", "spread", "z")


def pair_spreads(panel: DataFrame, pairs: DataFrame, n: int = 60) -> DataFrame:
    """pair, idx, spread and z of many pairs (pair, a, b, beta) at once, each a partition of its own."""
    one, two = (panel.select(F.col("symbol").alias(s), "idx", F.col("px").alias(f"_{s}")) for s in "ab")
    x = pairs.join(one, "a").join(two, ["b", "idx"]).select("pair", "idx", (F.col("_a") - F.col("beta") * F.col("_b")).alias("spread"))
    w = Window.partitionBy("pair").orderBy("idx")
    return x.withColumn("z", F.try_divide(F.col("spread") - rolling(F.avg, "spread", n, w), rolling(F.stddev_samp, "spread", n, w)))


def knife_edge(panel: DataFrame, looks: Sequence[int], near: float = 0.005) -> DataFrame:
    """symbol, idx, look, mom of lookback returns that are nearly zero."""
    each = F.array(*[F.struct(F.lit(n).alias("look"), F.col(f"_m{n}").alias("mom")) for n in looks])
    x = panel.withColumns({f"_m{n}": momentum(0, n) for n in looks})
    return x.select("symbol", "idx", F.explode(each).alias("k")).select("symbol", "idx", "k.*").where(F.abs("mom") < near)


def rolling_beta(panel: DataFrame, market: str, n: int = 63) -> DataFrame:
    """Adds beta of each symbol's returns on the market symbol's over the last n rows."""
    m = panel.where(F.col("symbol") == market).select("idx", F.col("ret").alias("_m"))
    x = panel.join(m, "idx").withColumn("_both", F.when(F.col("_m").isNotNull(), F.col("ret")))
    w = by_symbol().rowsBetween(1 - n, 0)
    return x.withColumn("beta", F.when(F.count("_both").over(w) == n, F.regr_slope("_both", "_m").over(w))).drop("_m", "_both")
