"""Performance of equity curves (run_id, dt, equity), by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

YEAR = 252

def _run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("dt")


def with_returns(curves: DataFrame) -> DataFrame:
    """Adds ret (NULL on a run's first row), peak and drawdown."""
    peak = F.max("equity").over(_run())
    return curves.withColumns({"ret": F.col("equity") / F.lag("equity").over(_run()) - 1, "peak": peak, "drawdown": F.col("equity") / peak - 1})


def underwater_days(curves: DataFrame) -> DataFrame:
    """run_id, max_dd_days: calendar days from the peak before a dip to its recovery, or to the end."""
    x = with_returns(curves).withColumn("_under", F.col("drawdown") < 0)
    before = _run().rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_peak_dt": F.last(F.when(~F.col("_under"), F.col("dt")), ignorenulls=True).over(before), "_was": F.lag("_under").over(_run())})
    days = F.max(F.when(F.col("_under") | F.col("_was"), F.datediff("dt", "_peak_dt")))
    return x.groupBy("run_id").agg(F.coalesce(days, F.lit(0)).alias("max_dd_days"))


def _measures(rf: float) -> dict[str, Column]:
    excess = F.col("ret") - rf / YEAR
    first, last = F.min_by("equity", "dt"), F.max_by("equity", "dt")
    days = F.datediff(F.max("dt"), F.min("dt"))
    std = F.stddev_samp("ret")
    downside = F.sqrt(F.avg(F.when(F.col("ret").isNotNull(), F.pow(F.least(excess, F.lit(0.0)), 2))))
    cagr = F.when(days > 0, F.pow(last / first, 365.25 / days) - 1)
    return {
        "total_return": last / first - 1,
        "cagr": cagr,
        "ann_vol": std * YEAR**0.5,
        "sharpe": F.when(std > 0, F.avg(excess) / std * YEAR**0.5),
        "sortino": F.when(downside > 0, F.avg(excess) / downside * YEAR**0.5),
        "max_drawdown": F.min("drawdown"),
        "calmar": F.try_divide(cagr, F.abs(F.min("drawdown"))),
    }


def summary(curves: DataFrame, rf: float = 0.0) -> DataFrame:
    """All metrics of each run in one grouped pass over its returns."""
    x = with_returns(curves).groupBy("run_id").agg(*[v.alias(k) for k, v in _measures(rf).items()])
    return x.join(underwater_days(curves), "run_id")


def excess_sharpe(curves: DataFrame, rates: DataFrame) -> DataFrame:
    """Sharpe of returns over dated rates: both the mean and the deviation are of the excess."""
    x = with_returns(curves).where("ret is not null").join(rates, "dt").withColumn("x", F.col("ret") - F.col("rf") / YEAR)
    std = F.stddev_samp("x")
    return x.groupBy("run_id").agg(F.when(std > 0, F.avg("x") / std * YEAR**0.5).alias("excess_sharpe"))


def window_stats(curves: DataFrame, windows: DataFrame, rf: float = 0.0) -> DataFrame:
    """Metrics inside named date windows (name, start, end), both ends included."""
    inside = curves.join(windows.withColumn("dt", F.explode(F.expr("sequence(start, end)"))), "dt")  # by the day, so that no range is searched
    keyed = inside.withColumn("run_id", F.struct("run_id", "name"))
    return summary(keyed, rf).select("run_id.run_id", "run_id.name", *_measures(rf), "max_dd_days")


def tracking(curves: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Annual edge and tracking error over a benchmark curve, and the years to t = 1 and t = 2."""
    a = with_returns(curves).where("ret is not null").select("run_id", "dt", "ret")
    b = with_returns(benchmark).where("ret is not null").select("dt", F.col("ret").alias("_b"))
    x = a.join(b, "dt").withColumn("d", F.col("ret") - F.col("_b")).groupBy("run_id").agg((F.avg("d") * YEAR).alias("edge"), (F.stddev_samp("d") * YEAR**0.5).alias("te"))
    years = F.pow(F.try_divide(F.col("te"), F.col("edge")), 2)
    return x.withColumns({"years_t1": years, "years_t2": 4 * years})


def distribution(values: DataFrame, by: str, value: str) -> DataFrame:
    return values.groupBy(by).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("spread")
    )


def rebased(curves: DataFrame, start: str, end: str, base: float = 10_000.0) -> DataFrame:
    """Curves within [start, end], starting at ``base``."""
    inside = curves.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.withColumn("equity", F.col("equity") / F.first("equity").over(_run()) * base)
