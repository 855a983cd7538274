"""Factor research, pairs and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.operators.ranking import pct_rank


def rank_signals(obs: DataFrame, factors: dict[str, bool], fwd: str = "fwd") -> DataFrame:
    """date, name, factor, pct, fwd_pct: per-date percentiles (0 to 1) of each factor in its good direction and of the return.

    Factors are unpivoted first, so one window ranks them all; ``factors`` tells whether more is better.
    """
    x = obs.withColumn("fwd_pct", pct_rank(fwd, True, ("date",)) / 100)
    long = x.unpivot(["date", "name", fwd, "fwd_pct"], list(factors), "factor", "value")
    down = [f for f, up in factors.items() if not up]
    signed = F.when(F.col("factor").isin(down), -F.col("value")).otherwise(F.col("value")) if down else F.col("value")
    return long.withColumn("_v", signed).withColumn("pct", pct_rank("_v", True, ("date", "factor")) / 100).drop("_v")


def ic_table(ranks: DataFrame) -> DataFrame:
    """Per factor: mean and deviation of its per-date rank correlations with the return, IR, t, hit rate, periods."""
    daily = ranks.groupBy("date", "factor").agg(F.corr("pct", "fwd_pct").alias("ic")).where("ic is not null and not isnan(ic)")
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return daily.groupBy("factor").agg(m.alias("mean_ic"), s.alias("std_ic"), F.try_divide(m, s).alias("ir"), (F.try_divide(m, s) * F.sqrt(n)).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"), n.alias("periods"))


def subperiod_ic(ranks: DataFrame, periods: DataFrame) -> DataFrame:
    """Mean rank correlation of each factor within named periods (period, start, end)."""
    daily = ranks.groupBy("date", "factor").agg(F.corr("pct", "fwd_pct").alias("ic")).where("ic is not null and not isnan(ic)")
    days = periods.select("period", F.explode(F.expr("sequence(start, end)")).alias("date"))
    return daily.join(days, "date").groupBy("period", "factor").agg(F.avg("ic").alias("mean_ic"))


def factor_corr(ranks: DataFrame) -> DataFrame:
    """Mean over dates of the correlation between two factors' percentiles, f1 <= f2."""
    one = ranks.select("date", "name", F.col("factor").alias("f1"), F.col("pct").alias("p1"))
    two = ranks.select("date", "name", F.col("factor").alias("f2"), F.col("pct").alias("p2"))
    daily = one.join(two, ["date", "name"]).where("f1 <= f2").groupBy("date", "f1", "f2").agg(F.corr("p1", "p2").alias("c")).where("c is not null and not isnan(c)")
    return daily.groupBy("f1", "f2").agg(F.avg("c").alias("corr"))


def quintile_spread(ranks: DataFrame, fwd: str = "fwd") -> DataFrame:
    """Mean over dates of the top fifth's return less the bottom fifth's."""
    top, low = F.avg(F.when(F.col("pct") >= 0.8, F.col(fwd))), F.avg(F.when(F.col("pct") <= 0.2, F.col(fwd)))
    return ranks.groupBy("date", "factor").agg((top - low).alias("s")).groupBy("factor").agg(F.avg("s").alias("spread"))


def bakeoff(ranks: DataFrame, schemes: DataFrame, n: int = 20, least: int = 4, fwd: str = "fwd") -> DataFrame:
    """Per scheme of factor weights: mean return of its top n, excess over the universe, compounded, Sharpe of 4 periods, beat rate.

    Scores are compared at 9 places, so that equal ones are ties (broken by name).
    """
    present = ranks.where("pct is not null")
    eligible = present.groupBy("date", "name").agg(F.count("factor").alias("_k")).where(F.col("_k") >= least).select("date", "name")
    scored = present.join(eligible, ["date", "name"]).join(schemes, "factor").groupBy("scheme", "date", "name", fwd).agg(F.round(F.sum(F.col("pct") * F.col("weight")) / F.sum("weight"), 9).alias("score"))
    w = Window.partitionBy("scheme", "date")
    x = scored.withColumns({"_p": F.row_number().over(w.orderBy(F.desc("score"), "name")), "_u": F.avg(fwd).over(w)})
    daily = x.where(F.col("_p") <= n).groupBy("scheme", "date").agg(F.avg(fwd).alias("r"), F.first("_u").alias("u")).withColumn("x", F.col("r") - F.col("u"))
    return daily.groupBy("scheme").agg(
        F.avg("r").alias("mean"), F.avg("x").alias("excess"), (F.product(1 + F.col("r")) - 1).alias("cum"),
        (F.try_divide(F.avg("x"), F.stddev_samp("x")) * 2.0).alias("sharpe"), F.avg((F.col("x") > 0).cast("double")).alias("beat"),
    )


def fama_macbeth(ranks: DataFrame, factors: list[str], least: int = 20) -> DataFrame:
    """factor, coef, t: mean of per-date regressions of the return's rank on all factors' ranks (missing: 0.5), t by the population deviation.

    A date's normal equations are sums over its names, made in SQL; only the small solve of
    each date is Python.
    """
    wide = ranks.groupBy("date", "name", "fwd_pct").pivot("factor", factors).agg(F.first("pct")).fillna(0.5, factors)
    cols = [F.lit(1.0), *[F.col(f) for f in factors]]
    p = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(cols[i] * F.col("fwd_pct")).alias(f"y{i}") for i in range(p)]
    eq = wide.where("fwd_pct is not null").groupBy("date").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)

    def solve(parts):
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                b, *_ = np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(p)]), rcond=None)
                rows += [(r["date"], f, float(v)) for f, v in zip(factors, b[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["date", "factor", "b"])

    each = eq.mapInPandas(solve, f"date {ranks.schema['date'].dataType.simpleString()}, factor string, b double")
    return each.groupBy("factor").agg(F.avg("b").alias("coef"), (F.try_divide(F.avg("b"), F.stddev_pop("b")) * F.sqrt(F.count("b"))).alias("t"))


def adf_tstat(series: DataFrame, key: str, s: str, order: str) -> DataFrame:
    """key, n, adf_t: t of the lagged level in ds ~ 1 + level + lagged ds, by centred sums."""
    w = Window.partitionBy(key).orderBy(order)
    x = series.withColumn("_1", F.lag(s).over(w)).withColumn("_y", F.col(s) - F.col("_1")).withColumn("_2", F.lag("_y").over(w)).where("_2 is not null")
    n = F.count(F.lit(1))
    cov = lambda a, b: n * F.covar_pop(a, b)
    m = x.groupBy(key).agg(n.alias("n"), cov("_1", "_1").alias("s11"), cov("_2", "_2").alias("s22"), cov("_1", "_2").alias("s12"), cov("_1", "_y").alias("s1y"), cov("_2", "_y").alias("s2y"), cov("_y", "_y").alias("syy"))
    m = m.withColumn("d", F.expr("s11 * s22 - s12 * s12"))
    m = m.withColumns({"b1": F.expr("try_divide(s1y * s22 - s2y * s12, d)"), "b2": F.expr("try_divide(s2y * s11 - s1y * s12, d)")})
    t = F.expr("try_divide(b1, sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / d))")
    return m.select(key, "n", t.alias("adf_t"))


def half_life(series: DataFrame, key: str, s: str, order: str) -> DataFrame:
    """key, half_life: -ln 2 / theta of ds on the lagged level; infinite without reversion."""
    w = Window.partitionBy(key).orderBy(order)
    x = series.withColumn("_1", F.lag(s).over(w)).withColumn("_y", F.col(s) - F.col("_1")).where("_1 is not null")
    theta = F.regr_slope("_y", "_1")
    return x.groupBy(key).agg(F.when(theta < 0, -math.log(2) / theta).otherwise(F.lit(float("inf"))).alias("half_life"))


def hedge_ratios(pairs: DataFrame, bars: DataFrame, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """(pair, a, b, beta, alpha, n) of pairs with enough common rows, and the residual series (pair, dt, resid)."""
    one = bars.select(F.col("symbol").alias("a"), "dt", F.col("px").alias("pa"))
    two = bars.select(F.col("symbol").alias("b"), "dt", F.col("px").alias("pb"))
    rows = pairs.withColumn("pair", F.concat_ws("|", "a", "b")).join(one, "a").join(two, ["b", "dt"])
    fit = rows.groupBy("pair", "a", "b").agg(F.regr_slope("pa", "pb").alias("beta"), F.regr_intercept("pa", "pb").alias("alpha"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    resid = rows.select("pair", "dt", "pa", "pb").join(fit.select("pair", "alpha", "beta"), "pair")
    return fit, resid.select("pair", "dt", (F.col("pa") - F.col("alpha") - F.col("beta") * F.col("pb")).alias("resid"))


def find_pairs(pairs: DataFrame, bars: DataFrame, critical: float = -3.34, shortest: float = 5, longest: float = 252) -> DataFrame:
    """Engle-Granger: pairs whose residual rejects a unit root, with a positive hedge ratio and a half-life in range."""
    fit, resid = hedge_ratios(pairs, bars)
    out = fit.join(adf_tstat(resid, "pair", "resid", "dt").drop("n"), "pair").join(half_life(resid, "pair", "resid", "dt"), "pair")
    return out.where((F.col("adf_t") < critical) & (F.col("beta") > 0) & F.col("half_life").between(shortest, longest))


def moments(returns: DataFrame, key: str = "run_id", year: int = 252) -> DataFrame:
    """key, n, sharpe (per row), skew, kurtosis: of z-scores by the sample deviation, kurtosis not in excess."""
    m = returns.where("ret is not null").groupBy(key).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    x = returns.where("ret is not null").join(m, key).withColumn("z", (F.col("ret") - F.col("m")) / F.col("s"))
    return x.groupBy(key).agg(F.first("n").alias("n"), F.first(F.col("m") / F.col("s")).alias("sharpe"), F.avg(F.pow("z", 3)).alias("skew"), F.avg(F.pow("z", 4)).alias("kurtosis"))


def normal_cdf(x: Column) -> Column:
    """Normal distribution function as a column expression.

    Hart's rational approximation of the tail (published coefficients, relative error about 1e-15), as Spark has no error function.
    """
    top = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2]
    low = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2]
    y = F.least(F.abs(x), F.lit(37.0))

    def poly(terms: list[float]) -> Column:
        out = F.lit(terms[-1])
        for t in terms[-2::-1]:
            out = out * y + t
        return out

    near = F.exp(-y * y / 2) * poly(top) / poly(low)
    far = F.exp(-y * y / 2) / ((y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65))))) * 2.506628274631)
    tail = F.when(y < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).when(x <= 0, tail)


def psr(stats: DataFrame, benchmark: float | Column = 0.0) -> DataFrame:
    """Adds psr: the probability that the true Sharpe is above the benchmark, given skew and kurtosis."""
    sr = F.col("sharpe")
    inside = F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr, F.lit(1e-12))
    return stats.withColumn("_z", (sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(inside)).withColumn("psr", normal_cdf(F.col("_z"))).drop("_z")


def inverse_normal(p: Column) -> Column:
    """Quantile of the normal distribution: Acklam's published approximation."""
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]

    def poly(terms: list[float], x: Column) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    tail = lambda q: poly(c, F.sqrt(-2 * F.log(q))) / poly(d, F.sqrt(-2 * F.log(q)))
    r = (p - 0.5) * (p - 0.5)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise((p - 0.5) * poly(a, r) / poly(b, r))


def expected_max_sharpe(variance: Column, n: Column) -> Column:
    """Largest Sharpe that luck brings among n trials with this variance of Sharpes; NULL for fewer than two."""
    gamma, e = 0.5772156649015329, 2.718281828459045
    return F.when(n > 1, F.sqrt(variance) * ((1 - gamma) * inverse_normal(1 - 1 / n) + gamma * inverse_normal(1 - 1 / (n * e))))


def deflated_sharpe(stats: DataFrame, trials: DataFrame, year: int = 252) -> DataFrame:
    """psr() against the luck hurdle of a ledger of annual trial Sharpes (one number each); fewer than two trials raise an error when computed."""
    ledger = trials.agg(F.var_samp("sharpe_annual").alias("_v"), F.count(F.lit(1)).alias("_n"))
    hurdle = F.when(F.col("_n") < 2, F.raise_error(F.lit("fewer than two trials")).cast("double")).otherwise(expected_max_sharpe(F.col("_v"), F.col("_n")) / F.sqrt(F.lit(float(year))))
    known = stats.join(F.broadcast(ledger.select(hurdle.alias("hurdle"))))  # one row
    return psr(known, F.col("hurdle")).withColumnRenamed("psr", "dsr")


def grid_rank(results: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Best run of each group by a metric; ties by run_id."""
    return results.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric), "run_id"))).where("_p = 1").drop("_p")


def proxy_validation(pair: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, corr, vol_ratio, n of two return streams (ra, rb) where both exist."""
    x = pair.where("ra is not null and rb is not null")
    return x.groupBy(*by).agg(F.corr("ra", "rb").alias("corr"), (F.stddev_samp("ra") / F.stddev_samp("rb")).alias("vol_ratio"), F.count(F.lit(1)).alias("n"))


def reconcile(pair: DataFrame, year: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """Checks two curves (dt, ea, eb) that should agree: return correlation, terminal ratio, Sharpe difference, and the verdict."""
    w = Window.partitionBy(*by).orderBy("dt")
    x = pair.withColumns({"_a": F.col("ea") / F.lag("ea").over(w) - 1, "_b": F.col("eb") / F.lag("eb").over(w) - 1})
    sharpe = lambda c: F.avg(c) / F.stddev_samp(c) * year**0.5
    ratio = (F.max_by("ea", "dt") / F.min_by("ea", "dt")) / (F.max_by("eb", "dt") / F.min_by("eb", "dt"))
    out = x.groupBy(*by).agg(F.corr("_a", "_b").alias("corr"), ratio.alias("ratio"), F.abs(sharpe("_a") - sharpe("_b")).alias("d_sharpe"))
    return out.withColumn("agree", (F.col("corr") >= 0.999) & (F.abs(F.col("ratio") - 1) <= 0.01) & (F.col("d_sharpe") <= 0.02))


def decompose_drag(obs: DataFrame, fields: list[str], control: str, fwd: str = "fwd", least: int = 5) -> DataFrame:
    """field, mean_ic, dates: rank correlation with the forward return of each percentile column, their mean and a control, on dates with ``least`` names.

    Correlations are Pearson's of average ranks, one grouped aggregate over all dates and fields.
    """
    named = [*fields, control]
    x = obs.where(F.col(fwd).isNotNull()).select("as_of", F.col(fwd).alias("_f"), *[F.col(c).cast("double").alias(c) for c in named])
    long = x.unpivot(["as_of", "_f"], named, "field", "v").where("v is not null")
    rank = lambda c: F.rank().over(Window.partitionBy("as_of", "field").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("as_of", "field", c)) - 1) / 2.0
    ic = long.withColumns({"_a": rank("v"), "_b": rank("_f")}).groupBy("field", "as_of").agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return ic.groupBy("field").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("dates"))


def dominance_verdict(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """Whether a candidate's distribution (median, least, median_dd) is above the base's in all three."""
    b = base.select(F.col("median").alias("_m"), F.col("least").alias("_l"), F.col("median_dd").alias("_d"))
    return candidate.join(F.broadcast(b)).withColumn("dominates", (F.col("median") > F.col("_m")) & (F.col("least") >= F.col("_l")) & (F.col("median_dd") >= F.col("_d"))).drop("_m", "_l", "_d")


def compare_books(curves: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """Curves cut to the dates between the latest start and the earliest end, rebased."""
    spans = curves.groupBy("run_id").agg(F.min("dt").alias("a"), F.max("dt").alias("b")).agg(F.max("a").alias("_a"), F.min("b").alias("_b"))
    x = curves.join(F.broadcast(spans)).where(F.col("dt").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return x.withColumn("equity", F.col("equity") / F.first("equity").over(Window.partitionBy("run_id").orderBy("dt")) * initial)
