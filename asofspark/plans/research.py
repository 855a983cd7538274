"""Queries on factor observations, pairs and resampling over the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.operators import metrics as me
from asofspark.operators import panel as pn
from asofspark.operators import research as rs
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt
from asofspark.plans.common import rounded
from asofspark.plans.portfolio import CURVES, LEGS, _r, curves, legs
from asofspark.plans.timeseries import BY, PAIRS, PANEL, mom, roll
from asofspark.plans.timeseries import SQL as TS_SQL
from asofspark.sources import driver_tables as dt

FACTORS = {"mom52": True, "mom13": True, "vol26": False, "amount": True}


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, name): four factors and the next 13 weeks' return."""
    p = pn.panel(dt.bars(spark, sf_dir))
    fwd = F.lead("px", 13).over(ts.by_symbol()) / F.col("px") - 1
    x = p.withColumns({"mom52": ts.momentum(4, 52), "mom13": ts.momentum(0, 13), "vol26": ts.rolling_vol(26, 52), "amount": F.col("volume"), "fwd": fwd})
    return x.where((F.col("idx") % 13 == 4) & (F.col("idx") >= 56) & F.col("fwd").isNotNull()).select(F.col("dt").alias("date"), F.col("symbol").alias("name"), *FACTORS, "fwd")


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.rank_signals(obs(spark, sf_dir), FACTORS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = pn.panel(dt.bars(spark, sf_dir)).select("symbol").distinct().withColumn("grp", F.substring("symbol", -1, 1))
    return wt.candidate_pairs(members)


def grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In- and out-of-sample log growth of all (symbol, pair) runs: run_id, in_sample, out_sample."""
    g = ts.sma_grid(pn.panel(dt.bars(spark, sf_dir)), PAIRS)
    w = Window.partitionBy("run_id", "symbol").orderBy("idx")
    x = g.withColumn("_x", F.coalesce(F.lag("signal").over(w), F.lit(0.0)) * F.log(F.col("px") / F.lag("px").over(w)))
    part = F.col("idx") < 180
    return x.groupBy(F.concat_ws("|", "symbol", "run_id").alias("run_id")).agg(F.sum(F.when(part, F.col("_x"))).alias("in_sample"), F.sum(F.when(~part, F.col("_x"))).alias("out_sample"))


SCHEMES = [("momentum", "mom52", 0.5), ("momentum", "mom13", 0.5), ("calm", "vol26", 0.7), ("calm", "amount", 0.3), ("equal", "mom52", 0.25), ("equal", "mom13", 0.25), ("equal", "vol26", 0.25), ("equal", "amount", 0.25)]
OBS = f"""{PANEL}, ob0 AS (SELECT dt AS date, symbol AS name, idx, {mom(4, 52)} AS mom52, {mom(0, 13)} AS mom13, ({roll('stddev_samp', 'ret', 26)}) * sqrt(52) AS vol26, volume AS amount, lead(px, 13) OVER ({BY}) / px - 1 AS fwd FROM rets),
obs AS (SELECT * FROM ob0 WHERE idx % 13 = 4 AND idx >= 56 AND fwd IS NOT NULL),
lg AS (SELECT date, name, fwd, factor, v FROM obs, LATERAL (SELECT 'mom52' AS factor, mom52 AS v UNION ALL SELECT 'mom13', mom13 UNION ALL SELECT 'vol26', -vol26 UNION ALL SELECT 'amount', amount)),
rk AS (SELECT *, CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY date, factor, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY date, factor, v) - 1) / 2.0) / count(v) OVER (PARTITION BY date, factor) END AS pct,
  (rank() OVER (PARTITION BY date, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY date, factor, fwd) - 1) / 2.0) / count(*) OVER (PARTITION BY date, factor) AS fwd_pct FROM lg),
ic AS (SELECT date, factor, corr(pct, fwd_pct) AS ic FROM rk GROUP BY 1, 2)"""
PAIR = f"""{PANEL}, mem AS (SELECT DISTINCT symbol, right(symbol, 1) AS grp FROM panel), prs AS (SELECT x.symbol AS a, y.symbol AS b FROM mem x JOIN mem y USING (grp) WHERE x.symbol < y.symbol),
pr AS (SELECT a || '|' || b AS pair, a, b, x.dt, x.px AS pa, y.px AS pb FROM prs JOIN panel x ON x.symbol = a JOIN panel y ON y.symbol = b AND y.dt = x.dt),
ft AS (SELECT pair, a, b, regr_slope(pa, pb) AS beta, regr_intercept(pa, pb) AS alpha, count(*) AS n FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 60),
rd AS (SELECT pair, dt, pa - alpha - beta * pb AS s FROM pr JOIN ft USING (pair)),
d1 AS (SELECT *, lag(s) OVER (PARTITION BY pair ORDER BY dt) AS l, s - lag(s) OVER (PARTITION BY pair ORDER BY dt) AS y FROM rd), d2 AS (SELECT *, lag(y) OVER (PARTITION BY pair ORDER BY dt) AS z FROM d1),
ss AS (SELECT pair, count(*) AS n, count(*) * covar_pop(l, l) AS s11, count(*) * covar_pop(z, z) AS s22, count(*) * covar_pop(l, z) AS s12, count(*) * covar_pop(l, y) AS s1y, count(*) * covar_pop(z, y) AS s2y, count(*) * covar_pop(y, y) AS syy FROM d2 WHERE z IS NOT NULL GROUP BY 1),
ad AS (SELECT pair, n, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / d) AS adf_t FROM (SELECT *, (s1y * s22 - s2y * s12) / d AS b1, (s2y * s11 - s1y * s12) / d AS b2 FROM (SELECT *, s11 * s22 - s12 * s12 AS d FROM ss))),
hl AS (SELECT pair, -ln(2) / nullif(regr_slope(y, l), 0) AS half_life, regr_slope(y, l) AS theta FROM d1 WHERE l IS NOT NULL GROUP BY 1)"""
GRID = f"""{PANEL}, gr AS (SELECT p.symbol || '|' || v.f || '-' || v.s AS run_id, p.idx, p.px, CASE WHEN (CASE v.f WHEN 5 THEN m5 ELSE m10 END) > (CASE v.s WHEN 20 THEN m20 ELSE m40 END) THEN 1.0 ELSE 0.0 END AS signal
  FROM (SELECT *, {", ".join(f"{roll('avg', 'px', n)} AS m{n}" for n in (5, 10, 20, 40))} FROM panel) p, (VALUES (5, 20), (5, 40), (10, 20), (10, 40)) v(f, s)),
gx AS (SELECT run_id, idx, coalesce(lag(signal) OVER w, 0) * ln(px / lag(px) OVER w) AS x FROM gr WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
res AS (SELECT run_id, sum(x) FILTER (WHERE idx < 180) AS in_sample, sum(x) FILTER (WHERE idx >= 180) AS out_sample FROM gx GROUP BY 1)"""


def q_ranks(spark, d):
    return rounded(ranks(spark, d).select("date", "name", "factor", "pct", "fwd_pct"))


def q_ic(spark, d):
    return rounded(rs.ic_table(ranks(spark, d)))


def q_subperiod(spark, d):
    p = spark.createDataFrame([("early", "1996-01-01", "1998-06-30"), ("late", "1998-07-01", "2001-12-31")], "period string, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    return rounded(rs.subperiod_ic(ranks(spark, d), p))


def q_factor_corr(spark, d):
    return rounded(rs.factor_corr(ranks(spark, d)))


def q_quintile(spark, d):
    return rounded(rs.quintile_spread(ranks(spark, d)), 5)


def q_bakeoff(spark, d):
    s = spark.createDataFrame(SCHEMES, "scheme string, factor string, weight double")
    return rounded(rs.bakeoff(ranks(spark, d), s, 5, 3).drop("cum"), 5)


def q_fama(spark, d):
    return rounded(rs.fama_macbeth(ranks(spark, d), list(FACTORS)))


def q_candidates(spark, d):
    return pairs(spark, d)


def q_hedge(spark, d):
    fit, _ = rs.hedge_ratios(pairs(spark, d), pn.panel(dt.bars(spark, d)))
    return rounded(fit.select("pair", "beta", "alpha", "n"))


def q_adf(spark, d):
    _, resid = rs.hedge_ratios(pairs(spark, d), pn.panel(dt.bars(spark, d)))
    return rounded(rs.adf_tstat(resid, "pair", "resid", "dt"), 4)


def q_half_life(spark, d):
    _, resid = rs.hedge_ratios(pairs(spark, d), pn.panel(dt.bars(spark, d)))
    return rounded(rs.half_life(resid, "pair", "resid", "dt"), 5)


def q_find_pairs(spark, d):
    return rounded(rs.find_pairs(pairs(spark, d), pn.panel(dt.bars(spark, d)), -3.34, 0.1, 252).select("pair", "beta", "adf_t", "half_life"), 4)


def q_positions(spark, d):
    z = ts.spread_z(pn.panel(dt.bars(spark, d)), "Brand#1", "Brand#2", 0.8, 30).select(F.lit("1|2").alias("pair"), F.col("idx").cast("long").alias("idx"), "z")
    return rounded(wt.pair_positions(z, 1.5, 0.3, 4.0).select("idx", F.col("position").cast("long").alias("position")))


def _returns(spark, d):
    return me.with_returns(curves(spark, d)).where("ret is not null")


def q_moments(spark, d):
    return rounded(rs.moments(_returns(spark, d)), 5)


def q_psr(spark, d):
    return rounded(rs.psr(rs.moments(_returns(spark, d))), 5)


def q_dsr(spark, d):
    m = rs.moments(_returns(spark, d))
    return rounded(rs.deflated_sharpe(m, m.select((F.col("sharpe") * 252**0.5).alias("sharpe_annual"))), 5)


def q_grid_rank(spark, d):
    g = grid_results(spark, d).withColumn("symbol", F.split("run_id", r"\|")[0])
    return rounded(rs.grid_rank(g, ["symbol"], "in_sample").select("symbol", "run_id", "in_sample", "out_sample"), 5)


def q_proxy(spark, d):
    return rounded(rs.proxy_validation(legs(spark, d)))


def q_reconcile(spark, d):
    c = curves(spark, d)
    one = lambda s, n: c.where(F.col("run_id") == s).select("dt", F.col("equity").alias(n))
    return rounded(rs.reconcile(one("Brand#1", "ea").join(one("Brand#3", "eb"), "dt")), 5)


def q_compare(spark, d):
    c = curves(spark, d).where("(run_id <> 'Brand#2' or dt >= date'1996-01-01') and (run_id <> 'Brand#3' or dt < date'2001-01-01')")
    return rounded(rs.compare_books(c), 3)


def q_variance(spark, d):
    """Sharpe of the equal-weight mean of all returns against each name's."""
    x = pn.panel(dt.bars(spark, d)).where("ret is not null")
    mean = x.groupBy("dt").agg(F.avg("ret").alias("ret")).select(F.lit("mean").alias("run_id"), "ret").unionByName(x.select(F.col("symbol").alias("run_id"), "ret"))
    return rounded(mean.groupBy("run_id").agg((F.avg("ret") / F.stddev_samp("ret") * 252**0.5).alias("sharpe")))


QUERIES = {
    "R5_rank_signals": q_ranks, "X1_ic_table": q_ic, "X10_subperiod_ic": q_subperiod, "X2_factor_corr": q_factor_corr, "X3_quintile_spread": q_quintile, "X4_bakeoff": q_bakeoff,
    "X9_fama_macbeth": q_fama, "W19_candidate_pairs": q_candidates, "X11_hedge_ratio": q_hedge, "X12_adf_tstat": q_adf, "X14_half_life": q_half_life, "X13_find_pairs": q_find_pairs,
    "W20_pair_positions": q_positions, "X15_moments": q_moments, "X15_psr": q_psr, "X16_deflated_sharpe": q_dsr,
    "X20_R10_grid_rank": q_grid_rank, "X26_proxy_validation": q_proxy, "X27_reconcile": q_reconcile, "X32_compare_books": q_compare, "X30_variance_compare": q_variance,
}
def cdf_sql(x: str) -> str:
    """Normal distribution function in SQL: the same published approximation of the tail."""
    horner = lambda c: "(" * (len(c) - 1) + repr(c[-1]) + "".join(f" * y + {t!r})" for t in c[-2::-1])
    top = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2]
    low = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2]
    tail = f"CASE WHEN y < 7.07106781186547 THEN exp(-y * y / 2) * {horner(top)} / {horner(low)} ELSE exp(-y * y / 2) / ((y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65))))) * 2.506628274631) END"
    return f"(SELECT CASE WHEN z > 0 THEN 1 - t WHEN z <= 0 THEN t END FROM (SELECT z, {tail} AS t FROM (SELECT {x} AS z, least(abs({x}), 37.0) AS y)))"


def quantile_sql(p: str) -> str:
    """Normal quantile of p between 0.02425 and 0.97575 or above, in SQL."""
    horner = lambda c, v: "(" * (len(c) - 1) + repr(c[0]) + "".join(f" * {v} + {t!r})" for t in c[1:])
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    e = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
    q, r = f"sqrt(-2 * ln(1 - {p}))", f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} > 0.97575 THEN -({horner(c, q)} / {horner(e, q)}) ELSE ({p} - 0.5) * {horner(a, r)} / {horner(b, r)} END"


MOMENTS = f"""{CURVES}, r1 AS (SELECT run_id, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY dt) - 1 AS x FROM curves), r2 AS (SELECT run_id, x AS ret FROM r1 WHERE x IS NOT NULL), s AS (SELECT run_id, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd FROM r2 GROUP BY 1),
mo AS (SELECT run_id, any_value(n) AS n, any_value(m / sd) AS sharpe, avg(pow((ret - m) / sd, 3)) AS skew, avg(pow((ret - m) / sd, 4)) AS kurtosis FROM r2 JOIN s USING (run_id) GROUP BY 1)"""
_ROOT = "sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12))"
SQL = {
    "R5_rank_signals": f"{OBS} SELECT date, name, factor, {_r(['pct', 'fwd_pct'])} FROM rk",
    "X1_ic_table": f"{OBS} SELECT factor, round(avg(ic), 6) + 0.0 AS mean_ic, round(stddev_samp(ic), 6) + 0.0 AS std_ic, round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) + 0.0 AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit, count(ic) AS periods FROM ic WHERE ic IS NOT NULL GROUP BY 1",
    "X10_subperiod_ic": f"{OBS}, p(period, a, b) AS (VALUES ('early', DATE '1996-01-01', DATE '1998-06-30'), ('late', DATE '1998-07-01', DATE '2001-12-31')) SELECT period, factor, round(avg(ic), 6) + 0.0 AS mean_ic FROM ic JOIN p ON date BETWEEN a AND b WHERE ic IS NOT NULL GROUP BY 1, 2",
    "X2_factor_corr": f"{OBS}, c AS (SELECT x.date, x.factor AS f1, y.factor AS f2, corr(x.pct, y.pct) AS c FROM rk x JOIN rk y ON x.date = y.date AND x.name = y.name AND x.factor <= y.factor GROUP BY 1, 2, 3) SELECT f1, f2, round(avg(c), 6) + 0.0 AS corr FROM c WHERE c IS NOT NULL GROUP BY 1, 2",
    "X3_quintile_spread": f"{OBS}, s AS (SELECT date, factor, avg(CASE WHEN pct >= 0.8 THEN fwd END) - avg(CASE WHEN pct <= 0.2 THEN fwd END) AS s FROM rk GROUP BY 1, 2) SELECT factor, round(avg(s), 5) + 0.0 AS spread FROM s GROUP BY 1",
    "X4_bakeoff": f"""{OBS}, sch(scheme, factor, weight) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in SCHEMES)}), el AS (SELECT date, name FROM rk WHERE pct IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
sc AS (SELECT scheme, date, name, fwd, round(sum(pct * weight) / sum(weight), 9) AS score FROM rk JOIN el USING (date, name) JOIN sch USING (factor) WHERE pct IS NOT NULL GROUP BY 1, 2, 3, 4),
pl AS (SELECT *, row_number() OVER (PARTITION BY scheme, date ORDER BY score DESC, name) AS p, avg(fwd) OVER (PARTITION BY scheme, date) AS u FROM sc), dd AS (SELECT scheme, date, avg(fwd) AS r, avg(fwd) - any_value(u) AS x FROM pl WHERE p <= 5 GROUP BY 1, 2)
SELECT scheme, round(avg(r), 5) + 0.0 AS mean, round(avg(x), 5) + 0.0 AS excess, round(avg(x) / stddev_samp(x) * 2, 5) + 0.0 AS sharpe, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS beat FROM dd GROUP BY 1""",
    "W19_candidate_pairs": f"{PAIR} SELECT x.grp, x.symbol AS a, y.symbol AS b FROM mem x JOIN mem y USING (grp) WHERE x.symbol < y.symbol",
    "W20_pair_positions": f"""WITH RECURSIVE t AS ({TS_SQL["T21_spread_z"]}), s AS (SELECT idx, z, row_number() OVER (ORDER BY idx) AS k FROM t),
p AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos UNION ALL SELECT s.k, CAST(CASE WHEN z IS NULL THEN pos WHEN pos = 0 THEN CASE WHEN abs(z) > 1.5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END WHEN abs(z) < 0.3 OR abs(z) > 4.0 THEN 0 ELSE pos END AS BIGINT) FROM p JOIN s ON s.k = p.k + 1)
SELECT idx, pos AS position FROM p JOIN s USING (k)""",
    "X15_psr": f"{MOMENTS}, q AS (SELECT *, sharpe * sqrt(n - 1) / {_ROOT} AS zz FROM mo) SELECT run_id, n, {_r(['sharpe', 'skew', 'kurtosis'], 5)}, round({cdf_sql('zz')}, 5) + 0.0 AS psr FROM q",
    "X16_deflated_sharpe": f"""{MOMENTS}, tr AS (SELECT var_samp(sharpe * sqrt(252)) AS v, count(*) AS k FROM mo), h AS (SELECT sqrt(v) * ((1 - 0.5772156649015329) * {quantile_sql('(1 - 1.0 / k)')} + 0.5772156649015329 * {quantile_sql('(1 - 1.0 / (k * 2.718281828459045))')}) / sqrt(252) AS hurdle FROM tr),
q AS (SELECT mo.*, hurdle, (sharpe - hurdle) * sqrt(n - 1) / {_ROOT} AS zz FROM mo, h) SELECT run_id, n, {_r(['sharpe', 'skew', 'kurtosis', 'hurdle'], 5)}, round({cdf_sql('zz')}, 5) + 0.0 AS dsr FROM q""",
    "X11_hedge_ratio": f"{PAIR} SELECT pair, {_r(['beta', 'alpha'])}, n FROM ft",
    "X12_adf_tstat": f"{PAIR} SELECT pair, n, round(adf_t, 4) + 0.0 AS adf_t FROM ad",
    "X14_half_life": f"{PAIR} SELECT pair, round(CASE WHEN theta < 0 THEN half_life ELSE CAST('inf' AS DOUBLE) END, 5) + 0.0 AS half_life FROM hl",
    "X13_find_pairs": f"{PAIR} SELECT pair, {_r(['beta', 'adf_t', 'half_life'], 4)} FROM ft JOIN ad USING (pair) JOIN hl USING (pair) WHERE adf_t < -3.34 AND beta > 0 AND theta < 0 AND half_life BETWEEN 0.1 AND 252",
    "X15_moments": f"{CURVES}, r AS (SELECT run_id, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY dt) - 1 AS ret, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY dt) AS g FROM curves), s AS (SELECT run_id, count(g) AS n, avg(ret) AS m, stddev_samp(ret) AS sd FROM r WHERE g IS NOT NULL GROUP BY 1) SELECT run_id, any_value(n) AS n, round(any_value(m / sd), 5) + 0.0 AS sharpe, round(avg(pow((ret - m) / sd, 3)), 5) + 0.0 AS skew, round(avg(pow((ret - m) / sd, 4)), 5) + 0.0 AS kurtosis FROM r JOIN s USING (run_id) WHERE g IS NOT NULL GROUP BY 1",
    "X20_R10_grid_rank": f"{GRID}, p AS (SELECT *, split_part(run_id, '|', 1) AS symbol, row_number() OVER (PARTITION BY split_part(run_id, '|', 1) ORDER BY in_sample DESC NULLS LAST, run_id) AS p FROM res) SELECT symbol, run_id, {_r(['in_sample', 'out_sample'], 5)} FROM p WHERE p = 1",
    "X26_proxy_validation": f"{LEGS} SELECT round(corr(ra, rb), 6) + 0.0 AS corr, round(stddev_samp(ra) / stddev_samp(rb), 6) + 0.0 AS vol_ratio, count(*) AS n FROM legs",
    "X27_reconcile": f"""{CURVES}, x AS (SELECT a.dt, a.equity AS ea, b.equity AS eb FROM curves a JOIN curves b ON a.dt = b.dt AND a.run_id = 'Brand#1' AND b.run_id = 'Brand#3'), y AS (SELECT *, ea / lag(ea) OVER (ORDER BY dt) - 1 AS a, eb / lag(eb) OVER (ORDER BY dt) - 1 AS b FROM x),
z AS (SELECT corr(a, b) AS corr, (arg_max(ea, dt) / arg_min(ea, dt)) / (arg_max(eb, dt) / arg_min(eb, dt)) AS ratio, abs(avg(a) / stddev_samp(a) - avg(b) / stddev_samp(b)) * sqrt(252) AS d_sharpe FROM y) SELECT {_r(['corr', 'ratio', 'd_sharpe'], 5)}, corr >= 0.999 AND abs(ratio - 1) <= 0.01 AND d_sharpe <= 0.02 AS agree FROM z""",
    "X32_compare_books": f"{CURVES}, c AS (SELECT * FROM curves WHERE (run_id <> 'Brand#2' OR dt >= DATE '1996-01-01') AND (run_id <> 'Brand#3' OR dt < DATE '2001-01-01')), s AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(dt) AS a, max(dt) AS b FROM c GROUP BY run_id)) SELECT run_id, dt, round(equity / first_value(equity) OVER (PARTITION BY run_id ORDER BY dt) * 10000, 3) + 0.0 AS equity FROM c, s WHERE dt BETWEEN a AND b",
    "X30_variance_compare": f"{PANEL}, m AS (SELECT 'mean' AS run_id, avg(ret) AS ret FROM rets WHERE ret IS NOT NULL GROUP BY dt UNION ALL SELECT symbol, ret FROM rets WHERE ret IS NOT NULL) SELECT run_id, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) + 0.0 AS sharpe FROM m GROUP BY 1",
}
