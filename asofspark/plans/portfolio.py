"""Queries on curves, weights, locks and schedules over the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.operators import metrics as me
from asofspark.operators import panel as pn
from asofspark.operators import scoring as sc
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt
from asofspark.operators.observations import cache_obs, scratch
from asofspark.plans.common import rounded, significant_sql
from asofspark.plans.timeseries import PANEL, mom, r6, roll, schedule
from asofspark.sources import driver_tables as dt

LOOKS = (13, 26, 52)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.panel(dt.bars(spark, sf_dir))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.buy_and_hold(panel(spark, sf_dir))


def locks(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Every 13 weeks the k names of the best 12-1 momentum at equal weights: book, lock_date, symbol, w, price."""
    x = panel(spark, sf_dir).withColumn("mom", ts.momentum(4, 52)).where((F.col("idx") % 13 == 4) & (F.col("idx") >= 56) & F.col("mom").isNotNull())
    x = wt.top_k(x, k, ("idx",), "mom")
    return x.select(F.lit("mom").alias("book"), F.col("dt").alias("lock_date"), "symbol", F.lit(1.0 / k).alias("w"), F.col("px").alias("price"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).where("close is not null").select("symbol", "dt", F.col("close").alias("px"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = panel(spark, sf_dir).where("ret is not null")
    one = lambda s, n: x.where(F.col("symbol") == s).select("dt", F.col("ret").alias(n))
    return one("Brand#1", "ra").join(one("Brand#2", "rb"), "dt")


def trend(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals (run_id, mark, symbol, strength, vol) at cycle rows of two offsets, and the covariances there."""
    p = panel(spark, sf_dir)
    x = ts.trend_strength(p, LOOKS).withColumn("vol", ts.rolling_vol(26, 52))
    runs = spark.createDataFrame([("o0", 0), ("o7", 7)], "run_id string, offset int")
    at = x.join(F.broadcast(runs), (F.col("idx") % 26 == F.col("offset")) & (F.col("idx") >= 104))
    signals = at.select("run_id", F.col("idx").alias("mark"), "symbol", "strength", "vol")
    marks = signals.select(F.col("mark").alias("idx")).distinct()
    return signals, ts.rolling_cov(p, marks, 26, 52)


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


CURVES = f"{PANEL}, curves AS (SELECT symbol AS run_id, dt, 10000.0 * px / first_value(px) OVER (PARTITION BY symbol ORDER BY dt) AS equity FROM panel)"
CRET = f"""{CURVES}, cr AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER w - 1 AS dd FROM curves WINDOW w AS (PARTITION BY run_id ORDER BY dt)),
cu AS (SELECT *, dd < 0 AS under, lag(dd < 0) OVER w AS was, last_value(CASE WHEN NOT (dd < 0) THEN dt END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM cr WINDOW w AS (PARTITION BY run_id ORDER BY dt))"""
_M = """arg_max(equity, dt) / arg_min(equity, dt) - 1 AS total_return,
 CASE WHEN max(dt) > min(dt) THEN pow(arg_max(equity, dt) / arg_min(equity, dt), 365.25 / (max(dt) - min(dt))) - 1 END AS cagr, stddev_samp(ret) * sqrt(252) AS ann_vol,
 avg(ret - 0.02 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, avg(ret - 0.02 / 252) / nullif(sqrt(avg(pow(CASE WHEN ret IS NULL THEN NULL ELSE least(ret - 0.02 / 252, 0) END, 2))), 0) * sqrt(252) AS sortino,
 min(dd) AS max_drawdown, coalesce(max(CASE WHEN under OR was THEN dt - peak END), 0) AS max_dd_days"""
_MCOLS = ["total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar"]
LOCKS = f"""{PANEL}, lk0 AS (SELECT symbol, idx, dt, px, {mom(4, 52)} AS mom FROM panel),
lk1 AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY mom DESC, symbol) AS p FROM lk0 WHERE idx % 13 = 4 AND idx >= 56 AND mom IS NOT NULL),
locks AS (SELECT 'mom' AS book, dt AS lock_date, symbol, 0.2 AS w, px AS price FROM lk1 WHERE p <= 5),
prices AS (SELECT symbol, dt, close AS px FROM panel WHERE close IS NOT NULL),
segs AS (SELECT lock_date, coalesce(lead(lock_date) OVER (ORDER BY lock_date), (SELECT max(dt) FROM prices)) AS until, row_number() OVER (ORDER BY lock_date) AS k FROM (SELECT DISTINCT lock_date FROM locks)),
names AS (SELECT s.k, s.lock_date, s.until, l.symbol, l.w, l.price, coalesce(arg_max(p.px, p.dt) / l.price - 1, 0) AS r FROM locks l JOIN segs s USING (lock_date)
  LEFT JOIN prices p ON p.symbol = l.symbol AND p.dt > s.lock_date AND p.dt <= s.until GROUP BY 1, 2, 3, 4, 5, 6),
sr AS (SELECT k, lock_date, until, sum(w * r) AS seg_ret FROM names GROUP BY 1, 2, 3),
dr AS (SELECT n.k + 1 AS k, symbol, w * (1 + r) / (1 + seg_ret) AS d FROM names n JOIN sr USING (k)),
tn AS (SELECT coalesce(n.k, d.k) AS k, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover FROM names n FULL OUTER JOIN dr d ON n.k = d.k AND n.symbol = d.symbol GROUP BY 1),
scored AS (SELECT sr.*, coalesce(turnover, 0) AS turnover, 10000 * exp(sum(ln((1 - 0.001 * coalesce(turnover, 0)) * (1 + seg_ret))) OVER (ORDER BY k)) AS value, 1 - exp(sum(ln(1 - 0.001 * coalesce(turnover, 0))) OVER (ORDER BY k)) AS cum_cost FROM sr LEFT JOIN tn USING (k))"""
LEGS = f"{PANEL}, legs AS (SELECT a.dt, a.ret AS ra, b.ret AS rb FROM rets a JOIN rets b ON a.dt = b.dt AND a.symbol = 'Brand#1' AND b.symbol = 'Brand#2' WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"
_STR = " + ".join(f"CASE WHEN {mom(0, n)} > 0 THEN 1.0 WHEN {mom(0, n)} IS NOT NULL THEN 0.0 END" for n in LOOKS)
TREND = f"""{PANEL}, tr0 AS (SELECT symbol, idx, dt, ret, ({_STR}) / 3.0 AS strength, ({roll('stddev_samp', 'ret', 26)}) * sqrt(52) AS vol FROM rets),
runs(run_id, o) AS (VALUES ('o0', 0), ('o7', 7)), sig AS (SELECT run_id, idx AS mark, symbol, strength, vol FROM tr0 JOIN runs ON idx % 26 = o AND idx >= 104),
iv0 AS (SELECT *, strength / vol AS w0 FROM sig WHERE strength / vol <> 0), iv AS (SELECT run_id, mark, symbol, w0 / sum(abs(w0)) OVER (PARTITION BY run_id, mark) AS w FROM iv0),
cx AS (SELECT symbol, idx, ret, mark FROM tr0 JOIN (SELECT DISTINCT mark FROM sig) ON idx <= mark AND idx > mark - 26 WHERE ret IS NOT NULL),
cov AS (SELECT x.mark, x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) * 52 AS cov FROM cx x JOIN cx y ON x.mark = y.mark AND x.idx = y.idx AND x.symbol <= y.symbol GROUP BY 1, 2, 3 HAVING count(*) = 26),
pv AS (SELECT one.run_id, one.mark, sqrt(sum(one.w * two.w * cov * CASE WHEN a = b THEN 1 ELSE 2 END)) AS pvol FROM cov JOIN iv one ON one.mark = cov.mark AND one.symbol = a JOIN iv two ON two.run_id = one.run_id AND two.mark = cov.mark AND two.symbol = b GROUP BY 1, 2),
vt AS (SELECT iv.run_id, iv.mark, symbol, w * CASE WHEN pvol > 0 THEN least(0.3 / pvol, 1.0) ELSE 1.0 END AS w FROM iv LEFT JOIN pv USING (run_id, mark))"""


def q_summary(spark, d):
    return rounded(_long(me.summary(curves(spark, d), 0.02), "max_dd_days").select("run_id", *_MCOLS, "max_dd_days"), 5)


def q_excess(spark, d):
    return rounded(me.excess_sharpe(curves(spark, d), dt.rates(spark, d)))


def q_windows(spark, d):
    w = schedule(spark).select(F.year("start").cast("string").alias("name"), "start", "end")
    return rounded(_long(me.window_stats(curves(spark, d), w, 0.02), "max_dd_days"), 5)


def q_tracking(spark, d):
    c = curves(spark, d)
    return rounded(me.tracking(c, c.where("run_id = 'Brand#1'").drop("run_id").withColumn("run_id", F.lit("b"))).where("run_id <> 'Brand#1'").select("run_id", "edge", "te"))


def q_distribution(spark, d):
    s = me.summary(curves(spark, d)).withColumn("grp", F.substring("run_id", -1, 1))
    return rounded(me.distribution(s, "grp", "max_drawdown"), 5)


def q_drawdown(spark, d):
    return rounded(me.with_returns(curves(spark, d)).select("run_id", "dt", "drawdown"))


def q_rebased(spark, d):
    return rounded(me.rebased(curves(spark, d), "1997-01-01", "1998-12-31"), 4)


def q_score_locks(spark, d):
    held = cache_obs(locks(spark, d), scratch(spark, "locks"))  # read several times
    return rounded(_long(sc.score_locks(held, prices(spark, d), 10.0), "k").select("book", "lock_date", "until", "k", "seg_ret", "turnover", "value", "cum_cost"), 5, ("value",))


def q_daily_curve(spark, d):
    return rounded(sc.daily_curve(locks(spark, d), prices(spark, d)), 5, ("equity",))


def q_mark(spark, d):
    return rounded(sc.mark_positions(locks(spark, d), prices(spark, d)), 4)


def q_sectors(spark, d):
    names = panel(spark, d).select("symbol").distinct().where(F.col("symbol") != "Brand#9").withColumn("sector", F.substring("symbol", -1, 1))
    return rounded(sc.sector_weights(sc.mark_positions(locks(spark, d), prices(spark, d)), names), 4)


def q_shadow(spark, d):
    s = sc.score_locks(locks(spark, d), prices(spark, d), 10.0)
    r = dt.rates(spark, d).withColumnRenamed("dt", "lock_date")
    return rounded(_long(sc.shadow_levered(s.join(r, "lock_date", "left"), 1.5, 0.004), "k").select("k", "lock_date", "levered"), 5, ("levered",))


def signals(spark, d):
    p = panel(spark, d)
    return p.withColumn("signal", ts.sma_cross(5, 20)).where("open is not null").select(F.col("symbol").alias("run_id"), F.col("idx").cast("long").alias("idx"), "dt", "open", "close", "signal")


def q_signal_free(spark, d):
    return rounded(sc.signal_curve_free(signals(spark, d)).select("run_id", "dt", "equity"), 5, ("equity",))


def q_signal_cost(spark, d):
    return rounded(sc.signal_curve(signals(spark, d), 5.0, 0.02).select("run_id", "dt", "equity"), 5, ("equity",))


def q_stops(spark, d):
    seg = sc.segments(locks(spark, d)).where("until is not null")
    held = locks(spark, d).join(seg, ["book", "lock_date"]).select(F.col("book").alias("run_id"), "symbol", "w", F.col("lock_date").alias("start"), F.col("until").alias("end"), F.col("price").alias("entry"))
    return sc.stop_exits(held, prices(spark, d), 0.2)


def q_trend_weights(spark, d):
    sig, cov = trend(spark, d)
    return rounded(_long(wt.vol_target(wt.inverse_vol_weights(sig), cov, 0.3).select("run_id", "mark", "symbol", "w"), "mark"))


def q_dual_momentum(spark, d):
    sig, cov = trend(spark, d)
    best = wt.top_k(sig.where("strength > 0"), 3, ("run_id", "mark"), "strength")
    return rounded(_long(wt.inverse_vol_weights(best).select("run_id", "mark", "symbol", "w"), "mark"))


def q_hrp(spark, d):
    _, cov = trend(spark, d)
    return rounded(_long(wt.hrp_weights(cov.select("mark", "a", "b", "cov")), "mark"))


def q_split(spark, d):
    x = panel(spark, d).where("symbol in ('Brand#1', 'Brand#2', 'Brand#3')").select(F.col("symbol").alias("leg"), "dt", "ret")
    return rounded(wt.risk_parity_split(x))


def q_blend(spark, d):
    sig, _ = trend(spark, d)
    base = wt.inverse_vol_weights(sig).where("run_id = 'o0'").select("mark", "symbol", "w")
    core = base.select("mark").distinct().select("mark", F.lit("Brand#1").alias("symbol"), F.lit(1.0).alias("w"))
    return rounded(_long(wt.park_cash(wt.blend_weights([(core, 0.5), (base, 0.4)]), "CASH"), "mark"))


def q_stack(spark, d):
    sig, _ = trend(spark, d)
    base = wt.inverse_vol_weights(sig).where("run_id = 'o0'").select("mark", "symbol", "w")
    return rounded(_long(wt.stack_weights(base, "FUND3X", 3.0), "mark"))


def _two_baskets(spark, d):
    sig, _ = trend(spark, d)
    w = wt.inverse_vol_weights(sig)
    at = lambda m: w.where((F.col("run_id") == "o0") & (F.col("mark") == m)).select("symbol", "w")
    return at(260), at(286)


def q_band(spark, d):
    return rounded(wt.band_trades(*_two_baskets(spark, d), 0.1))


def q_buffered(spark, d):
    return rounded(wt.buffered_weights(*_two_baskets(spark, d), 0.1))


def q_orders(spark, d):
    now = panel(spark, d).where("idx = 286").select("symbol", F.col("px").alias("price"))
    return rounded(wt.order_sheet(_two_baskets(spark, d)[1], now, 1e6, False), 2)


def q_guards(spark, d):
    sig, _ = trend(spark, d)
    w = wt.inverse_vol_weights(sig).withColumn("w", F.when(F.col("symbol") == "Brand#11", -F.col("w")).otherwise(F.col("w") * 1.2))
    return _long(wt.weight_guards(w, 1.0, True, ("run_id", "mark")).select("run_id", "mark", "rule"), "mark")


def q_posture(spark, d):
    sig, _ = trend(spark, d)
    return rounded(_long(wt.posture(wt.inverse_vol_weights(sig), ["Brand#10", "Brand#11"], ("run_id", "mark")), "mark"))


def q_two_leg(spark, d):
    return rounded(sc.two_leg_mix(legs(spark, d), 0.6, 10.0), 5, ("equity",))


def q_constant(spark, d):
    return rounded(sc.constant_mix(legs(spark, d)), 5, ("equity",))


def q_lever(spark, d):
    return rounded(sc.lever_to_vol(legs(spark, d), 0.02))


def q_tranche(spark, d):
    return rounded(sc.tranche(curves(spark, d)), 3)


def q_equal(spark, d):
    return rounded(sc.equal_capital(curves(spark, d)), 3)


def q_twin(spark, d):
    flows = spark.createDataFrame([("1996-01-03", 10000.0), ("1997-05-05", 5000.0), ("1999-02-28", -2000.0)], "dt string, amount double").withColumn("dt", F.col("dt").cast("date"))
    every = curves(spark, d).select("run_id").distinct().join(F.broadcast(flows))  # three flows for each run
    return rounded(sc.twin_value(every, curves(spark, d), ("run_id",)), 3)


def q_gap(spark, d):
    c = curves(spark, d)
    one = lambda s, n: c.where(F.col("run_id") == s).select("dt", F.col("equity").alias(n))
    return rounded(sc.gap_report(one("Brand#1", "real").join(one("Brand#2", "twin"), "dt")).select("dt", "gap_bps", "drift_bps_year"), 3)


def q_schedule(spark, d):
    sig, cov = trend(spark, d)
    w = wt.vol_target(wt.inverse_vol_weights(sig), cov, 0.3).select("run_id", F.col("mark").cast("long").alias("mark"), "symbol", "w")
    w = cache_obs(w, scratch(spark, "weights"))  # read four times
    return sc.schedule_curve(w, panel(spark, d).select("symbol", F.col("idx").cast("long").alias("idx"), "px"), 10.0, cash_rate=0.02, financing=0.01, borrow_bps=50.0, rows_a_year=52.0)


def q_schedule_curve(spark, d):
    return rounded(q_schedule(spark, d), 6, ("equity",))


def q_turnover(spark, d):
    return rounded(sc.turnover_per_year(q_schedule(spark, d), 52.0))


QUERIES = {
    "M10_summary": q_summary, "M5_excess_sharpe": q_excess, "M11_window_stats": q_windows, "M12_tracking": q_tracking, "M13_distribution": q_distribution,
    "T22_drawdown": q_drawdown, "Q15_rebased": q_rebased, "P1_score_locks": q_score_locks, "P2_daily_curve": q_daily_curve, "P3_mark_positions": q_mark,
    "P4_sector_weights": q_sectors, "P6_shadow_levered": q_shadow, "P7_signal_curve_free": q_signal_free, "P7_signal_curve": q_signal_cost, "P9_stop_exits": q_stops,
    "W4_trend_weights": q_trend_weights, "W6_dual_momentum": q_dual_momentum, "W7_hrp_weights": q_hrp, "W8_risk_parity_split": q_split, "W9_W11_blend_park": q_blend,
    "W10_stack_weights": q_stack, "W13_band_trades": q_band, "W16_buffered": q_buffered, "W15_order_sheet": q_orders, "W17_guards": q_guards, "W18_posture": q_posture,
    "P10_two_leg_mix": q_two_leg, "P12_constant_mix": q_constant, "P13_lever_to_vol": q_lever, "P14_tranche": q_tranche, "P15_equal_capital": q_equal,
    "P18_twin_value": q_twin, "P19_gap_report": q_gap, "P8_schedule_curve": q_schedule_curve, "P22_turnover": q_turnover,
}


def schedule_sql(weights: str, interest: str = "") -> str:
    """Tables sp, lg, sg, dr, tu and cv (run_id, mark, turnover, equity) of a table of weights; ``interest`` is added to a segment's growth."""
    return f"""sp AS (SELECT run_id, mark, lead(mark) OVER (PARTITION BY run_id ORDER BY mark) AS nx FROM (SELECT DISTINCT run_id, mark FROM {weights})),
lg AS (SELECT v.run_id, v.mark, nx, v.symbol, w, coalesce(b.px / nullif(a.px, 0), 1) AS g FROM {weights} v JOIN sp USING (run_id, mark) LEFT JOIN panel a ON a.symbol = v.symbol AND a.idx = v.mark LEFT JOIN panel b ON b.symbol = v.symbol AND b.idx = nx),
sg AS (SELECT run_id, mark, CASE WHEN any_value(nx) IS NULL THEN 1.0 ELSE sum(w * g) + 1 - sum(w) {interest} END AS tot FROM lg GROUP BY 1, 2),
dr AS (SELECT run_id, nx AS mark, symbol, w * g / tot AS d FROM lg JOIN sg USING (run_id, mark) WHERE nx IS NOT NULL),
tu AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.mark, b.mark) AS mark, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover FROM {weights} a FULL OUTER JOIN dr b ON a.run_id = b.run_id AND a.mark = b.mark AND a.symbol = b.symbol GROUP BY 1, 2),
cv AS (SELECT run_id, mark, turnover, 10000 * exp(sum(ln(1 - turnover * 0.001)) OVER (PARTITION BY run_id ORDER BY mark)) * coalesce(exp(sum(ln(tot)) OVER (PARTITION BY run_id ORDER BY mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS equity FROM tu JOIN sg USING (run_id, mark))"""


_SCHEDULE = f"{TREND}, " + schedule_sql("vt", "+ (1 - sum(w)) * (any_value(nx) - mark) / 52.0 * (0.02 + CASE WHEN 1 - sum(w) < 0 THEN 0.01 ELSE 0 END) - sum(greatest(-w, 0)) * (any_value(nx) - mark) / 52.0 * 0.005")


def _r(names: list[str], n: int = 6) -> str:
    return ", ".join(f"round({x}, {n}) + 0.0 AS {x}" for x in names)


SQL = {
    "M10_summary": f"{CRET}, m AS (SELECT run_id, {_M} FROM cu GROUP BY 1) SELECT run_id, {_r(_MCOLS[:-1], 5)}, round(cagr / nullif(abs(max_drawdown), 0), 5) + 0.0 AS calmar, max_dd_days FROM m",
    "M5_excess_sharpe": f"{CRET}, {dt.RATES_SQL}, x AS (SELECT run_id, ret - rf / 252 AS x FROM cr JOIN rates USING (dt) WHERE ret IS NOT NULL) SELECT run_id, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 6) + 0.0 AS excess_sharpe FROM x GROUP BY 1",
    "M11_window_stats": CURVES + f""", base AS (SELECT c.run_id || '|' || y AS key, c.run_id, y AS name, dt, equity FROM curves c JOIN (SELECT CAST(x AS VARCHAR) AS y FROM (VALUES (1997), (1998), (1999)) v(x)) ON CAST(year(dt) AS VARCHAR) = y),
cr AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER w - 1 AS dd FROM base WINDOW w AS (PARTITION BY key ORDER BY dt)),
cu AS (SELECT *, dd < 0 AS under, lag(dd < 0) OVER w AS was, last_value(CASE WHEN NOT (dd < 0) THEN dt END IGNORE NULLS) OVER (PARTITION BY key ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM cr WINDOW w AS (PARTITION BY key ORDER BY dt)),
m AS (SELECT run_id, name, {_M} FROM cu GROUP BY 1, 2) SELECT run_id, name, {_r(_MCOLS[:-1], 5)}, round(cagr / nullif(abs(max_drawdown), 0), 5) + 0.0 AS calmar, max_dd_days FROM m""",
    "M12_tracking": f"{CRET}, x AS (SELECT a.run_id, a.ret - b.ret AS d FROM cr a JOIN cr b ON a.dt = b.dt AND b.run_id = 'Brand#1' WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.run_id <> 'Brand#1') SELECT run_id, round(avg(d) * 252, 6) + 0.0 AS edge, round(stddev_samp(d) * sqrt(252), 6) + 0.0 AS te FROM x GROUP BY 1",
    "M13_distribution": f"{CRET}, m AS (SELECT right(run_id, 1) AS grp, run_id, min(dd) AS v FROM cr GROUP BY 1, 2) SELECT grp, round(quantile_cont(v, 0.5), 5) + 0.0 AS median, round(min(v), 5) + 0.0 AS least, round(max(v), 5) + 0.0 AS most, round(max(v) - min(v), 5) + 0.0 AS spread FROM m GROUP BY 1",
    "T22_drawdown": f"{CRET} SELECT run_id, dt, round(dd, 6) + 0.0 AS drawdown FROM cr",
    "Q15_rebased": f"{CURVES} SELECT run_id, dt, round(equity / first_value(equity) OVER (PARTITION BY run_id ORDER BY dt) * 10000, 4) + 0.0 AS equity FROM curves WHERE dt BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
    "P1_score_locks": f"{LOCKS} SELECT 'mom' AS book, lock_date, until, k, {_r(['seg_ret', 'turnover', 'cum_cost'], 5)}, {significant_sql('value')} AS value FROM scored",
    "P2_daily_curve": f"""{LOCKS}, ins AS (SELECT s.k, p.dt, sum(l.w * p.px / l.price) + 1 - any_value(sw) AS f FROM locks l JOIN segs s USING (lock_date) JOIN (SELECT lock_date, sum(w) AS sw FROM locks GROUP BY 1) USING (lock_date) JOIN prices p ON p.symbol = l.symbol AND p.dt > s.lock_date AND p.dt <= s.until GROUP BY 1, 2),
e AS (SELECT k, arg_max(f, dt) AS g FROM ins GROUP BY 1), b AS (SELECT k, coalesce(exp(sum(ln(g)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS b FROM e) SELECT 'mom' AS book, dt, {significant_sql('10000 * b * f')} AS equity FROM ins JOIN b USING (k)""",
    "P3_mark_positions": f"{LOCKS}, n AS (SELECT symbol, arg_max(px, dt) AS now FROM prices GROUP BY 1) SELECT book, symbol, CAST(w AS DOUBLE) AS w, round(price, 4) + 0.0 AS entry, round(now, 4) + 0.0 AS now, round(100 * (now / price - 1), 4) + 0.0 AS ret_pct, round(w * 10000 * (now / price - 1), 4) + 0.0 AS pnl FROM locks LEFT JOIN n USING (symbol) WHERE lock_date = (SELECT max(lock_date) FROM locks)",
    "P4_sector_weights": f"{LOCKS}, x AS (SELECT book, CASE WHEN symbol = 'Brand#9' THEN 'Other' ELSE right(symbol, 1) END AS sector, sum(w) AS w FROM locks WHERE lock_date = (SELECT max(lock_date) FROM locks) GROUP BY 1, 2) SELECT book, sector, round(100 * w / sum(w) OVER (PARTITION BY book), 4) + 0.0 AS pct FROM x",
    "P6_shadow_levered": f"{LOCKS}, {dt.RATES_SQL} SELECT k, lock_date, {significant_sql('pow(10, sum(log10(1 + 1.5 * seg_ret - 0.5 * (coalesce(rf, 0) + 0.004) * (until - lock_date) / 365.25)) OVER (ORDER BY k))')} AS levered FROM scored LEFT JOIN rates ON rates.dt = lock_date",
    "P7_signal_curve_free": f"""{PANEL}, s AS (SELECT symbol AS run_id, idx, dt, open, close, CASE WHEN ({roll('avg', 'px', 5)}) > ({roll('avg', 'px', 20)}) THEN 1.0 ELSE 0.0 END AS signal FROM panel), t AS (SELECT * FROM s WHERE open IS NOT NULL),
x AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS wt, lead(open) OVER w AS o1 FROM t WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
y AS (SELECT *, coalesce(exp(sum(ln(1 + wt * (o1 / open - 1))) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM x) SELECT run_id, dt, {significant_sql('10000 * g * (1 + wt * (close / open - 1))')} AS equity FROM y""",
    "P7_signal_curve": f"""{PANEL.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT symbol AS run_id, idx, dt, open, close, CASE WHEN ({roll('avg', 'px', 5)}) > ({roll('avg', 'px', 20)}) THEN 1.0 ELSE 0.0 END AS signal FROM panel),
t AS (SELECT *, row_number() OVER w AS k, coalesce(lag(signal) OVER w, 0.0) AS s, lead(open) OVER w / open AS g FROM s WHERE open IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
r AS (SELECT run_id, k, dt, 10000.0 * (1 + 0.02 / 252) AS e, 0.0::DOUBLE AS u, s, g, open, close FROM t WHERE k = 1 UNION ALL
  SELECT t.run_id, t.k, t.dt, r.e * (r.s * r.g + (1 - r.s - 0.0005 * abs(r.s - r.u)) * (1 + 0.02 / 252)), r.s * r.g / (r.s * r.g + (1 - r.s - 0.0005 * abs(r.s - r.u)) * (1 + 0.02 / 252)), t.s, t.g, t.open, t.close FROM r JOIN t ON t.run_id = r.run_id AND t.k = r.k + 1)
SELECT run_id, dt, {significant_sql('e * (s * close / open + 1 - s - 0.0005 * abs(s - u))')} AS equity FROM r""",
    "P8_schedule_curve": f"{_SCHEDULE} SELECT run_id, mark, {significant_sql('equity')} AS equity, {r6('turnover')} AS turnover FROM cv",
    "P22_turnover": f"{_SCHEDULE} SELECT run_id, round(sum(turnover) / ((max(mark) - min(mark)) / 52.0), 6) + 0.0 AS turnover_year FROM cv GROUP BY 1",
    "P9_stop_exits": f"{LOCKS}, n AS (SELECT lock_date, lead(lock_date) OVER (ORDER BY lock_date) AS until FROM (SELECT DISTINCT lock_date FROM locks)) SELECT book AS run_id, l.symbol, l.lock_date AS start, min(p.dt) AS exit_dt FROM locks l JOIN n USING (lock_date) JOIN prices p ON p.symbol = l.symbol AND p.dt >= l.lock_date AND p.dt < n.until WHERE p.px <= l.price * 0.8 GROUP BY 1, 2, 3",
    "W4_trend_weights": f"{TREND} SELECT run_id, mark, symbol, {r6('w')} AS w FROM vt",
    "W6_dual_momentum": f"{TREND}, t AS (SELECT *, row_number() OVER (PARTITION BY run_id, mark ORDER BY strength DESC, symbol) AS p FROM sig WHERE strength > 0), u AS (SELECT *, strength / vol AS w0 FROM t WHERE p <= 3) SELECT run_id, mark, symbol, round(w0 / sum(abs(w0)) OVER (PARTITION BY run_id, mark), 6) + 0.0 AS w FROM u",
    "W8_risk_parity_split": f"{PANEL}, x AS (SELECT symbol AS leg, dt, ret FROM rets WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3') AND ret IS NOT NULL), f AS (SELECT dt FROM x GROUP BY 1 HAVING count(*) = 3), v AS (SELECT leg, 1 / stddev_samp(ret) AS iv FROM x JOIN f USING (dt) GROUP BY 1) SELECT leg, round(iv / sum(iv) OVER (), 6) + 0.0 AS w FROM v",
    "W9_W11_blend_park": f"""{TREND}, base AS (SELECT mark, symbol, w * 0.4 AS w FROM iv WHERE run_id = 'o0'), core AS (SELECT DISTINCT mark, 'Brand#1' AS symbol, 0.5 AS w FROM base), b AS (SELECT mark, symbol, sum(w) AS w FROM (SELECT * FROM base UNION ALL SELECT * FROM core) GROUP BY 1, 2 HAVING abs(sum(w)) >= 1e-9)
SELECT mark, symbol, {r6('w')} AS w FROM (SELECT * FROM b UNION ALL SELECT mark, 'CASH', 1 - sum(w) FROM b GROUP BY 1 HAVING 1 - sum(w) > 0.005)""",
    "W10_stack_weights": f"{TREND}, base AS (SELECT mark, symbol, w * (1 - 1 / 3.0) AS w FROM iv WHERE run_id = 'o0') SELECT mark, symbol, {r6('w')} AS w FROM (SELECT * FROM base UNION ALL SELECT DISTINCT mark, 'FUND3X', 1 / 3.0 FROM base)",
    "W13_band_trades": f"""{TREND}, x AS (SELECT coalesce(c.symbol, t.symbol) AS symbol, coalesce(c.w, 0) AS cur, coalesce(t.w, 0) AS tgt FROM (SELECT * FROM iv WHERE run_id = 'o0' AND mark = 260) c FULL OUTER JOIN (SELECT * FROM iv WHERE run_id = 'o0' AND mark = 286) t ON c.symbol = t.symbol),
y AS (SELECT *, greatest(tgt - 0.1 * abs(tgt), least(tgt + 0.1 * abs(tgt), cur)) AS new FROM x) SELECT symbol, {r6('cur')} AS cur, {r6('tgt')} AS tgt, {r6('new')} AS new, round(CASE WHEN abs(new - cur) > 0.005 THEN new - cur ELSE 0 END, 6) + 0.0 AS trade FROM y""",
    "W16_buffered": f"""{TREND}, x AS (SELECT coalesce(c.symbol, t.symbol) AS symbol, coalesce(c.w, 0) AS cur, coalesce(t.w, 0) AS tgt FROM (SELECT * FROM iv WHERE run_id = 'o0' AND mark = 260) c FULL OUTER JOIN (SELECT * FROM iv WHERE run_id = 'o0' AND mark = 286) t ON c.symbol = t.symbol),
y AS (SELECT symbol, greatest(tgt - 0.1 * abs(tgt), least(tgt + 0.1 * abs(tgt), cur)) AS w FROM x) SELECT symbol, round(w * least(1.0, 1.0 / sum(abs(w)) OVER ()), 6) + 0.0 AS w FROM y WHERE w <> 0""",
    "W15_order_sheet": f"""{TREND}, o AS (SELECT symbol, w * 1e6 AS target, CAST(floor(w * 1e6 / px) AS DOUBLE) AS shares, floor(w * 1e6 / px) * px AS cost FROM iv JOIN panel USING (symbol) WHERE run_id = 'o0' AND mark = 286 AND idx = 286), l AS (SELECT 1e6 - sum(cost) AS c FROM o)
SELECT symbol, {_r(['target', 'shares', 'cost'], 2)} FROM (SELECT * FROM o UNION ALL SELECT 'CASH', c, c, c FROM l WHERE c > 1)""",
    "W17_guards": f"{TREND}, x AS (SELECT run_id, mark, CASE WHEN symbol = 'Brand#11' THEN -w ELSE w * 1.2 END AS w FROM iv), y AS (SELECT run_id, mark, CASE WHEN min(w) < 0 THEN 'short' WHEN sum(w) > 1 + 1e-9 THEN 'cap' END AS rule FROM x GROUP BY 1, 2) SELECT * FROM y WHERE rule IS NOT NULL",
    "W18_posture": f"{TREND}, x AS (SELECT run_id, mark, sum(abs(w)) AS deployed, sum(CASE WHEN symbol IN ('Brand#10', 'Brand#11') THEN abs(w) ELSE 0 END) AS s FROM iv GROUP BY 1, 2) SELECT run_id, mark, {r6('deployed')} AS deployed, round(s / deployed, 6) + 0.0 AS defensive, round(1 - s / deployed, 6) + 0.0 AS risk FROM x",
    "P10_two_leg_mix": f"""{LEGS}, x AS (SELECT *, date_trunc('month', dt) AS mo, exp(sum(ln(1 + ra)) OVER (PARTITION BY date_trunc('month', dt) ORDER BY dt)) AS a, exp(sum(ln(1 + rb)) OVER (PARTITION BY date_trunc('month', dt) ORDER BY dt)) AS b FROM legs),
e AS (SELECT mo, arg_max(a, dt) AS ea, arg_max(b, dt) AS eb FROM x GROUP BY 1), f AS (SELECT *, 0.6 * ea + 0.4 * eb AS tot, lag(0.6 * ea / (0.6 * ea + 0.4 * eb)) OVER (ORDER BY mo) AS drift FROM e),
g AS (SELECT *, CASE WHEN drift IS NULL THEN 1.0 ELSE 2 * abs(0.6 - drift) END AS turn FROM f), h AS (SELECT *, coalesce(exp(sum(ln(tot * (1 - turn * 0.001))) OVER (ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS st FROM g)
SELECT dt, {significant_sql('10000 * st * (1 - turn * 0.001) * (0.6 * a + 0.4 * b)')} AS equity FROM x JOIN h USING (mo)""",
    "P12_constant_mix": f"{LEGS}, v AS (SELECT (1 / stddev_samp(ra)) / (1 / stddev_samp(ra) + 1 / stddev_samp(rb)) AS w FROM legs) SELECT dt, {significant_sql('pow(10, 4 + sum(log10(1 + w * ra + (1 - w) * rb)) OVER (ORDER BY dt))')} AS equity FROM legs, v",
    "P13_lever_to_vol": f"{LEGS}, v AS (SELECT stddev_samp(ra) / stddev_samp(rb) AS l, avg(rb) AS m FROM legs) SELECT {r6('l')} AS leverage, round(l * m - (l - 1) * 0.024 / 252, 6) + 0.0 AS mean_levered FROM v",
    "P14_tranche": f"{CURVES} SELECT dt, round(avg(equity), 3) + 0.0 AS equity FROM curves GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT run_id) FROM curves)",
    "P15_equal_capital": f"{CURVES} SELECT dt, round(10000 * avg(e), 3) + 0.0 AS equity FROM (SELECT dt, equity / first_value(equity) OVER (PARTITION BY run_id ORDER BY dt) AS e FROM curves) GROUP BY 1",
    "P18_twin_value": f"{CURVES}, f(d, amount) AS (VALUES (DATE '1996-01-03', 10000.0), (DATE '1997-05-05', 5000.0), (DATE '1999-02-28', -2000.0)), e AS (SELECT run_id, arg_max(equity, dt) AS e FROM curves GROUP BY 1), a AS (SELECT run_id, d, amount, arg_min(equity, dt) AS anchor FROM f JOIN curves ON dt >= d GROUP BY 1, 2, 3) SELECT run_id, round(sum(amount * e / anchor), 3) + 0.0 AS twin FROM a JOIN e USING (run_id) GROUP BY 1",
    "P19_gap_report": f"{CURVES}, g AS (SELECT a.dt, (a.equity / b.equity - 1) * 1e4 AS gap FROM curves a JOIN curves b ON a.dt = b.dt AND a.run_id = 'Brand#1' AND b.run_id = 'Brand#2'), z AS (SELECT (arg_max(gap, dt) - arg_min(gap, dt)) / ((max(dt) - min(dt)) / 365.25) AS y FROM g) SELECT dt, round(gap, 3) + 0.0 AS gap_bps, round(y, 3) + 0.0 AS drift_bps_year FROM g, z",
}
