"""Queries on price panels: returns, averages, momentum, volatility and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.operators import asof as pit
from asofspark.operators import panel as pn
from asofspark.operators import timeseries as ts
from asofspark.plans.common import rounded
from asofspark.sources import driver_tables as dt

#: Market, hurdle and canary symbols, lookbacks and windows of the weekly panel (fixed values).
MARKET, HURDLE, CANARIES, LOOKS = "Brand#1", "Brand#2", ("Brand#3", "Brand#4"), (13, 26, 52)
PAIRS = [(5, 20), (5, 40), (10, 20), (10, 40)]
PANEL = f"WITH {dt.bars_sql()}, {dt.PANEL_SQL}"
BY = "PARTITION BY symbol ORDER BY idx"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.panel(dt.bars(spark, sf_dir))


def roll(agg: str, x: str, n: int, by: str = BY) -> str:
    w = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def mom(skip: int, look: int) -> str:
    return f"(lag(px, {skip}) OVER ({BY}) / lag(px, {skip + look}) OVER ({BY}) - 1)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _simple(*cols: str):
    """A query that selects columns of a panel operator."""

    def wrap(f):
        return lambda spark, sf_dir: rounded(f(panel(spark, sf_dir)).select("symbol", "dt", *cols))

    return wrap


def q_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.month_start(pn.calendar(dt.bars(spark, sf_dir))).select("dt", F.col("idx").cast("long").alias("idx"), "month_start")


def q_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.calendar(dt.bars(spark, sf_dir)).where(ts.cycle_bar(21, 3, 52)).select("dt", F.col("idx").cast("long").alias("idx"))


def q_sma_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = ts.sma_grid(panel(spark, sf_dir), PAIRS)
    return grid.groupBy("run_id", "symbol").agg(F.sum("signal").cast("long").alias("on_rows"), F.count(F.lit(1)).alias("rows"))


SCHEDULE = [("1997-01-01", "1997-12-31", 5, 20), ("1998-01-01", "1998-12-31", 10, 40), ("1999-01-01", "1999-12-31", 5, 40)]


def schedule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEDULE, "start string, end string, fast int, slow int").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})


def q_wf_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.wf_signal(ts.sma_grid(panel(spark, sf_dir), PAIRS), schedule(spark)).select("symbol", "dt", "signal"))


def q_rolling_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = panel(spark, sf_dir)
    marks = pn.calendar(dt.bars(spark, sf_dir)).where(ts.cycle_bar(52, 0, 104))
    return rounded(ts.rolling_cov(x, marks, 52, 52).select(F.col("mark").cast("long").alias("mark"), "a", "b", "cov"))


def q_ttm_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = dt.bars(spark, sf_dir)
    posted = pit.post_forward(dt.dividends(spark, sf_dir), bars)
    return rounded(ts.ttm_yield(pn.panel(bars), posted, 52).select("symbol", "dt", "ttm_yield"))


def q_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.breadth_gate(panel(spark, sf_dir), CANARIES, (4, 13, 26, 52), 4).select(F.col("idx").cast("long").alias("idx"), "bad", "exposure"))


def q_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.spread_z(panel(spark, sf_dir), "Brand#1", "Brand#2", 0.8, 30).select(F.col("idx").cast("long").alias("idx"), "spread", "z"))


def q_knife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.knife_edge(panel(spark, sf_dir), LOOKS).select("symbol", F.col("idx").cast("long").alias("idx"), F.col("look").cast("long").alias("look"), "mom"))


QUERIES = {
    "T1_simple_returns": _simple("px", "ret")(lambda p: p),
    "T2_sma_cross": _simple("signal")(lambda p: p.withColumn("signal", ts.sma_cross(10, 40))),
    "T3_sma_grid": q_sma_grid,
    "T4_wf_signal": q_wf_signal,
    "T5_month_start": q_calendar,
    "T6_cycle_bar": q_cycle,
    "T7_momentum_12_1": _simple("mom")(lambda p: p.withColumn("mom", ts.momentum(4, 52))),
    "T8_tsmom_sign": _simple("signal")(lambda p: p.withColumn("signal", ts.tsmom_sign(52))),
    "T9_trend_strength": _simple("strength")(lambda p: ts.trend_strength(p, LOOKS, HURDLE)),
    "T9_trend_long_short": _simple("strength")(lambda p: ts.trend_strength(p, LOOKS, None, True)),
    "T10_rolling_vol": _simple("vol")(lambda p: p.withColumn("vol", ts.rolling_vol(26, 52))),
    "T11_yang_zhang": _simple("yz_vol")(lambda p: ts.yang_zhang(p, 26, 52)),
    "T12_rolling_cov": q_rolling_cov,
    "T13_ttm_yield": q_ttm_yield,
    "T14_market_regime": _simple("risk_on")(lambda p: ts.market_regime(p, 40, ">", 1)),
    "T15_vol_managed": _simple("leverage", "growth")(lambda p: ts.vol_managed(p, 0.2, 26, 2.0)),
    "T16_rotation_returns": _simple("hold", "rot_ret")(lambda p: ts.rotation_returns(p, 40, 2.0, 10.0, 0.02, 52)),
    "T17_breadth_gate": q_breadth,
    "T18_rsrs_gate": _simple("beta", "gate")(lambda p: ts.rsrs_gate(p, 18, 104, 4)),
    "T19_dynamic_leverage": _simple("leverage")(lambda p: ts.dynamic_leverage(p, 13, 52, 4)),
    "T20_unsmoothed": _simple("phi", "unsmoothed")(lambda p: ts.unsmoothed(p)),
    "T21_spread_z": q_spread,
    "T23_knife_edge": q_knife,
    "T24_rolling_beta": _simple("beta")(lambda p: ts.rolling_beta(p, MARKET, 26)),
}
_SMA = f"({roll('avg', 'px', 10)}) > ({roll('avg', 'px', 40)})"
_GRID = f"""grid AS (SELECT p.symbol, p.idx, p.dt, v.f || '-' || v.s AS run_id, v.f AS fast, v.s AS slow, CASE WHEN (CASE v.f WHEN 5 THEN m5 ELSE m10 END) > (CASE v.s WHEN 20 THEN m20 ELSE m40 END) THEN 1.0 ELSE 0.0 END AS signal
  FROM (SELECT *, {", ".join(f"{roll('avg', 'px', n)} AS m{n}" for n in (5, 10, 20, 40))} FROM panel) p, (VALUES (5, 20), (5, 40), (10, 20), (10, 40)) v(f, s))"""
_MOMS = ", ".join(f"{mom(0, n)} AS m{n}" for n in LOOKS)
_K = 0.34 / (1.34 + 27 / 25)
SQL = {
    "T1_simple_returns": f"{PANEL} SELECT symbol, dt, {r6('px')} AS px, {r6('ret')} AS ret FROM rets",
    "T2_sma_cross": f"{PANEL} SELECT symbol, dt, CAST(CASE WHEN {_SMA} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS signal FROM panel",
    "T3_sma_grid": f"{PANEL}, {_GRID} SELECT run_id, symbol, CAST(sum(signal) AS BIGINT) AS on_rows, count(*) AS rows FROM grid GROUP BY 1, 2",
    "T4_wf_signal": f"""{PANEL}, {_GRID}, sched AS (SELECT CAST(a AS DATE) AS a, CAST(b AS DATE) AS b, f, s FROM (VALUES ('1997-01-01', '1997-12-31', 5, 20), ('1998-01-01', '1998-12-31', 10, 40), ('1999-01-01', '1999-12-31', 5, 40)) v(a, b, f, s)),
met AS (SELECT symbol, dt, signal FROM grid JOIN sched ON fast = f AND slow = s AND dt BETWEEN a AND b)
SELECT p.symbol, p.dt, CAST(coalesce(signal, 0) AS DOUBLE) AS signal FROM panel p LEFT JOIN met USING (symbol, dt)""",
    "T5_month_start": f"{PANEL} SELECT dt, idx, coalesce(date_trunc('month', dt) <> date_trunc('month', lag(dt) OVER (ORDER BY idx)), false) AS month_start FROM cal",
    "T6_cycle_bar": f"{PANEL} SELECT dt, idx FROM cal WHERE idx % 21 = 3 AND idx >= 52",
    "T7_momentum_12_1": f"{PANEL} SELECT symbol, dt, {r6(mom(4, 52))} AS mom FROM panel",
    "T8_tsmom_sign": f"{PANEL} SELECT symbol, dt, CAST(CASE WHEN {mom(0, 52)} > 0 THEN 1.0 WHEN {mom(0, 52)} IS NOT NULL THEN 0.0 END AS DOUBLE) AS signal FROM panel",
    "T9_trend_strength": f"{PANEL}, m AS (SELECT symbol, idx, dt, {_MOMS} FROM panel), h AS (SELECT idx, m13 AS h13, m26 AS h26, m52 AS h52 FROM m WHERE symbol = 'Brand#2') SELECT symbol, dt, round(({' + '.join(f'CASE WHEN m{n} - coalesce(h{n}, 0) > 0 THEN 1.0 WHEN m{n} IS NOT NULL THEN 0.0 END' for n in LOOKS)}) / 3.0, 6) + 0.0 AS strength FROM m LEFT JOIN h USING (idx) WHERE symbol <> 'Brand#2'",
    "T9_trend_long_short": f"{PANEL}, m AS (SELECT symbol, idx, dt, {_MOMS} FROM panel) SELECT symbol, dt, round(({' + '.join(f'CASE WHEN m{n} > 0 THEN 1.0 WHEN m{n} IS NOT NULL THEN -1.0 END' for n in LOOKS)}) / 3.0, 6) + 0.0 AS strength FROM m",
    "T10_rolling_vol": f"{PANEL} SELECT symbol, dt, round(({roll('stddev_samp', 'ret', 26)}) * sqrt(52), 6) + 0.0 AS vol FROM rets",
    "T11_yang_zhang": f"""{PANEL}, y AS (SELECT symbol, idx, dt, ln(open / lag(close) OVER ({BY})) AS o, ln(close / open) AS c, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM panel)
SELECT symbol, dt, round(sqrt(CASE WHEN v IS NULL THEN NULL ELSE greatest(v, 0) * 52 END), 6) + 0.0 AS yz_vol FROM (SELECT *, ({roll('var_samp', 'o', 26)}) + {_K!r} * ({roll('var_samp', 'c', 26)}) + (1 - {_K!r}) * ({roll('avg', 'rs', 26)}) AS v FROM y)""",
    "T12_rolling_cov": f"""{PANEL}, marks AS (SELECT idx AS mark FROM cal WHERE idx % 52 = 0 AND idx >= 104), x AS (SELECT symbol, idx, ret, mark FROM rets JOIN marks ON idx <= mark AND idx > mark - 52 WHERE ret IS NOT NULL)
SELECT x.mark, x.symbol AS a, y.symbol AS b, round(covar_samp(x.ret, y.ret) * 52, 6) + 0.0 AS cov FROM x JOIN x y ON x.mark = y.mark AND x.idx = y.idx AND x.symbol <= y.symbol GROUP BY 1, 2, 3 HAVING count(*) = 52""",
    "T13_ttm_yield": f"""{PANEL}, {dt.DIVIDENDS_SQL}, d AS (SELECT symbol, dt, lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS before FROM bars),
posted AS (SELECT d.symbol, d.dt, sum(amount) AS amount FROM d JOIN dividends v ON d.symbol = v.symbol AND ex_dt <= dt AND coalesce(ex_dt > before, true) GROUP BY 1, 2),
x AS (SELECT p.symbol, p.idx, p.dt, px, coalesce(amount, 0) AS amount FROM panel p LEFT JOIN posted USING (symbol, dt))
SELECT symbol, dt, round(({roll('sum', 'amount', 52)}) / px, 6) + 0.0 AS ttm_yield FROM x""",
    "T14_market_regime": f"{PANEL}, x AS (SELECT *, coalesce(px > ({roll('avg', 'px', 40)}), true) AS o FROM panel) SELECT symbol, dt, coalesce(lag(o) OVER ({BY}), true) AS risk_on FROM x",
    "T15_vol_managed": f"""{PANEL}, x AS (SELECT *, least(2.0, 0.2 / (({roll('stddev_samp', 'ret', 26)}) * sqrt(252))) AS l, ({roll('stddev_samp', 'ret', 26)}) AS s FROM rets),
y AS (SELECT *, coalesce(lag(CASE WHEN s IS NULL THEN NULL ELSE l END) OVER ({BY}), 0) AS leverage FROM x)
SELECT symbol, dt, {r6('leverage')} AS leverage, round(exp(sum(ln(1 + leverage * coalesce(ret, 0))) OVER ({BY})), 6) + 0.0 AS growth FROM y""",
    "T16_rotation_returns": f"""{PANEL}, x AS (SELECT *, CASE WHEN px > ({roll('avg', 'px', 40)}) THEN 1.0 ELSE 0.0 END AS up FROM rets), y AS (SELECT *, coalesce(lag(up) OVER ({BY}), 0) AS hold FROM x)
SELECT symbol, dt, CAST(hold AS DOUBLE) AS hold, round(CASE WHEN hold = 1 THEN 2.0 * coalesce(ret, 0) - 0.02 / 52 ELSE 0.02 / 52 END - abs(hold - coalesce(lag(hold) OVER ({BY}), 0)) * 10.0 / 1e4 * 2.0, 6) + 0.0 AS rot_ret FROM y""",
    "T17_breadth_gate": f"""{PANEL}, x AS (SELECT *, (12 * {mom(0, 4)} + 4 * {mom(0, 13)} + 2 * {mom(0, 26)} + {mom(0, 52)}) / 19.0 AS score FROM panel WHERE symbol IN ('Brand#3', 'Brand#4')),
r AS (SELECT idx, count(*) FILTER (WHERE score <= 0) AS bad, count(score) AS n FROM x GROUP BY idx),
h AS (SELECT idx, bad, last_value(CASE WHEN idx % 4 = 0 AND n = 2 THEN 1 - bad / 2.0 END IGNORE NULLS) OVER (ORDER BY idx) AS held FROM r)
SELECT idx, bad, CAST(lag(held) OVER (ORDER BY idx) AS DOUBLE) AS exposure FROM h""",
    "T18_rsrs_gate": f"""{PANEL}, x AS (SELECT *, CASE WHEN count(high) OVER w = 18 THEN regr_slope(high, low) OVER w END AS beta FROM panel WINDOW w AS ({BY} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, (beta - ({roll('avg', 'beta', 104)})) / nullif({roll('stddev_samp', 'beta', 104)}, 0) AS z FROM x)
SELECT symbol, dt, {r6('beta')} AS beta, CAST(last_value(CASE WHEN idx % 4 = 0 AND z > 0.7 THEN 1.0 WHEN idx % 4 = 0 AND z < -0.7 THEN 0.0 END IGNORE NULLS) OVER ({BY}) AS DOUBLE) AS gate FROM y""",
    "T19_dynamic_leverage": f"""{PANEL}, x AS (SELECT *, ({roll('stddev_samp', 'ret', 13)}) * sqrt(252) AS vol FROM rets), y AS (SELECT *, CASE WHEN count(vol) OVER w >= 52 THEN quantile_cont(vol, 0.5) OVER w END AS med FROM x WINDOW w AS ({BY}))
SELECT symbol, dt, round(last_value(CASE WHEN idx % 4 = 0 AND med IS NOT NULL THEN greatest(1.0, least(2.3, 2.3 * med / nullif(vol, 0))) END IGNORE NULLS) OVER ({BY}), 6) + 0.0 AS leverage FROM y""",
    "T20_unsmoothed": f"""{PANEL}, x AS (SELECT *, lag(ret) OVER ({BY}) AS b FROM rets), f AS (SELECT symbol, corr(ret, b) AS phi FROM x GROUP BY 1) SELECT symbol, dt, {r6('phi')} AS phi, round((ret - phi * b) / (1 - phi), 6) + 0.0 AS unsmoothed FROM x JOIN f USING (symbol)""",
    "T21_spread_z": f"""{PANEL}, x AS (SELECT a.idx, a.px - 0.8 * b.px AS spread FROM panel a JOIN panel b ON a.idx = b.idx AND a.symbol = 'Brand#1' AND b.symbol = 'Brand#2')
SELECT idx, {r6('spread')} AS spread, round((spread - ({roll('avg', 'spread', 30, 'ORDER BY idx')})) / ({roll('stddev_samp', 'spread', 30, 'ORDER BY idx')}), 6) + 0.0 AS z FROM x""",
    "T23_knife_edge": f"{PANEL}, m AS (SELECT symbol, idx, {_MOMS} FROM panel) SELECT symbol, idx, CAST(look AS BIGINT) AS look, round(mom, 6) + 0.0 AS mom FROM (" + " UNION ALL ".join(f"SELECT symbol, idx, {n} AS look, m{n} AS mom FROM m" for n in LOOKS) + ") WHERE abs(mom) < 0.005",
    "T24_rolling_beta": f"""{PANEL}, m AS (SELECT idx, ret AS m FROM rets WHERE symbol = 'Brand#1'), x AS (SELECT r.*, m, CASE WHEN m IS NOT NULL THEN ret END AS b FROM rets r JOIN m USING (idx))
SELECT symbol, dt, round(CASE WHEN count(b) OVER w = 26 THEN regr_slope(b, m) OVER w END, 6) + 0.0 AS beta FROM x WINDOW w AS ({BY} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""",
}
