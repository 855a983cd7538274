"""Queries on books, sweeps, walk-forward selection and return expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.operators import asof as pit
from asofspark.operators import books as bk
from asofspark.operators import metrics as me
from asofspark.operators import panel as pn
from asofspark.operators import research as rs
from asofspark.operators import scoring as sc
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt
from asofspark.plans.common import rounded, significant_sql
from asofspark.plans.portfolio import CRET, LOCKS, TREND, _long, _r, _two_baskets, locks, prices, schedule_sql
from asofspark.plans.research import GRID, OBS, ranks
from asofspark.plans.timeseries import PAIRS, PANEL, mom, roll
from asofspark.sources import driver_tables as dt
from asofspark.sources import sinks


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.panel(dt.bars(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ts.sma_grid(panel(spark, sf_dir), PAIRS)
    w = Window.partitionBy("run_id", "symbol").orderBy("idx")
    return g.select("symbol", "run_id", F.col("idx").cast("long").alias("idx"), (F.coalesce(F.lag("signal").over(w), F.lit(0.0)) * F.log(F.col("px") / F.lag("px").over(w))).alias("x"))


def q_levered(spark, d):
    x = panel(spark, d).where("ret is not null").join(dt.rates(spark, d), "dt")
    r, rf = F.col("ret"), F.col("rf")
    return rounded(x.select("symbol", "dt", bk.letf_return(r, rf, 3.0).alias("letf"), bk.levered_return(r, rf, 1.5, 0.004).alias("levered"), bk.stacked_return(r, 0.5 * r, rf, 0.6, 0.004).alias("stacked"), (F.floor(bk.trade_cost(F.col("volume"), F.col("px"), 10.0) * 1e4) / 1e4).alias("cost")))


def q_market_cap(spark, d):
    x = dt.prices_asof(spark, d).select("ticker", F.col("as_of").alias("dt"), F.col("price").alias("close"))
    s = dt.statements(spark, d).groupBy("ticker").agg(F.max_by("shares", "report_date").alias("shares"))
    return rounded(bk.market_cap_latest(x, s), 2)


def q_entry(spark, d):
    x = locks(spark, d).withColumn("lock_date", F.date_add("lock_date", 3)).select("lock_date", "symbol", "price")
    return rounded(bk.entry_prices(x, prices(spark, d).where("symbol <> 'Brand#20'")), 8)


def q_carry(spark, d):
    b = dt.bars(spark, d)
    y = ts.ttm_yield(pn.panel(b), pit.post_forward(dt.dividends(spark, d), b), 52).withColumn("vol", ts.rolling_vol(26, 52)).where("idx % 52 = 0 and ttm_yield is not null")
    return rounded(_long(bk.carry_weights(y.withColumnRenamed("idx", "mark")), "mark"))


def q_momentum_schedule(spark, d):
    return rounded(_long(bk.momentum_schedule(panel(spark, d), "Brand#1", 4, 52, 40, 20), "mark"))


def q_since(spark, d):
    return rounded(bk.basket_since_lock(locks(spark, d), prices(spark, d)), 5)


def q_orders(spark, d):
    now = panel(spark, d).where("idx = 286").select("symbol", F.col("px").alias("price"))
    return rounded(bk.rebalance_orders(*_two_baskets(spark, d), now, 1e6, 0.1, "CASH", substitutes=spark.createDataFrame([("Brand#11", "FUND")], "symbol string, instead string")).select("symbol", "side", "dollars"), 2)


def q_split(spark, d):
    return rounded(bk.split_search(grid(spark, d), 180), 5)


def q_walk(spark, d):
    return rounded(_long(bk.walk_forward(grid(spark, d), 104, 26, 144), "fold"), 5)


def q_breadth(spark, d):
    return rounded(_long(bk.breadth(ranks(spark, d), [3, 5, 8]), "n"), 5)


def q_switched(spark, d):
    p = panel(spark, d)
    one = lambda s, n: p.where((F.col("symbol") == s) & F.col("ret").isNotNull()).select("dt", F.col("ret").alias(n))
    on = ts.market_regime(p.where("symbol = 'Brand#1'"), 20).select("dt", F.col("risk_on").alias("on"))
    x = bk.switched_mix(one("Brand#1", "ra").join(one("Brand#2", "rb"), "dt").join(one("Brand#3", "rc"), "dt").join(on, "dt"), 0.6)
    return rounded(x, 5, ("equity",))


def q_validate(spark, d):
    s = dt.statements(spark, d).withColumn("tax_rate", -F.col("tax_expense") / F.col("revenue") * 5)
    s = s.withColumn("cash", F.when(F.col("ticker").endswith("7"), F.lit(float("nan"))).otherwise(F.col("cash")))
    return bk.validate_canonical(s, ["cash", "tax_rate"]).groupBy("field", "rule").agg(F.count(F.lit(1)).alias("n"))


def q_normalize(spark, d):
    s = dt.statements(spark, d).withColumn("tax_rate", -F.col("tax_expense") / F.col("revenue") * 5)
    s = s.withColumn("cash", F.when(F.col("ticker").endswith("7"), F.lit(float("nan"))).otherwise(F.col("cash"))).withColumn("h", F.array("cash", "equity"))
    x = bk.normalize_canonical(s, ["cash", "tax_rate"], ["h"])
    return rounded(x.select("ticker", "report_date", "cash", "tax_rate", F.size("h").cast("long").alias("n")), 5)


def q_universe(spark, d):
    s = dt.statements(spark, d)
    return bk.universe(s.where("retained_earnings > 0"), s.where("long_term_debt > 0"), dt.prices_asof(spark, d))


def q_upsert(spark, d):
    h = dt.rates(spark, d).groupBy(F.date_format("dt", "yyyy-MM").alias("month")).agg(F.max("rf").alias("rf"))
    return rounded(sinks.upsert_month(h, h.where("month >= '2001-06'").withColumn("rf", F.col("rf") * 2)))


def q_daily_wide(spark, d):
    return rounded(sinks.daily_wide(sc.buy_and_hold(panel(spark, d)).where("run_id in ('Brand#1', 'Brand#2')"), ["Brand#1", "Brand#2"]), 2)


def q_offsets(spark, d):
    """All 26 offsets of the trend sleeve in one job: growth, deepest drawdown and turnover of each run, and their spread."""
    p = panel(spark, d)
    x = ts.trend_strength(p, (13, 26, 52)).withColumn("vol", ts.rolling_vol(26, 52))
    runs = spark.range(26).select(F.concat(F.lit("o"), F.col("id")).alias("run_id"), F.col("id").alias("offset"))
    s = x.join(F.broadcast(runs), (F.col("idx") % 26 == F.col("offset")) & (F.col("idx") >= 104)).select("run_id", F.col("idx").cast("long").alias("mark"), "symbol", "strength", "vol")
    c = sc.schedule_curve(wt.inverse_vol_weights(s).select("run_id", "mark", "symbol", "w"), p.select("symbol", F.col("idx").cast("long").alias("idx"), "px"), 10.0)
    w = Window.partitionBy("run_id").orderBy("mark")
    c = c.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    last = c.groupBy("run_id").agg(F.log10(F.max_by("equity", "mark")).alias("growth"), F.min("dd").alias("max_drawdown"), F.avg("turnover").alias("turnover"))
    long = last.unpivot(["run_id"], ["growth", "max_drawdown", "turnover"], "grp", "value")
    return rounded(me.distribution(long, "grp", "value"), 5)


def q_dominance(spark, d):
    s = me.summary(sc.buy_and_hold(panel(spark, d))).withColumn("grp", F.substring("run_id", -1, 1))
    dist = s.groupBy("grp").agg(F.percentile("sharpe", F.lit(0.5)).alias("median"), F.min("sharpe").alias("least"), F.percentile("max_drawdown", F.lit(0.5)).alias("median_dd"))
    return rounded(rs.dominance_verdict(dist.where("grp <> '1'"), dist.where("grp = '1'")), 5)


QUERIES = {
    "F14_F16_levered": q_levered, "A10_market_cap": q_market_cap, "A15_entry_prices": q_entry, "W5_carry_weights": q_carry, "W12_momentum_schedule": q_momentum_schedule, "P5_since_lock": q_since,
    "W14_rebalance_orders": q_orders, "X21_split_search": q_split, "X22_walk_forward": q_walk, "X5_breadth": q_breadth, "P11_switched_mix": q_switched, "Q5_validate_canonical": q_validate,
    "Q4_normalize": q_normalize, "Q17_universe": q_universe, "S18_upsert_month": q_upsert, "S17_daily_wide": q_daily_wide, "X24_offset_sweep": q_offsets, "X25_dominance": q_dominance,
}
_G = f"{GRID}, gy AS (SELECT split_part(run_id, '|', 1) AS symbol, split_part(run_id, '|', 2) AS run_id, idx, x FROM gx)"
_OFFSETS = TREND.replace("runs(run_id, o) AS (VALUES ('o0', 0), ('o7', 7))", "runs AS (SELECT 'o' || range AS run_id, range AS o FROM range(26))")
SQL = {
    "X24_offset_sweep": f"""{_OFFSETS}, {schedule_sql("iv")}, c AS (SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY mark) - 1 AS dd FROM cv),
l AS (SELECT run_id, log10(arg_max(equity, mark)) AS growth, min(dd) AS max_drawdown, avg(turnover) AS turnover FROM c GROUP BY 1), v AS (SELECT 'growth' AS grp, growth AS v FROM l UNION ALL SELECT 'max_drawdown', max_drawdown FROM l UNION ALL SELECT 'turnover', turnover FROM l)
SELECT grp, round(quantile_cont(v, 0.5), 5) + 0.0 AS median, round(min(v), 5) + 0.0 AS least, round(max(v), 5) + 0.0 AS most, round(max(v) - min(v), 5) + 0.0 AS spread FROM v GROUP BY 1""",
    "X25_dominance": f"""{CRET}, m AS (SELECT right(run_id, 1) AS grp, run_id, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS s, min(dd) AS d FROM cr GROUP BY 1, 2), g AS (SELECT grp, quantile_cont(s, 0.5) AS median, min(s) AS least, quantile_cont(d, 0.5) AS median_dd FROM m GROUP BY 1)
SELECT a.grp, {_r(["a.median", "a.least", "a.median_dd"], 5).replace("AS a.", "AS ")}, a.median > b.median AND a.least >= b.least AND a.median_dd >= b.median_dd AS dominates FROM g a, g b WHERE a.grp <> '1' AND b.grp = '1'""",
    "F14_F16_levered": f"{PANEL}, {dt.RATES_SQL} SELECT symbol, dt, round(3.0 * ret - 2.0 * (rf + 0.004) / 252 - 0.0095 / 252, 6) + 0.0 AS letf, round(1.5 * ret - 0.5 * (rf + 0.004) / 252, 6) + 0.0 AS levered, round(ret + 0.6 * (0.5 * ret) - 0.6 * (rf + 0.004) / 252, 6) + 0.0 AS stacked, round(floor(abs(volume) * px * 10 / 1e4 * 1e4) / 1e4, 6) + 0.0 AS cost FROM rets JOIN rates USING (dt) WHERE ret IS NOT NULL",
    "A10_market_cap": f"WITH {dt.statements_sql()}, {dt.ASOFS_SQL}, {dt.PRICES_ASOF_SQL}, p AS (SELECT ticker, arg_max(price, as_of) AS c FROM prices_asof GROUP BY 1), s AS (SELECT ticker, arg_max(shares, report_date) AS n FROM statements GROUP BY 1) SELECT ticker, round(c * n, 2) + 0.0 AS market_cap FROM p JOIN s USING (ticker)",
    "A15_entry_prices": f"{LOCKS}, l AS (SELECT lock_date + 3 AS lock_date, symbol, price FROM locks), f AS (SELECT l.lock_date, l.symbol, l.price, arg_min(px, dt) AS p FROM l LEFT JOIN prices p ON p.symbol = l.symbol AND p.symbol <> 'Brand#20' AND dt >= l.lock_date GROUP BY 1, 2, 3) SELECT lock_date, symbol, round(coalesce(p, price), 8) + 0.0 AS entry FROM f",
    "W5_carry_weights": f"""{PANEL}, {dt.DIVIDENDS_SQL}, d AS (SELECT symbol, dt, lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS before FROM bars),
posted AS (SELECT d.symbol, d.dt, sum(amount) AS amount FROM d JOIN dividends v ON d.symbol = v.symbol AND ex_dt <= dt AND coalesce(ex_dt > before, true) GROUP BY 1, 2), x AS (SELECT p.*, coalesce(amount, 0) AS amount FROM rets p LEFT JOIN posted USING (symbol, dt)),
y AS (SELECT idx AS mark, symbol, ({roll('sum', 'amount', 52)}) / px AS y, ({roll('stddev_samp', 'ret', 26)}) * sqrt(252) AS v FROM x), z AS (SELECT mark, symbol, y / v AS w FROM y WHERE mark % 52 = 0 AND y > 0 AND v IS NOT NULL) SELECT mark, symbol, round(w / sum(w) OVER (PARTITION BY mark), 6) + 0.0 AS w FROM z""",
    "W12_momentum_schedule": f"""{PANEL}, m AS (SELECT symbol, idx, close, {mom(4, 52)} AS mom, date_trunc('month', dt) <> date_trunc('month', lag(dt) OVER (PARTITION BY symbol ORDER BY idx)) AS first FROM panel), g AS (SELECT idx, coalesce(px > ({roll('avg', 'px', 40)}), true) AS o FROM panel WHERE symbol = 'Brand#1'),
t0 AS (SELECT m.idx AS mark, symbol, o, row_number() OVER (PARTITION BY m.idx ORDER BY mom DESC, symbol) AS p, count(*) OVER (PARTITION BY m.idx) AS c FROM m JOIN g ON g.idx = m.idx WHERE first AND m.idx >= 56 AND mom IS NOT NULL AND close IS NOT NULL), t AS (SELECT * FROM t0 WHERE c >= 10)
SELECT mark, symbol, round(1.0 / count(*) OVER (PARTITION BY mark), 6) + 0.0 AS w FROM t WHERE p <= 20 AND o UNION ALL SELECT DISTINCT mark, NULL, CAST(0.0 AS DOUBLE) FROM t WHERE NOT o""",
    "P5_since_lock": f"{LOCKS}, n AS (SELECT symbol, arg_max(px, dt) AS now FROM prices GROUP BY 1) SELECT book, lock_date, round(sum(w * (now / price - 1)), 5) + 0.0 AS since_lock FROM locks JOIN n USING (symbol) GROUP BY 1, 2",
    "W14_rebalance_orders": f"""{TREND}, x AS (SELECT coalesce(c.symbol, t.symbol) AS symbol, coalesce(c.w, 0) AS cur, coalesce(t.w, 0) AS tgt FROM (SELECT * FROM iv WHERE run_id = 'o0' AND mark = 260) c FULL OUTER JOIN (SELECT CASE WHEN symbol = 'Brand#11' THEN 'FUND' ELSE symbol END AS symbol, w FROM iv WHERE run_id = 'o0' AND mark = 286) t ON c.symbol = t.symbol),
y AS (SELECT symbol, (greatest(tgt - 0.1 * abs(tgt), least(tgt + 0.1 * abs(tgt), cur)) - cur) AS t FROM x), z AS (SELECT symbol, t * 1e6 AS v FROM y WHERE abs(t) > 0.005), u AS (SELECT * FROM z UNION ALL SELECT 'CASH', -sum(v) FROM z HAVING abs(sum(v)) > 1)
SELECT symbol, CASE WHEN v > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(v), 2) + 0.0 AS dollars FROM u UNION ALL SELECT symbol, 'SKIP', round(abs(t * 1e6), 2) + 0.0 FROM y WHERE abs(t) <= 0.005 AND t <> 0""",
    "X21_split_search": f"{_G}, s AS (SELECT symbol, run_id, sum(x) FILTER (WHERE idx < 180) AS in_sample, sum(x) FILTER (WHERE idx >= 180) AS out_sample FROM gy GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY in_sample DESC NULLS LAST, run_id) AS p FROM s) SELECT symbol, run_id, {_r(['in_sample', 'out_sample'], 5)} FROM p WHERE p = 1",
    "X22_walk_forward": f"""{_G}, f AS (SELECT unnest(generate_series(144, (SELECT max(idx) FROM gy), 26)) AS fold), s AS (SELECT symbol, fold, run_id, sum(x) FILTER (WHERE idx < fold) AS trained, sum(x) FILTER (WHERE idx >= fold) AS earned FROM gy JOIN f ON idx >= fold - 104 AND idx < fold + 26 GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY trained DESC NULLS LAST, run_id) AS p FROM s) SELECT symbol, fold, run_id, {_r(['trained', 'earned'], 5)} FROM p WHERE p = 1""",
    "X5_breadth": f"""{OBS}, s AS (SELECT date, name, fwd, round(avg(pct), 9) AS score FROM rk WHERE pct IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, name) AS t, row_number() OVER (PARTITION BY date ORDER BY score, name) AS b FROM s),
u AS (SELECT n, date, avg(fwd) FILTER (WHERE t <= n) AS l, avg(fwd) FILTER (WHERE t <= n) - avg(fwd) FILTER (WHERE b <= n) AS ls FROM t, (SELECT unnest([3, 5, 8]) AS n) GROUP BY 1, 2) SELECT CAST(n AS BIGINT) AS n, round(avg(l), 5) + 0.0 AS "long", round(avg(ls), 5) + 0.0 AS long_short FROM u GROUP BY 1""",
    "P11_switched_mix": f"""{PANEL}, g AS (SELECT dt, coalesce(px > ({roll('avg', 'px', 20)}), true) AS o FROM panel WHERE symbol = 'Brand#1'), l AS (SELECT a.dt, a.ret AS ra, b.ret AS rb, c.ret AS rc, o FROM rets a JOIN rets b ON a.dt = b.dt AND b.symbol = 'Brand#2' JOIN rets c ON a.dt = c.dt AND c.symbol = 'Brand#3' JOIN g ON g.dt = a.dt WHERE a.symbol = 'Brand#1' AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND c.ret IS NOT NULL),
m AS (SELECT *, coalesce(lag(o) OVER (ORDER BY dt), true) AS p FROM l), n AS (SELECT *, CASE WHEN p <> lag(p) OVER (ORDER BY dt) THEN 1 ELSE 0 END AS s FROM m)
SELECT dt, {significant_sql('pow(10, 4 + sum(log10(1 + 0.6 * CASE WHEN p THEN ra ELSE rc END + 0.4 * rb)) OVER (ORDER BY dt))')} AS equity, CAST(sum(s) OVER (ORDER BY dt) AS BIGINT) AS switches FROM n""",
    "Q5_validate_canonical": f"WITH {dt.statements_sql()}, x AS (SELECT ticker, -tax_expense / revenue * 5 AS t FROM statements) SELECT 'cash' AS field, 'nan' AS rule, count(*) AS n FROM x WHERE ends_with(ticker, '7') HAVING count(*) > 0 UNION ALL SELECT 'tax_rate', 'range', count(*) FROM x WHERE t NOT BETWEEN 0 AND 0.6 HAVING count(*) > 0",
    "Q4_normalize": f"WITH {dt.statements_sql()}, x AS (SELECT *, -tax_expense / revenue * 5 AS t FROM statements) SELECT ticker, report_date, round(CASE WHEN ends_with(ticker, '7') THEN NULL ELSE cash END, 5) + 0.0 AS cash, round(CASE WHEN t < 0 THEN 0.0 WHEN t > 0.6 THEN 0.6 ELSE t END, 5) + 0.0 AS tax_rate, CASE WHEN ends_with(ticker, '7') THEN 1 ELSE 2 END::BIGINT AS n FROM x",
    "Q17_universe": f"WITH {dt.statements_sql()}, {dt.ASOFS_SQL}, {dt.PRICES_ASOF_SQL} SELECT ticker FROM statements WHERE retained_earnings > 0 INTERSECT SELECT ticker FROM statements WHERE long_term_debt > 0 INTERSECT SELECT ticker FROM prices_asof",
    "S18_upsert_month": f"WITH {dt.RATES_SQL}, h AS (SELECT strftime(dt, '%Y-%m') AS month, max(rf) AS rf FROM rates GROUP BY 1) SELECT month, round(CASE WHEN month >= '2001-06' THEN rf * 2 ELSE rf END, 6) + 0.0 AS rf FROM h",
    "S17_daily_wide": f"{PANEL}, c AS (SELECT symbol, dt, 10000.0 * px / first_value(px) OVER (PARTITION BY symbol ORDER BY dt) AS e FROM panel WHERE symbol IN ('Brand#1', 'Brand#2')) SELECT dt, round(max(CASE WHEN symbol = 'Brand#1' THEN e END), 2) AS \"Brand#1\", round(max(CASE WHEN symbol = 'Brand#2' THEN e END), 2) AS \"Brand#2\" FROM c GROUP BY 1",
}
