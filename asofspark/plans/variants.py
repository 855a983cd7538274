"""Queries on strategies through SQL views, stitched walk-forward curves, reference postures, and experiment variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofspark.operators import asof as pit
from asofspark.operators import books as bk
from asofspark.operators import metrics as me
from asofspark.operators import observations as ob
from asofspark.operators import panel as pn
from asofspark.operators import quality as qu
from asofspark.operators import research as rs
from asofspark.operators import schedules as sd
from asofspark.operators import scoring as sc
from asofspark.operators import strategies as st
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt
from asofspark.plans import panels as pl
from asofspark.plans import schedules as ps
from asofspark.plans.books import _G, grid
from asofspark.plans.common import rounded, significant_sql
from asofspark.plans.fundamentals import _LONG_OUT, CANONICAL_SQL, EXCLUDED, HIGH, LONG_SQL, LOW, canonical
from asofspark.plans.portfolio import _M, LOOKS, TREND, _long, _r
from asofspark.plans.research import PAIR, pairs
from asofspark.plans.timeseries import CANARIES, PAIRS, PANEL, mom, roll
from asofspark.plans.timeseries import SQL as TS_SQL
from asofspark.sources import driver_tables as dt

LEVELS = [1.0, 1.5, 2.0, 2.3]
#: Dates at which postures are shown beside the locks (fixed values of this test calendar).
REFERENCES = [("spring", "1994-04-01"), ("first autumn", "1995-10-15"), ("mid 1996", "1996-07-04"), ("early 1998", "1998-02-10"), ("summer 2000", "2000-08-20"), ("end", "2003-01-01")]


def q_screen_view(spark, d):
    """The screen as a view, read by SQL."""
    canonical(spark, d).createOrReplaceTempView("asof_names")
    st.create_view(spark, "asof_screen", "long_screen", ["asof_names"], low=LOW, high=HIGH, excluded=EXCLUDED)
    return spark.sql("""SELECT as_of, sector, count(*) AS n, round(avg(composite), 4) + 0.0D AS composite, max_by(ticker, -place) AS best FROM asof_screen WHERE composite IS NOT NULL GROUP BY as_of, sector""")


def q_backtest_view(spark, d):
    """A registered strategy at a two-tier cost as a view, and its turnover and growth by SQL."""
    ps.panel(spark, d).createOrReplaceTempView("asof_panel")
    spark.sql("SELECT concat('o', id) AS run_id, 26 AS every, id AS offset, 1.2D AS gross FROM range(26)").createOrReplaceTempView("asof_params")
    st.create_view(spark, "asof_curve", "backtest", ["asof_panel", "asof_params"], "trend", cost=sd.two_tier(8.0, 900.0, 25.0), cash_rate=0.02, financing=0.03, year=52)
    x = spark.sql("""SELECT run_id, max_by(equity, idx) AS equity, sum(traded) AS traded, sum(fees) AS fees FROM asof_curve GROUP BY run_id""")
    return rounded(x, 4, ("equity", "traded", "fees"))


def q_look_ahead(spark, d):
    """Weights up to row 250 that later prices would change, of every registered strategy: none, and all of a strategy that looks ahead."""
    p = ps.panel(spark, d)
    params = spark.createDataFrame([("r0", 13, 0, 1.0, 5), ("r5", 13, 5, 1.0, 5)], "run_id string, every long, offset long, gross double, n int")
    ahead = lambda panel, runs: st.equal_weight(panel, runs).join(panel.select("symbol", F.col("idx").alias("mark"), F.lead("px", 1).over(ts.by_symbol()).alias("_n")), ["symbol", "mark"]).withColumn("w", F.col("w") * F.col("_n"))
    each = {**st.PICKERS, "ahead": ahead}
    out = None
    for name, strategy in each.items():
        row = st.looks_ahead(strategy, p, params, 250 if name != "ahead" else 247).agg(F.lit(name).alias("strategy"), F.count_if(F.col("mark") <= 246).alias("early"), F.count(F.lit(1)).alias("changed"))
        out = row if out is None else out.unionByName(row)
    return out


def q_stitched_curve(spark, d):
    """Daily curves of four schemes over the test rows of a walk forward, and their metrics."""
    p = ps.panel(spark, d)
    g = grid(spark, d)
    signals = ts.sma_grid(p, PAIRS).select("symbol", "run_id", F.col("idx").cast("long").alias("idx"), "signal")
    best = rs.grid_rank(g.groupBy("symbol", "run_id").agg(F.round(F.sum("x"), 9).alias("all")), ["symbol"], "all")
    x = st.stitched_signals(signals, bk.walk_forward(g, 104, 26, 144), best, 26, "5-20")
    x = x.join(p.where("open is not null").select("symbol", "idx", "dt", "open", "close"), ["symbol", "idx"])
    curve = sc.signal_curve(x.select(F.concat_ws("|", "symbol", "scheme").alias("run_id"), "idx", "dt", "open", "close", "signal"), 2.0, 0.02)
    return rounded(_long(me.summary(curve, 0.02), "max_dd_days").select("run_id", "total_return", "cagr", "ann_vol", "sharpe", "max_drawdown", "calmar", "max_dd_days"), 4, ("total_return", "cagr", "calmar"))


def q_reference_posture(spark, d):
    """Posture and beta of the sleeve at six reference dates, and of a book that stacks it on a 3x fund."""
    p = ps.panel(spark, d)
    dates = spark.createDataFrame(REFERENCES, "label string, date string").withColumn("date", F.col("date").cast("date"))
    at = st.last_rows(pn.calendar(dt.bars(spark, d)), dates).where("mark >= 104")
    x = ts.trend_strength(p, LOOKS).withColumn("vol", ts.rolling_vol(26, 52)).join(F.broadcast(at), F.col("idx") == F.col("mark"))
    w = wt.inverse_vol_weights(x.select(F.col("label").alias("run_id"), "mark", "symbol", "strength", "vol"))
    beta = ts.rolling_beta(p, "Brand#1", 26).select(F.col("idx").alias("mark"), "symbol", F.round("beta", 6).alias("beta")).where("beta is not null")
    found = ob.regime_posture(w, beta, ["Brand#10", "Brand#11"])
    return rounded(found.withColumn("stack_beta", st.stacked_beta(3.0)), 5)


def _mixed_returns(spark, d) -> DataFrame:
    """core, dt, rc (the core's return), rs (the sleeve's) and rf: every symbol as a core beside the same trend sleeve."""
    p = ps.panel(spark, d)
    sleeve = sd.daily_curve(ps.offsets(p).where("run_id = 'o0'"), p, 5.0, cash_rate=0.02, year=52)
    cal = pn.calendar(dt.bars(spark, d)).select("dt", F.col("idx").cast("long").alias("idx"))
    w = Window.partitionBy("run_id").orderBy("idx")
    rs_ = sleeve.withColumn("rs", F.col("equity") / F.lag("equity").over(w) - 1).where("idx > 130").join(cal, "idx").select("dt", "rs")
    return p.where("ret is not null").select(F.col("symbol").alias("core"), "dt", F.col("ret").alias("rc")).join(rs_, "dt").join(dt.rates(spark, d), "dt", "left")


def q_ladder(spark, d):
    """The half-and-half book of every core at four leverages with dated financing."""
    x = _mixed_returns(spark, d).select("core", "dt", (0.5 * F.col("rc") + 0.5 * F.col("rs")).alias("ret"), "rf")
    curve = st.leverage_ladder(x, LEVELS, by=("core",)).withColumn("run_id", F.concat_ws("|", "core", "leverage"))
    return rounded(_long(me.summary(curve.select("run_id", "dt", "equity"), 0.02), "max_dd_days").select("run_id", "total_return", "ann_vol", "sharpe", "max_drawdown", "max_dd_days"), 4, ("total_return",))


def q_cores(spark, d):
    """For each core: holding it, blending it with the sleeve, and stacking the sleeve on it; does the blend's Sharpe, and the stack's growth, beat the core's?"""
    x = _mixed_returns(spark, d)
    rows = {"hold": F.col("rc"), "blend": 0.5 * F.col("rc") + 0.5 * F.col("rs"), "stack": F.col("rc") + 0.6 * F.col("rs") - 0.6 * (F.coalesce("rf", F.lit(0.0)) + 0.004) / 52}
    each = x.select("core", "dt", F.explode(F.array(*[F.struct(F.lit(n).alias("book"), r.alias("r")) for n, r in rows.items()])).alias("e")).select("core", "dt", "e.*")
    m = each.groupBy("core", "book").agg((F.avg("r") / F.stddev_samp("r") * 52**0.5).alias("sharpe"), F.sum(F.log10(F.greatest(1 + F.col("r"), F.lit(1e-9)))).alias("growth"))
    wide = m.groupBy("core").pivot("book", list(rows)).agg(F.first("sharpe").alias("sharpe"), F.first("growth").alias("growth"))
    return rounded(wide, 5).select("core", *[f"{b}_{c}" for b in rows for c in ("sharpe", "growth")], (F.col("blend_sharpe") > F.col("hold_sharpe")).alias("blend_beats"), (F.col("stack_growth") > F.col("hold_growth")).alias("stack_beats"))


ERAS = [("early", 0, 200), ("late", 200, 10_000)]


def q_canary(spark, d):
    """A canary gate on every symbol in two eras: volatility-scaled mean return with and without it, and the share of symbols that it helps."""
    p = ps.panel(spark, d)
    gate = ts.breadth_gate(p, CANARIES, (4, 13, 26, 52), 4).select(F.col("idx").cast("long").alias("idx"), "exposure").where("exposure is not null")
    eras = spark.createDataFrame(ERAS, "era string, a long, b long")
    x = p.where("ret is not null").join(gate, "idx").join(F.broadcast(eras), (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b")))
    moved = F.abs(F.col("exposure") - F.coalesce(F.lag("exposure").over(Window.partitionBy("era", "symbol").orderBy("idx")), F.col("exposure")))
    x = x.withColumn("gated", F.col("exposure") * F.col("ret") - moved * 5 / 1e4)
    sharpe = lambda c: F.avg(c) / F.stddev_samp(c) * 52**0.5
    m = x.groupBy("era", "symbol").agg(sharpe("ret").alias("base"), sharpe("gated").alias("gated"))
    stats = lambda c: [F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.min(c).alias(f"{c}_least")]
    out = rounded(m.groupBy("era").agg(*stats("base"), *stats("gated"), F.avg((F.col("gated") > F.col("base")).cast("double")).alias("helped")))
    return out.withColumn("passes", (F.col("gated_median") > F.col("base_median")) & (F.col("gated_least") >= F.col("base_least")))


def all_legs(spark, d) -> DataFrame:
    """pair, dt, ra, rb of every candidate pair."""
    x = ps.panel(spark, d).where("ret is not null").select("symbol", "dt", "ret")
    one = lambda s, r: x.select(F.col("symbol").alias(s), "dt", F.col("ret").alias(r))
    return pairs(spark, d).select("a", "b", F.concat_ws("|", "a", "b").alias("pair")).join(one("a", "ra"), "a").join(one("b", "rb"), ["b", "dt"]).select("pair", "dt", "ra", "rb")


def q_two_leg_pairs(spark, d):
    return rounded(sc.two_leg_mix(all_legs(spark, d), 0.6, 10.0, ("pair",)), 5, ("equity",))


def q_constant_pairs(spark, d):
    return rounded(sc.constant_mix(all_legs(spark, d), by=("pair",)), 5, ("equity",))


def q_lever_pairs(spark, d):
    return rounded(sc.lever_to_vol(all_legs(spark, d), 0.02, by=("pair",)))


def q_proxy_pairs(spark, d):
    return rounded(rs.proxy_validation(all_legs(spark, d), ("pair",)))


def q_pit_violations(spark, d):
    """What the gate finds where every ninth company's reports are published a day late for their date, and every eleventh's go back by two years at later dates."""
    x = pit.statements_asof(dt.statements(spark, d), dt.asofs(spark), keep=1)
    k = F.substring("ticker", 2, 9).cast("long")
    later = F.col("as_of") > F.min("as_of").over(Window.partitionBy("ticker"))
    x = x.withColumns({
        "publish_date": F.when(k % 9 == 0, F.date_add("as_of", 1)).otherwise(F.col("publish_date")), "report_date": F.when((k % 11 == 0) & later, F.add_months("report_date", -24)).otherwise(F.col("report_date")),
    })
    return pit.pit_violations(x).select("ticker", "as_of", "report_date", "publish_date")


def q_spot_off(spark, d):
    """The vendor check where the vendor is off by up to 3 % for some symbols, and a day behind for others."""
    w = Window.partitionBy("symbol").orderBy("idx")
    x = ps.panel(spark, d).withColumns({"prev": F.lag("px").over(w), "last": F.max("idx").over(Window.partitionBy("symbol"))}).where("idx = last")
    k = F.substring("symbol", 7, 3).cast("int")
    theirs = x.select("symbol", (F.when(k % 3 == 0, F.col("prev")).otherwise(F.col("px")) * (1 + (k % 7 - 3) / 100.0)).alias("cur"), "prev")
    return rounded(qu.vendor_spot_check(x.select("symbol", F.col("px").alias("price")), theirs))


def q_route_rows(spark, d):
    """Every row of each source as a run on it sees it: its key, date and cash."""
    tables = {"filings": lambda: pl.from_filings(spark, d), "statements": lambda: canonical(spark, d), "labels": lambda: pl.from_labels(spark, d)}
    out = None
    for name in pit.SOURCES:
        x = pit.route_source(name, **tables)
        key, day = ("cik", "as_of") if "cik" in x.columns else ("ticker", "as_of" if "as_of" in x.columns else "period")
        x = x.select("source", F.col(key).alias("name"), F.col(day).alias("day"), "cash")
        out = x if out is None else out.unionByName(x)
    return rounded(out, 2)


QUERIES = {
    "P10_all_pairs": q_two_leg_pairs, "P12_all_pairs": q_constant_pairs, "P13_all_pairs": q_lever_pairs, "X26_all_pairs": q_proxy_pairs, "A20_pit_violations": q_pit_violations, "Q9_vendor_off": q_spot_off, "A18_route_rows": q_route_rows,
    "SQL_screen_view": q_screen_view, "SQL_backtest_view": q_backtest_view, "P0_look_ahead": q_look_ahead, "X22_stitched_curve": q_stitched_curve, "X29_reference_posture": q_reference_posture,
    "X31_leverage_ladder": q_ladder, "X31_cores": q_cores, "X31_canary_eras": q_canary,
}

_SIGNALS = f"""{_G.replace("WITH", "WITH RECURSIVE", 1)}, f AS (SELECT unnest(generate_series(144, (SELECT max(idx) FROM gy), 26)) AS fold), s0 AS (SELECT symbol, fold, run_id, sum(x) FILTER (WHERE idx < fold) AS trained FROM gy JOIN f ON idx >= fold - 104 AND idx < fold + 26 GROUP BY 1, 2, 3),
wn AS (SELECT symbol, fold, run_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY trained DESC NULLS LAST, run_id) AS p FROM s0) WHERE p = 1),
al AS (SELECT symbol, run_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a DESC NULLS LAST, run_id) AS p FROM (SELECT symbol, run_id, round(sum(x), 9) AS a FROM gy GROUP BY 1, 2)) WHERE p = 1),
sg AS (SELECT split_part(run_id, '|', 1) AS symbol, split_part(run_id, '|', 2) AS run_id, idx, signal FROM gr),
te AS (SELECT sg.*, 144 + (idx - 144) // 26 * 26 AS fold FROM sg JOIN (SELECT symbol, min(fold) AS f0 FROM wn GROUP BY 1) USING (symbol) WHERE idx >= f0),
sch AS (SELECT symbol || '|walk forward' AS run_id, symbol, idx, signal FROM te JOIN wn USING (symbol, fold, run_id) UNION ALL SELECT symbol || '|best of all', symbol, idx, signal FROM te JOIN al USING (symbol, run_id)
  UNION ALL SELECT symbol || '|untuned', symbol, idx, signal FROM te WHERE run_id = '5-20' UNION ALL SELECT symbol || '|hold', symbol, idx, 1.0 FROM te WHERE run_id = '5-20'),
t AS (SELECT sch.run_id, p.dt, p.open, p.close, row_number() OVER w AS k, coalesce(lag(signal) OVER w, 0.0) AS s, lead(open) OVER w / open AS g FROM sch JOIN panel p ON p.symbol = sch.symbol AND p.idx = sch.idx WHERE open IS NOT NULL WINDOW w AS (PARTITION BY sch.run_id ORDER BY sch.idx)),
r AS (SELECT run_id, k, dt, 10000.0 * (1 + 0.02 / 252) AS e, 0.0::DOUBLE AS u, s, g, open, close FROM t WHERE k = 1 UNION ALL
  SELECT t.run_id, t.k, t.dt, r.e * (r.s * r.g + (1 - r.s - 0.0002 * abs(r.s - r.u)) * (1 + 0.02 / 252)), r.s * r.g / (r.s * r.g + (1 - r.s - 0.0002 * abs(r.s - r.u)) * (1 + 0.02 / 252)), t.s, t.g, t.open, t.close FROM r JOIN t ON t.run_id = r.run_id AND t.k = r.k + 1),
curves AS (SELECT run_id, dt, e * (s * close / open + 1 - s - 0.0002 * abs(s - u)) AS equity FROM r)"""
#: ct: rows of ``curves`` with what the metrics need.
_STATS = """cq AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER w - 1 AS dd FROM curves WINDOW w AS (PARTITION BY run_id ORDER BY dt)),
ct AS (SELECT *, dd < 0 AS under, lag(dd < 0) OVER w AS was, last_value(CASE WHEN NOT (dd < 0) THEN dt END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM cq WINDOW w AS (PARTITION BY run_id ORDER BY dt))"""
_SLEEVE = f"""{ps._BASE}, o0 AS (SELECT * FROM iv WHERE run_id = 'o0'), {ps.curve_sql('o0', 'x * 0.0005', ps._fixed(0.02, 0.0))}, {dt.RATES_SQL},
sl AS (SELECT t AS idx, equity / lag(equity) OVER (ORDER BY t) - 1 AS rs FROM cu WHERE t >= 0), mx AS (SELECT r.symbol AS core, r.dt, r.ret AS rc, rs, coalesce(rf, 0) AS rf FROM rets r JOIN sl ON sl.idx = r.idx AND sl.idx > 130 LEFT JOIN rates ON rates.dt = r.dt WHERE r.ret IS NOT NULL)"""
_PICKED = "lw AS (SELECT run_id, mark, symbol, 1.2 * w AS w FROM iv)"
_BOOKS = {"hold": "rc", "blend": "0.5 * rc + 0.5 * rs", "stack": "rc + 0.6 * rs - 0.6 * (rf + 0.004) / 52"}
_LEGS = f"{PAIR}, legs AS (SELECT a || '|' || b AS pair, x.dt, x.ret AS ra, y.ret AS rb FROM prs JOIN rets x ON x.symbol = a JOIN rets y ON y.symbol = b AND y.dt = x.dt WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)"
_MONTH = "PARTITION BY pair, date_trunc('month', dt) ORDER BY dt"
SQL = {
    "P10_all_pairs": f"""{_LEGS}, x AS (SELECT *, date_trunc('month', dt) AS mo, product(1 + ra) OVER ({_MONTH}) AS a, product(1 + rb) OVER ({_MONTH}) AS b FROM legs),
e AS (SELECT pair, mo, arg_max(a, dt) AS ea, arg_max(b, dt) AS eb FROM x GROUP BY 1, 2), f AS (SELECT *, 0.6 * ea + 0.4 * eb AS tot, lag(0.6 * ea / (0.6 * ea + 0.4 * eb)) OVER (PARTITION BY pair ORDER BY mo) AS drift FROM e),
g AS (SELECT *, CASE WHEN drift IS NULL THEN 1.0 ELSE 2 * abs(0.6 - drift) END AS turn FROM f), h AS (SELECT *, coalesce(product(tot * (1 - turn * 0.001)) OVER (PARTITION BY pair ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS st FROM g)
SELECT pair, dt, {significant_sql('10000 * st * (1 - turn * 0.001) * (0.6 * a + 0.4 * b)')} AS equity FROM x JOIN h USING (pair, mo)""",
    "P12_all_pairs": f"{_LEGS}, v AS (SELECT pair, (1 / stddev_samp(ra)) / (1 / stddev_samp(ra) + 1 / stddev_samp(rb)) AS w FROM legs GROUP BY 1) SELECT pair, dt, {significant_sql('10000 * product(1 + w * ra + (1 - w) * rb) OVER (PARTITION BY pair ORDER BY dt)')} AS equity FROM legs JOIN v USING (pair)",
    "P13_all_pairs": f"{_LEGS}, v AS (SELECT pair, stddev_samp(ra) / stddev_samp(rb) AS l, avg(rb) AS m FROM legs GROUP BY 1) SELECT pair, round(l, 6) + 0.0 AS leverage, round(l * m - (l - 1) * 0.024 / 252, 6) + 0.0 AS mean_levered FROM v",
    "X26_all_pairs": f"{_LEGS} SELECT pair, round(corr(ra, rb), 6) + 0.0 AS corr, round(stddev_samp(ra) / stddev_samp(rb), 6) + 0.0 AS vol_ratio, count(*) AS n FROM legs GROUP BY 1",
    "A20_pit_violations": f"""WITH {CANONICAL_SQL}, t AS (SELECT ticker, as_of, CAST(substr(ticker, 2) AS BIGINT) AS k, report_date, publish_date, min(as_of) OVER (PARTITION BY ticker) AS first FROM ranked WHERE age = 1),
u AS (SELECT ticker, as_of, CASE WHEN k % 9 = 0 THEN as_of + 1 ELSE publish_date END AS publish_date, CASE WHEN k % 11 = 0 AND as_of > first THEN CAST(report_date - INTERVAL 24 MONTH AS DATE) ELSE report_date END AS report_date FROM t),
v AS (SELECT *, lag(report_date) OVER (PARTITION BY ticker ORDER BY as_of) AS before FROM u) SELECT ticker, as_of, report_date, publish_date FROM v WHERE publish_date > as_of OR report_date < before""",
    "Q9_vendor_off": f"""{PANEL}, x AS (SELECT symbol, CAST(substr(symbol, 7) AS INT) AS k, idx, px, lag(px) OVER (PARTITION BY symbol ORDER BY idx) AS prev, max(idx) OVER (PARTITION BY symbol) AS m FROM panel),
y AS (SELECT symbol, px, prev, CASE WHEN k % 3 = 0 THEN prev ELSE px END * (1 + (k % 7 - 3) / 100.0) AS cur FROM x WHERE idx = m), z AS (SELECT symbol, least(abs(px / cur - 1), abs(px / prev - 1)) AS d FROM y) SELECT symbol, round(d, 6) + 0.0 AS deviation, d <= 0.01 AS passes FROM z""",
    "A18_route_rows": f"""WITH {CANONICAL_SQL}, {pl._LABEL_ROWS}, i AS (SELECT ticker, arg_max(cash, report_date) AS c FROM statements GROUP BY 1), l AS (SELECT ticker, period, max(CASE WHEN field = 'cash' THEN val END) AS cash FROM lb WHERE val IS NOT NULL GROUP BY 1, 2)
SELECT 'statements' AS source, ticker AS name, as_of AS day, round(cash, 2) + 0.0 AS cash FROM canonical UNION ALL SELECT 'filings', ticker, as_of, round(max(CASE WHEN age = 1 THEN cash END), 2) + 0.0 FROM ranked WHERE age <= 2 GROUP BY ticker, as_of HAVING count(*) = 2
UNION ALL SELECT 'labels', ticker, period, round(coalesce(cash, c), 2) + 0.0 FROM l JOIN i USING (ticker)""",
    "SQL_screen_view": f"""WITH x AS (WITH {LONG_SQL} {_LONG_OUT}) SELECT as_of, sector, count(*) AS n, round(avg(composite), 4) + 0.0 AS composite, arg_min(ticker, place) AS best FROM x WHERE composite IS NOT NULL GROUP BY 1, 2""",
    "SQL_backtest_view": f"""{ps._BASE}, {_PICKED}, {ps.curve_sql('lw', 'least(x, 900) * 8e-4 + greatest(x - 900, 0) * 25e-4', ps._fixed(0.02, 0.03)).replace("CAST(0 AS DOUBLE) AS traded FROM", "CAST(0 AS DOUBLE) AS traded, CAST(0 AS DOUBLE) AS fees FROM").replace("+ held, tr FROM (", "+ held, tr, fees FROM (", 1).replace("AS tr FROM (", "AS tr, fee + coalesce(list_sum(list_transform(sold, lambda x: least(x, 900) * 8e-4 + greatest(x - 900, 0) * 25e-4)), 0) AS fees FROM (", 1).replace("AS c2 FROM (", "AS c2, coalesce(list_sum(list_transform(list_transform(moves, lambda x: abs(x)), lambda x: least(x, 900) * 8e-4 + greatest(x - 900, 0) * 25e-4)), 0) AS fee FROM (", 1)}
SELECT run_id, {significant_sql('arg_max(equity, t)')} AS equity, {significant_sql('sum(traded)')} AS traded, {significant_sql('sum(fees)')} AS fees FROM cu WHERE t >= 0 GROUP BY 1""",
    "P0_look_ahead": f"""{PANEL}, c AS (SELECT count(*) FILTER (WHERE close IS NOT NULL AND idx % 13 IN (0, 5) AND idx = 247) AS n FROM panel) SELECT unnest(['trend', 'top_momentum', 'equal_weight', 'ahead']) AS strategy, CAST(0 AS BIGINT) AS early, unnest([0, 0, 0, n]) AS changed FROM c""",
    "X22_stitched_curve": f"""{_SIGNALS}, {_STATS}, m AS (SELECT run_id, {_M} FROM ct GROUP BY 1)
SELECT run_id, {significant_sql('total_return')} AS total_return, {significant_sql('cagr')} AS cagr, {_r(['ann_vol', 'sharpe', 'max_drawdown'], 4)}, {significant_sql('cagr / nullif(abs(max_drawdown), 0)')} AS calmar, max_dd_days FROM m""",
    "X29_reference_posture": f"""{TREND.replace("runs(run_id, o) AS (VALUES ('o0', 0), ('o7', 7))", "rf0(label, d) AS (VALUES " + ", ".join(f"('{a}', DATE '{b}')" for a, b in REFERENCES) + "), runs AS (SELECT label AS run_id, max(idx) AS o FROM cal JOIN rf0 ON dt <= d GROUP BY 1)").replace("idx % 26 = o AND", "idx = o AND")}, bt AS (SELECT symbol, dt, beta FROM ({TS_SQL["T24_rolling_beta"]}) WHERE beta IS NOT NULL), b AS (SELECT run_id, mark, sum(w * beta) AS beta FROM iv JOIN cal ON idx = mark JOIN bt USING (symbol, dt) GROUP BY 1, 2),
x AS (SELECT run_id, mark, sum(abs(w)) AS deployed, sum(CASE WHEN symbol IN ('Brand#10', 'Brand#11') THEN abs(w) ELSE 0 END) AS s FROM iv GROUP BY 1, 2)
SELECT run_id, mark, round(deployed, 5) + 0.0 AS deployed, round(s / deployed, 5) + 0.0 AS defensive, round(1 - s / deployed, 5) + 0.0 AS risk, round(beta, 5) + 0.0 AS beta, round(1.0 + (1 - 1 / 3.0) * coalesce(beta, 0), 5) + 0.0 AS stack_beta FROM x LEFT JOIN b USING (run_id, mark)""",
    "X31_leverage_ladder": f"""{_SLEEVE}, lv AS (SELECT core, dt, l, 0.5 * rc + 0.5 * rs AS r, rf FROM mx, (SELECT unnest({LEVELS})::DOUBLE AS l)),
curves AS (SELECT core || '|' || CAST(l AS VARCHAR) AS run_id, dt, 10000.0 * product(1 + l * r - (l - 1) * (rf + 0.004) / 252) OVER (PARTITION BY core, l ORDER BY dt) AS equity FROM lv), {_STATS}, m AS (SELECT run_id, {_M} FROM ct GROUP BY 1)
SELECT run_id, {significant_sql('total_return')} AS total_return, {_r(['ann_vol', 'sharpe', 'max_drawdown'], 4)}, max_dd_days FROM m""",
    "X31_cores": f"""{_SLEEVE}, e AS ({" UNION ALL ".join(f"SELECT core, '{b}' AS book, {r} AS r FROM mx" for b, r in _BOOKS.items())}), m AS (SELECT core, book, avg(r) / stddev_samp(r) * sqrt(52) AS s, sum(log10(greatest(1 + r, 1e-9))) AS g FROM e GROUP BY 1, 2),
p AS (SELECT core, {", ".join(f"round(max(CASE WHEN book = '{b}' THEN {c} END), 5) + 0.0 AS {b}_{n}" for b in _BOOKS for c, n in (("s", "sharpe"), ("g", "growth")))} FROM m GROUP BY 1) SELECT *, blend_sharpe > hold_sharpe AS blend_beats, stack_growth > hold_growth AS stack_beats FROM p""",
    "X31_canary_eras": f"""{PANEL}, gt AS ({TS_SQL["T17_breadth_gate"]}), er(era, a, b) AS (VALUES ('early', 0, 200), ('late', 200, 10000)), x AS (SELECT era, symbol, r.idx, ret, exposure FROM rets r JOIN gt USING (idx) JOIN er ON r.idx >= a AND r.idx < b WHERE ret IS NOT NULL AND exposure IS NOT NULL),
y AS (SELECT *, exposure * ret - abs(exposure - coalesce(lag(exposure) OVER (PARTITION BY era, symbol ORDER BY idx), exposure)) * 5 / 1e4 AS gated FROM x), m AS (SELECT era, symbol, avg(ret) / stddev_samp(ret) * sqrt(52) AS base, avg(gated) / stddev_samp(gated) * sqrt(52) AS gated FROM y GROUP BY 1, 2),
s AS (SELECT era, round(quantile_cont(base, 0.5), 6) + 0.0 AS base_median, round(min(base), 6) + 0.0 AS base_least, round(quantile_cont(gated, 0.5), 6) + 0.0 AS gated_median, round(min(gated), 6) + 0.0 AS gated_least, round(avg(CASE WHEN gated > base THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS helped FROM m GROUP BY 1)
SELECT *, gated_median > base_median AND gated_least >= base_least AS passes FROM s""",
}
