"""Entries of operators that other queries compute on the way: factors, metrics, ranks, weights, joins, and the readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.functions import factors as fx
from asofspark.operators import asof as pit
from asofspark.operators import books as bk
from asofspark.operators import filings as fl
from asofspark.operators import metrics as me
from asofspark.operators import panel as pn
from asofspark.operators import ranking as rk
from asofspark.operators import scoring as sc
from asofspark.operators import weights as wt
from asofspark.operators.observations import scratch
from asofspark.plans import portfolio as pf
from asofspark.plans.common import rounded
from asofspark.plans.fundamentals import CANONICAL_SQL, DIGITS, _ranks_sql, canonical
from asofspark.plans.timeseries import PANEL, r6
from asofspark.sources import driver_tables as dt
from asofspark.sources import sinks

FACTORS = {
    "F1_ev_ebit": ("ev_ebit",), "F2_price_fcf": ("price_fcf",), "F3_roic": ("roic",), "F4_gm_stability": ("gm_stability",), "F5_net_debt_ebitda": ("net_debt_ebitda",),
    "F6_gross_profitability": ("gross_profitability",), "F7_altman_z": ("altman_z",), "F8_beneish_m": ("beneish_m",), "F10_growth_issuance": ("asset_growth", "net_issuance"),
}
METRICS = {
    "M1_total_return": "total_return", "M2_cagr": "cagr", "M3_ann_vol": "ann_vol", "M4_sharpe": "sharpe", "M6_sortino": "sortino", "M7_max_drawdown": "max_drawdown",
    "M8_max_dd_days": "max_dd_days", "M9_calmar": "calmar",
}
#: Code ranges and their sectors (fixed values).
SECTORS = [(100, 999, "Agriculture"), (1000, 1499, "Mining"), (2000, 3999, "Manufacturing"), (4900, 4999, "Utilities"), (4000, 4899, "Transport"), (5000, 5999, "Trade"), (6000, 6799, "Finance"), (7000, 8999, "Services")]


def _factor(names: tuple[str, ...]):
    return lambda spark, d: rounded(canonical(spark, d).withColumns({n: getattr(fx, n)() for n in names}).select("ticker", "as_of", *names))


def _metric(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = me.summary(pf.curves(spark, d), 0.02)
        return rounded((x.withColumn(name, F.col(name).cast("long")) if name == "max_dd_days" else x).select("run_id", name), 5)

    return run


def q_scalars(spark, d):
    o = dt.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"), "o_orderpriority")
    days = F.expr("size(filter(sequence(dt, date_add(dt, 9)), x -> weekday(x) < 5))").cast("long")
    name = F.lower(F.trim(F.regexp_replace("o_orderpriority", r"^[0-9]-", "")))
    return o.groupBy(F.date_format("dt", "yyyy-MM").alias("month"), name.alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(days).alias("bdays"), F.max(F.last_day("dt")).alias("month_end"), F.min(F.date_trunc("month", "dt").cast("date")).alias("first_day"))


def q_math(spark, d):
    x = pn.panel(dt.bars(spark, d)).where("ret is not null")
    return rounded(x.select("symbol", "dt", F.log1p("ret").alias("log_return"), F.sqrt(F.abs("ret")).alias("root"), F.signum("ret").alias("sign"), F.least(F.greatest("ret", F.lit(-0.1)), F.lit(0.1)).alias("clipped"), F.pow(1 + F.col("ret"), 52).alias("annual")), 6, ("annual",))


def q_levered(spark, d):
    x = pn.panel(dt.bars(spark, d)).where("ret is not null").join(dt.rates(spark, d), "dt")
    return rounded(x.select("symbol", "dt", bk.levered_return(F.col("ret"), F.col("rf"), 2.0, 0.005).alias("levered"), bk.stacked_return(F.col("ret"), 0.3 * F.col("ret"), F.col("rf"), 0.5, 0.005).alias("stacked")))


def q_pct_rank(spark, d):
    x = rk.with_factors(canonical(spark, d))
    return rounded(x.select("ticker", "as_of", rk.pct_rank("ev_ebit", not fx.LOWER_BETTER["ev_ebit"], ("as_of", "sector")).alias("ev_ebit_pct")))


def q_composite(spark, d):
    x = rk.composite(rk.with_factors(canonical(spark, d)), {f: 0.2 for f in fx.LOWER_BETTER}, ("as_of", "sector"), digits=DIGITS)
    return rounded(x.select("ticker", "as_of", F.col("n_factors").cast("long").alias("n_factors"), "composite"))


def q_inverse_vol(spark, d):
    sig, _ = pf.trend(spark, d)
    return rounded(pf._long(wt.inverse_vol_weights(sig).select("run_id", "mark", "symbol", "w"), "mark"))


def q_vol_target(spark, d):
    sig, cov = pf.trend(spark, d)
    x = wt.vol_target(wt.inverse_vol_weights(sig), cov, 0.3)
    return rounded(pf._long(x.groupBy("run_id", "mark").agg(F.sum("w").alias("gross")), "mark"))


def q_hold(spark, d):
    return rounded(sc.buy_and_hold(pn.panel(dt.bars(spark, d))), 4)


def sics(spark, d):
    k = F.col("s_suppkey")
    return dt.table(spark, d, "supplier").select(F.lpad(k.cast("string"), 10, "0").alias("cik"), (100 + k * 37 % 9000).cast("int").alias("code"))


def q_sic(spark, d):
    return sics(spark, d).select("cik", F.col("code").cast("long").alias("code"), fl.sic_to_sector(F.col("code"), SECTORS).alias("sector"))


def q_posted(spark, d):
    return rounded(pit.post_forward(dt.dividends(spark, d), dt.bars(spark, d)))


def q_ev(spark, d):
    k = F.substring("ticker", 2, 6).cast("int")
    x = canonical(spark, d).withColumn("given", F.when(k % 3 == 0, F.col("market_cap") * 1.1))
    return rounded(x.select("ticker", "as_of", pit.enterprise_value(F.col("given")).alias("enterprise_value")), 2)


# Readers and sinks: the rows of a table are written in the format, and what the reader makes of the files is the result.


def q_read_bars(spark, d):
    path = scratch(spark, "bars")
    dt.bars(spark, d).select("symbol", "dt", "open", "high", "low", F.when(F.dayofmonth("dt") == 13, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"), F.col("volume").cast("double").alias("volume")).write.csv(path, header=True)
    x = sinks.read_bars(spark, path, "1996-01-01", "1999-12-31")
    return rounded(x.select("symbol", "dt", *[(F.floor(F.col(c) * 1e4) / 1e4).alias(c) for c in ("open", "close")]))


def q_constituents(spark, d):
    path = scratch(spark, "names")
    k = F.col("s_suppkey")
    dt.table(spark, d, "supplier").select(F.when(k % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" s."), k.cast("string"), F.lit(" ")))).write.text(path)
    return sinks.read_constituents(spark, path)


def q_facts(spark, d):
    path = scratch(spark, "facts")
    s = dt.statements(spark, d)
    row = F.struct(F.lit("2020-01-01").alias("start"), F.date_format("report_date", "yyyy-MM-dd").alias("end"), F.date_format("publish_date", "yyyy-MM-dd").alias("filed"), F.round("revenue", 2).alias("val"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp"))
    x = s.groupBy(F.col("ticker").alias("cik")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units")))
    x.select("cik", F.struct(body.alias("us-gaap")).alias("facts")).write.json(path)
    found = fl.read_facts(spark, path, lines=True)
    return rounded(found.select("cik", "tag", "unit", F.col("arr_pos").cast("long").alias("arr_pos"), "end", "filed", "val", "form"), 2)


def q_ticker_map(spark, d):
    path = scratch(spark, "tickers")
    k = F.col("s_suppkey").cast("long")
    row = F.struct(F.concat(F.lit("s"), k.cast("string")).alias("ticker"), k.alias("cik_str"))
    dt.table(spark, d, "supplier").select(F.to_json(F.create_map(k.cast("string"), row))).write.text(path)
    return sinks.read_ticker_map(spark, path, lines=True)


def q_sic_map(spark, d):
    path = scratch(spark, "sic")
    k = F.col("s_suppkey").cast("string")
    code = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise((100 + F.col("s_suppkey") * 37 % 9000).cast("string"))
    dt.table(spark, d, "supplier").select(F.to_json(F.create_map(k, code))).write.text(path)
    return sinks.read_sic_map(spark, path, lines=True)


def q_read_statements(spark, d):
    path = scratch(spark, "statements")
    names = {"ticker": "Ticker", "report_date": "Report Date", "publish_date": "Publish Date", "revenue": "Revenue", "net_income": "Net Income"}
    x = dt.statements(spark, d).select(*[(F.round(c, 2) if c in ("revenue", "net_income") else F.col(c)).alias(n) for c, n in names.items()])
    x.write.csv(path, header=True, sep=";")
    return rounded(sinks.read_statements(spark, path, {n: c for c, n in names.items()}), 2)


LABELS = {"revenue": ["Total Revenue", "Operating Revenue"], "ebit": ["EBIT", "Operating Income"], "cash": ["Cash And Cash Equivalents"], "net_income": ["Net Income"], "total_assets": ["Total Assets"]}


def labelled(spark, d):
    """Statements by label: companies use one of two names for revenue, some both for operating income."""
    s = dt.statements(spark, d).withColumn("k", F.substring("ticker", 2, 6).cast("int"))
    row = lambda label, v, keep: s.where(keep).select("ticker", F.col("report_date").alias("period"), F.lit(label).alias("label"), v.alias("val"))
    k = F.col("k")
    out = row("Total Revenue", F.col("revenue"), k % 2 == 0).unionByName(row("Operating Revenue", F.col("revenue") * 0.9, F.lit(True)))
    out = out.unionByName(row("Operating Income", F.col("ebit"), F.lit(True))).unionByName(row("EBIT", F.col("ebit") * 1.1, k % 3 == 0))
    for label, c in (("Cash And Cash Equivalents", "cash"), ("Net Income", "net_income"), ("Total Assets", "total_assets")):
        out = out.unionByName(row(label, F.when(k % 4 == 0, F.lit(None)).otherwise(F.col(c)) if c == "cash" else F.col(c), F.lit(True)))
    return out


def q_labelled(spark, d):
    return rounded(sinks.read_labelled(labelled(spark, d), LABELS), 2)


def q_rates(spark, d):
    path = scratch(spark, "rates")
    dt.rates(spark, d).select("dt", F.when(F.dayofmonth("dt") % 5 == 0, F.lit(".")).otherwise(F.round(F.col("rf") * 100, 4).cast("string")).alias("rate")).write.csv(path, header=True)
    return rounded(sinks.read_rates(spark, path))


def q_csv_na(spark, d):
    path = scratch(spark, "na")
    dt.rates(spark, d).select("dt", F.when(F.month("dt") == 2, F.lit(".")).otherwise(F.round("rf", 6).cast("string")).alias("rf")).write.csv(path, header=True)
    return rounded(sinks.read_csv_na(spark, path, "dt date, rf double"))


def lock_files(spark, d):
    """Locks of the momentum book as rows of the JSON form."""
    x = pf.locks(spark, d).groupBy(F.col("book").alias("strategy"), "lock_date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "w"))).alias("picks"), F.map_from_entries(F.collect_list(F.struct("symbol", F.round("price", 4)))).alias("lock_prices"))
    return x


def q_read_locks(spark, d):
    path = scratch(spark, "locks")
    lock_files(spark, d).write.json(path)
    return rounded(sinks.read_locks(spark, path, lines=True), 4)


def q_write_lock(spark, d):
    path = scratch(spark, "book")
    x = pf.locks(spark, d)
    sinks.write_lock(x.where("lock_date < date'1998-01-01'"), path)
    sinks.write_lock(x.where("lock_date >= date'1998-01-01'"), path)
    return rounded(spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("prices")), 4)


def q_fills(spark, d):
    from asofspark.plans.checks import fills

    path = scratch(spark, "fills")
    x = fills(spark, d).select("account", "date", "side", "ticker", "shares", "dollars", F.lit("").alias("note"))
    sinks.append_fills(x.where("side = 'BUY'"), path)
    sinks.append_fills(x.where("side = 'SELL'"), path)
    return rounded(sinks.read_fills(spark, path).groupBy("account", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.min("date").alias("first")), 2)


def q_gap_row(spark, d):
    path = scratch(spark, "gaps")
    c = sc.buy_and_hold(pn.panel(dt.bars(spark, d)))
    x = c.where("run_id = 'Brand#1'").select(F.col("dt").alias("date"), F.date_sub("dt", F.dayofmonth("dt") % 4).alias("twin_asof"), F.col("equity").alias("real"), (F.col("equity") * 1.01).alias("twin"))
    sinks.append_gap_row(x, path)
    return spark.read.schema("date date, twin_asof date, real double, twin double, note string").csv(path, header=True).select("date", "twin_asof", F.coalesce("note", F.lit("")).alias("note"))


def q_dividends(spark, d):
    path = scratch(spark, "dividends")
    dt.dividends(spark, d).select("symbol", "ex_dt", F.when(F.dayofmonth("ex_dt") == 7, F.lit(0.0)).otherwise(F.round("amount", 4)).alias("amount")).write.csv(path, header=True)
    return rounded(sinks.read_dividends(spark, path), 4)


QUERIES = {name: _factor(cols) for name, cols in FACTORS.items()} | {name: _metric(col) for name, col in METRICS.items()}
QUERIES |= {
    "F12_string_date": q_scalars, "F13_math": q_math, "F15_levered_stacked": q_levered, "R1_pct_rank": q_pct_rank, "R2_composite": q_composite, "W1_inverse_vol": q_inverse_vol, "W2_vol_target": q_vol_target,
    "P16_buy_and_hold": q_hold, "A11_sic_sector": q_sic, "A17_post_events": q_posted, "A19_enterprise_value": q_ev, "S1_read_bars": q_read_bars, "S5_read_constituents": q_constituents, "S6_read_facts": q_facts,
    "S7_read_ticker_map": q_ticker_map, "S8_read_sic_map": q_sic_map, "S9_read_statements": q_read_statements, "S10_read_labelled": q_labelled, "S11_read_rates": q_rates, "S12_read_csv_na": q_csv_na,
    "S13_read_locks": q_read_locks, "S14_write_lock": q_write_lock, "S15_fills_journal": q_fills, "S16_gap_rows": q_gap_row, "S21_read_dividends": q_dividends,
}
_CAP = "CAST(printf('%.5e', {}) AS DOUBLE)"
_ALL = {"asset_growth": "total_assets / nullif(total_assets_prior, 0) - 1", "net_issuance": "shares / nullif(shares_prior, 0) - 1"}
_LABEL_ROWS = """s AS (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS k FROM statements), lb AS (
SELECT ticker, report_date AS period, 'revenue' AS field, CASE WHEN k % 2 = 0 THEN revenue ELSE revenue * 0.9 END AS val FROM s UNION ALL SELECT ticker, report_date, 'ebit', CASE WHEN k % 3 = 0 THEN ebit * 1.1 ELSE ebit END FROM s
UNION ALL SELECT ticker, report_date, 'cash', cash FROM s WHERE k % 4 <> 0 UNION ALL SELECT ticker, report_date, 'net_income', net_income FROM s UNION ALL SELECT ticker, report_date, 'total_assets', total_assets FROM s)"""
SQL = {name: f"WITH {CANONICAL_SQL} SELECT ticker, as_of, " + ", ".join(f"round({_ALL.get(c, c)}, 6) + 0.0 AS {c}" for c in cols) + " FROM factored" for name, cols in FACTORS.items()}
SQL |= {
    name: f"{pf.CRET}, m AS (SELECT run_id, {pf._M} FROM cu GROUP BY 1) SELECT run_id, " + ("max_dd_days" if c == "max_dd_days" else f"round({'cagr / nullif(abs(max_drawdown), 0)' if c == 'calmar' else c}, 5) + 0.0 AS {c}") + " FROM m"
    for name, c in METRICS.items()
}
SQL |= {
    "F12_string_date": """SELECT strftime(o_orderdate, '%Y-%m') AS month, lower(trim(regexp_replace(o_orderpriority, '^[0-9]-', ''))) AS priority, count(*) AS n,
CAST(sum(len(list_filter(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 9, INTERVAL 1 DAY), lambda x: isodow(x) < 6))) AS BIGINT) AS bdays, max(last_day(CAST(o_orderdate AS DATE))) AS month_end, min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS first_day FROM orders GROUP BY 1, 2""",
    "F13_math": f"{PANEL} SELECT symbol, dt, round(ln(1 + ret), 6) + 0.0 AS log_return, round(sqrt(abs(ret)), 6) + 0.0 AS root, CAST(sign(ret) AS DOUBLE) + 0.0 AS sign, round(least(greatest(ret, -0.1), 0.1), 6) + 0.0 AS clipped, {_CAP.format('pow(1 + ret, 52)')} AS annual FROM rets WHERE ret IS NOT NULL",
    "F15_levered_stacked": f"{PANEL}, {dt.RATES_SQL} SELECT symbol, dt, round(2.0 * ret - (rf + 0.005) / 252, 6) + 0.0 AS levered, round(ret + 0.5 * (0.3 * ret) - 0.5 * (rf + 0.005) / 252, 6) + 0.0 AS stacked FROM rets JOIN rates USING (dt) WHERE ret IS NOT NULL",
    "R1_pct_rank": f"WITH {CANONICAL_SQL}, {_ranks_sql('factored', 'as_of, sector')} SELECT ticker, as_of, {r6('ev_ebit_pct')} AS ev_ebit_pct FROM factored_r",
    "R2_composite": f"WITH {CANONICAL_SQL}, {_ranks_sql('factored', 'as_of, sector', DIGITS)} SELECT ticker, as_of, CAST(n_factors AS BIGINT) AS n_factors, {r6('composite')} AS composite FROM factored_c",
    "W1_inverse_vol": f"{pf.TREND} SELECT run_id, mark, symbol, {r6('w')} AS w FROM iv",
    "W2_vol_target": f"{pf.TREND} SELECT run_id, mark, {r6('sum(w)')} AS gross FROM vt GROUP BY 1, 2",
    "P16_buy_and_hold": f"{pf.CURVES} SELECT run_id, dt, round(equity, 4) + 0.0 AS equity FROM curves",
    "A11_sic_sector": "WITH x AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CAST(100 + s_suppkey * 37 % 9000 AS BIGINT) AS code FROM supplier) SELECT cik, code, CASE " + " ".join(f"WHEN code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in SECTORS) + " END AS sector FROM x",
    "A17_post_events": f"{PANEL}, {dt.DIVIDENDS_SQL}, d AS (SELECT symbol, dt, lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS before FROM bars) SELECT d.symbol, d.dt, round(sum(amount), 6) + 0.0 AS amount FROM d JOIN dividends v ON d.symbol = v.symbol AND ex_dt <= dt AND coalesce(ex_dt > before, true) GROUP BY 1, 2",
    "A19_enterprise_value": f"WITH {CANONICAL_SQL} SELECT ticker, as_of, round(CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 3 = 0 AND market_cap IS NOT NULL THEN market_cap * 1.1 ELSE enterprise_value END, 2) + 0.0 AS enterprise_value FROM canonical",
    "S1_read_bars": f"{PANEL} SELECT symbol, dt, round(floor(open * 1e4) / 1e4, 6) + 0.0 AS open, CASE WHEN day(dt) = 13 THEN NULL ELSE round(floor(close * 1e4) / 1e4, 6) + 0.0 END AS close FROM bars WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
    "S5_read_constituents": "SELECT 'S-' || s_suppkey AS symbol FROM supplier WHERE s_suppkey % 7 <> 0",
    "S6_read_facts": f"WITH {dt.statements_sql()} SELECT ticker AS cik, 'Revenues' AS tag, 'USD' AS unit, row_number() OVER (PARTITION BY ticker ORDER BY report_date) - 1 AS arr_pos, report_date AS \"end\", publish_date AS filed, round(revenue, 2) + 0.0 AS val, '10-K' AS form FROM statements",
    "S7_read_ticker_map": "SELECT 'S' || s_suppkey AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier",
    "S8_read_sic_map": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE lpad(CAST(100 + s_suppkey * 37 % 9000 AS VARCHAR), 4, '0') END AS sic FROM supplier",
    "S9_read_statements": f"WITH {dt.statements_sql()} SELECT ticker, report_date, publish_date, round(revenue, 2) + 0.0 AS revenue, round(net_income, 2) + 0.0 AS net_income FROM statements",
    "S10_read_labelled": f"WITH {dt.statements_sql()}, {_LABEL_ROWS} SELECT ticker, period, field, round(val, 2) + 0.0 AS val FROM lb WHERE val IS NOT NULL",
    "S11_read_rates": f"WITH {dt.RATES_SQL} SELECT dt, round(round(rf * 100, 4) / 100, 6) + 0.0 AS rf FROM rates WHERE day(dt) % 5 <> 0",
    "S12_read_csv_na": f"WITH {dt.RATES_SQL} SELECT dt, round(rf, 6) + 0.0 AS rf FROM rates WHERE month(dt) <> 2",
    "S13_read_locks": f"{pf.LOCKS} SELECT book, lock_date, symbol, CAST(w AS DOUBLE) AS w, round(price, 4) + 0.0 AS price FROM locks",
    "S14_write_lock": f"{pf.LOCKS} SELECT strftime(lock_date, '%Y-%m') AS month, count(*) AS n, round(sum(price), 4) + 0.0 AS prices FROM locks GROUP BY 1",
    "S15_fills_journal": "SELECT CAST(o_custkey AS VARCHAR) AS account, CASE WHEN l_linenumber >= 4 THEN 'SELL' ELSE 'BUY' END AS side, count(*) AS n, round(sum(l_quantity / CASE WHEN l_linenumber >= 4 THEN 2 ELSE 1 END), 2) + 0.0 AS shares, min(CAST(l_shipdate AS DATE)) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "S16_gap_rows": f"{PANEL}, x AS (SELECT dt AS date, dt - CAST(day(dt) % 4 AS INTEGER) AS twin_asof FROM panel WHERE symbol = 'Brand#1') SELECT date, twin_asof, CASE WHEN len(list_filter(generate_series(twin_asof, date - 1, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) > 1 THEN 'PROVISIONAL' ELSE '' END AS note FROM x",
    "S21_read_dividends": f"WITH {dt.DIVIDENDS_SQL} SELECT symbol, ex_dt, round(amount, 4) + 0.0 AS amount FROM dividends WHERE day(ex_dt) <> 7 AND round(amount, 4) <> 0",
}
