"""Queries on data quality, filings, readers' shapes, lots and vendor checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.operators import asof as pit
from asofspark.operators import filings as fl
from asofspark.operators import panel as pn
from asofspark.operators import quality as qu
from asofspark.operators import ranking as rk
from asofspark.operators import scoring as sc
from asofspark.operators import timeseries as ts
from asofspark.plans.common import rounded
from asofspark.plans.timeseries import PANEL, mom
from asofspark.sources import driver_tables as dt


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.bars(spark, sf_dir)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as filing facts, with later amendments, quarter spans and other forms among them."""
    s = dt.statements(spark, sf_dir).select("ticker", "report_date", "publish_date", "net_income", "total_assets", "revenue")
    long = s.unpivot(["ticker", "report_date", "publish_date"], ["net_income", "total_assets", "revenue"], "tag", "val")
    base = long.select(F.col("ticker").alias("cik"), "tag", F.lit(0).alias("unit_pos"), F.lit(0).alias("arr_pos"), F.when(F.col("tag") != "total_assets", F.date_sub("report_date", 364)).alias("start"), F.col("report_date").alias("end"), F.col("publish_date").alias("filed"), "val", F.lit("10-K").alias("form"), F.lit("FY").alias("fp"))
    later = base.withColumns({"arr_pos": F.lit(1), "filed": F.date_add("filed", 200), "val": F.col("val") * 1.01, "form": F.lit("10-K/A")})
    short = base.withColumns({"arr_pos": F.lit(2), "start": F.date_sub("end", 90), "filed": F.date_sub("filed", 5), "val": F.col("val") / 4})
    other = base.withColumns({"arr_pos": F.lit(3), "form": F.lit("10-Q"), "filed": F.date_sub("filed", 9)})
    return base.unionByName(later).unionByName(short).unionByName(other)


def _tags(spark):
    return spark.createDataFrame([("net_income", "net_income", 0), ("total_assets", "total_assets", 0), ("revenue", "revenue", 0)], "field string, tag string, prio int")


FACTS = f"""{dt.statements_sql()}, {dt.ASOFS_SQL}, an AS (
  SELECT ticker AS cik, f AS field, report_date AS fy_end, CASE f WHEN 'net_income' THEN net_income WHEN 'total_assets' THEN total_assets / 4 ELSE revenue END AS val,
         CASE f WHEN 'total_assets' THEN publish_date - 5 ELSE publish_date END AS filed FROM statements, (VALUES ('net_income'), ('total_assets'), ('revenue')) v(f))"""


def q_annual(spark, d):
    x = facts(spark, d).withColumn("start", F.when(F.col("tag") != "total_assets", F.col("start")))
    return rounded(fl.annual_facts(x, _tags(spark)), 2)


def q_extract(spark, d):
    x = facts(spark, d).withColumn("start", F.when(F.col("tag") != "total_assets", F.col("start")))
    return rounded(fl.extract_asof(fl.annual_facts(x, _tags(spark)), dt.asofs(spark), ["net_income", "total_assets", "revenue"]), 2)


def q_revenue(spark, d):
    s = dt.statements(spark, d)
    k = F.substring("ticker", 2, 6).cast("int")
    one = lambda f, v, day, keep: s.where(keep).select(F.col("ticker").alias("cik"), F.lit(f).alias("field"), F.col("report_date").alias("fy_end"), v.alias("val"), day.alias("filed"))
    a = one("total", F.col("revenue"), F.col("publish_date"), k % 3 == 0)
    a = a.unionByName(one("goods", F.col("gross_profit"), F.col("publish_date"), k % 2 == 0)).unionByName(one("services", F.col("sga"), F.date_add("publish_date", 7), k % 5 != 0))
    return rounded(fl.annual_revenue(a), 2)


def q_validate(spark, d):
    b = bars(spark, d)
    bad = b.withColumn("high", F.when(F.dayofmonth("dt") == 13, F.col("low") - 1).otherwise(F.col("high"))).withColumn("close", F.when(F.dayofmonth("dt") == 20, F.lit(None)).otherwise(F.col("close")))
    return qu.validate_bars(bad.unionByName(bad.where("symbol = 'Brand#7' and month(dt) = 2")))


def q_drop_dead(spark, d):
    p = bars(spark, d).withColumn("open", F.when(F.col("symbol") != "Brand#5", F.col("open")))
    return qu.drop_dead(p, ["open", "close"])[1]


def q_trim(spark, d):
    b = bars(spark, d).where("symbol <> 'Brand#6' or dt < date'2001-06-01'")
    return qu.trim_partial_tail(b).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("last"))


def q_missing(spark, d):
    return qu.missing_on_last_row(bars(spark, d).where("symbol not in ('Brand#6', 'Brand#8') or dt < date'2001-06-01'"))


def q_stale(spark, d):
    return qu.staleness_bdays(bars(spark, d), "2001-12-05").withColumn("bdays", F.col("bdays").cast("long"))


def _vendors(spark, d):
    p = pn.panel(bars(spark, d)).select("symbol", "dt", "px")
    return p, p.withColumn("px", F.col("px") * (1 + F.dayofmonth("dt") % 3 / 10000.0))


def q_spot(spark, d):
    w = Window.partitionBy("symbol").orderBy("dt")
    x = pn.panel(bars(spark, d)).withColumns({"prev": F.lag("px").over(w), "last": F.max("idx").over(Window.partitionBy("symbol"))}).where("idx = last")
    return rounded(qu.vendor_spot_check(x.select("symbol", (F.col("px") * 1.004).alias("price")), x.select("symbol", F.col("px").alias("cur"), "prev")))


def q_history(spark, d):
    return rounded(qu.vendor_history_check(*_vendors(spark, d), 300, 200), 5)


def q_fallback(spark, d):
    p = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "dt").alias("close"), F.max_by("open", "dt").alias("open"))
    k = F.substring("symbol", 7, 3).cast("int")
    quotes = p.select("symbol", F.lit(1).alias("priority"), F.when(k % 3 != 0, F.col("close")).otherwise(0.0).alias("price")).unionByName(p.select("symbol", F.lit(2).alias("priority"), F.when(k % 2 == 0, F.col("open")).alias("price")))
    return rounded(qu.price_with_fallback(quotes, p.select("symbol"))[0], 4)


def q_guard(spark, d):
    b = bars(spark, d).select("symbol", "dt", F.col("close"), F.col("open").alias("quote"), ((F.col("high") + F.col("low")) / 2).alias("intraday"))
    return rounded(qu.quote_guard(b).select("symbol", "dt", "price"), 8)


def q_rates(spark, d):
    return qu.rate_sanity(dt.rates(spark, d))


def q_priceable(spark, d):
    x = pn.panel(bars(spark, d)).withColumn("mom", ts.momentum(4, 52)).where("idx = 200 and mom is not null")
    x = x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mom"), "symbol")))
    price = x.select("symbol", F.when(F.substring("symbol", -1, 1) != "1", F.col("px")).alias("price"))
    return qu.priceable_topn(x, price, 5).select("symbol", F.col("place").cast("long").alias("place"))


def q_top_frac(spark, d):
    x = pn.panel(bars(spark, d)).withColumn("mom", ts.momentum(4, 52)).where("idx % 52 = 4 and idx > 56")
    return rounded(rk.top_n(x, ("idx",), "mom", share=0.2).select(F.col("idx").cast("long").alias("idx"), "symbol", "w"))


def q_rebalance(spark, d):
    return pit.rebalance_dates(bars(spark, d).select("dt").distinct())


def q_asof_fill(spark, d):
    r = dt.rates(spark, d).where("month(dt) % 2 = 0")
    return rounded(pit.asof_fill(bars(spark, d).select("dt").distinct(), r, "rf"))


def q_bounded_fill(spark, d):
    """Prices carried forward over three rows at most."""
    p = pn.panel(bars(spark, d)).withColumn("x", F.when(F.col("idx") % 7 == 0, F.col("close")))
    return rounded(p.select("symbol", "dt", F.last("x", ignorenulls=True).over(ts.by_symbol().rowsBetween(-3, 0)).alias("x")), 8)


def q_forward(spark, d):
    days = spark.createDataFrame([("1996-02-05", "1996-08-05"), ("1997-03-03", "1997-12-24")], "d string, d1 string").withColumns({c: F.col(c).cast("date") for c in ("d", "d1")})
    return rounded(pit.forward_return(bars(spark, d), days))


def q_pivot(spark, d):
    x = bars(spark, d).where("symbol in ('Brand#1', 'Brand#2', 'Brand#3')")
    return rounded(x.groupBy("dt").pivot("symbol", ["Brand#1", "Brand#2", "Brand#3"]).agg(F.first("close")), 8)


def q_unpivot(spark, d):
    wide = bars(spark, d).select("symbol", "dt", "open", "close")
    return rounded(wide.unpivot(["symbol", "dt"], ["open", "close"], "field", "value"), 8)


def fills(spark, sf_dir: str) -> DataFrame:
    """Order lines as fills: the fourth line of an order and beyond sells half of what the first bought."""
    o = dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x = dt.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(dt.table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(F.col("o_custkey").cast("string").alias("account"), F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_linenumber") >= 4, "SELL").otherwise("BUY").alias("side"), F.col("p_type").alias("ticker"), F.when(F.col("l_linenumber") >= 4, F.col("l_quantity") / 2).otherwise(F.col("l_quantity")).alias("shares"), F.when(F.col("l_linenumber") >= 4, F.col("l_extendedprice") / 2).otherwise(F.col("l_extendedprice")).alias("dollars"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def q_lots(spark, d):
    return rounded(sc.lots_hifo(fills(spark, d)), 4)


def q_lots_report(spark, d):
    p = fills(spark, d).groupBy("ticker").agg((F.sum("dollars") / F.sum("shares")).alias("price"))
    return rounded(sc.lots_report(sc.lots_hifo(fills(spark, d)), p, "2000-01-01"), 2)


def q_realized(spark, d):
    return rounded(sc.realized_by_year(sc.lots_hifo(fills(spark, d))), 2)


def q_holdings(spark, d):
    every = fills(spark, d)
    h = every.where("side = 'BUY'").groupBy("ticker").agg(F.sum("shares").alias("shares"), F.sum("dollars").alias("cost"))
    p = every.where("ticker <> 'PROMO'").groupBy("ticker").agg((F.max("dollars") / F.max("shares")).alias("price"))
    return rounded(sc.holdings_report(h, p, 1000.0), 2)


QUERIES = {
    "A1_annual_facts": q_annual, "A3_extract_asof": q_extract, "A2_annual_revenue": q_revenue, "Q1_validate_bars": q_validate, "Q3_drop_dead": q_drop_dead, "Q6_trim_tail": q_trim,
    "Q7_missing_last_row": q_missing, "Q8_staleness": q_stale, "Q9_vendor_spot": q_spot, "Q10_vendor_history": q_history, "Q11_price_fallback": q_fallback, "Q12_quote_guard": q_guard,
    "Q13_rate_sanity": q_rates, "Q16_priceable_topn": q_priceable, "R6_top_fraction": q_top_frac, "A12_rebalance_dates": q_rebalance, "A13_asof_fill": q_asof_fill, "A14_bounded_fill": q_bounded_fill,
    "A16_forward_return": q_forward, "S3_pivot": q_pivot, "S2_unpivot": q_unpivot, "P20_lots_hifo": q_lots, "P21_lots_report": q_lots_report, "P21_realized_by_year": q_realized, "P17_holdings": q_holdings,
}
_B = f"WITH {dt.bars_sql()}"
_FILLS = """fills AS (SELECT CAST(o_custkey AS VARCHAR) AS account, CASE WHEN l_linenumber >= 4 THEN 'SELL' ELSE 'BUY' END AS side, p_type AS ticker, l_quantity / CASE WHEN l_linenumber >= 4 THEN 2 ELSE 1 END AS shares, l_extendedprice / CASE WHEN l_linenumber >= 4 THEN 2 ELSE 1 END AS dollars
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
SQL = {
    "A1_annual_facts": f"WITH {FACTS} SELECT cik, field, fy_end, round(val, 2) + 0.0 AS val, filed FROM an",
    "A3_extract_asof": f"""WITH {FACTS}, kn AS (SELECT * FROM an JOIN asofs ON filed <= as_of), yr AS (SELECT cik, as_of, fy_end, row_number() OVER (PARTITION BY cik, as_of ORDER BY fy_end DESC) AS age FROM kn WHERE field = 'net_income'),
bt AS (SELECT cik, as_of, max(fy_end) AS newest FROM yr WHERE age <= 2 GROUP BY 1, 2 HAVING count(*) = 2)
SELECT kn.cik, kn.as_of, newest AS fy_end, {", ".join(f"round(max(CASE WHEN field = '{f}' AND age = {k} THEN val END), 2) + 0.0 AS {f}{s}" for f in ("net_income", "total_assets", "revenue") for k, s in ((1, ""), (2, "_prior")))} FROM kn JOIN yr ON yr.cik = kn.cik AND yr.as_of = kn.as_of AND yr.fy_end = kn.fy_end AND age <= 2 JOIN bt ON bt.cik = kn.cik AND bt.as_of = kn.as_of GROUP BY 1, 2, 3""",
    "A2_annual_revenue": f"""WITH {dt.statements_sql()}, x AS (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS k FROM statements)
SELECT ticker AS cik, report_date AS fy_end, round(CASE WHEN k % 3 = 0 THEN revenue ELSE (CASE WHEN k % 2 = 0 THEN gross_profit ELSE 0 END) + (CASE WHEN k % 5 <> 0 THEN sga ELSE 0 END) END, 2) + 0.0 AS val,
       CASE WHEN k % 3 = 0 THEN publish_date WHEN k % 5 <> 0 THEN publish_date + 7 ELSE publish_date END AS filed FROM x WHERE k % 3 = 0 OR k % 2 = 0 OR k % 5 <> 0""",
    "Q1_validate_bars": f"""{_B}, b AS (SELECT symbol, dt, CASE WHEN day(dt) = 20 THEN NULL ELSE close END AS close, CASE WHEN day(dt) = 13 THEN low - 1 ELSE high END AS high, low FROM bars), c AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE symbol = 'Brand#7' AND month(dt) = 2)
SELECT 'missing' AS rule, symbol, dt FROM c WHERE close IS NULL UNION ALL SELECT 'not positive', symbol, dt FROM c WHERE high <= 0 UNION ALL SELECT 'high below low', symbol, dt FROM c WHERE high < low UNION ALL SELECT 'repeated date', symbol, dt FROM c GROUP BY 2, 3 HAVING count(*) > 1""",
    "Q3_drop_dead": f"{_B} SELECT symbol FROM bars GROUP BY 1 HAVING count(CASE WHEN symbol <> 'Brand#5' THEN open END) = 0",
    "Q6_trim_tail": f"{_B}, b AS (SELECT * FROM bars WHERE symbol <> 'Brand#6' OR dt < DATE '2001-06-01'), l AS (SELECT max(dt) AS l FROM (SELECT dt FROM b GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM b))) SELECT symbol, count(*) AS n, max(dt) AS last FROM b, l WHERE dt <= l GROUP BY 1",
    "Q7_missing_last_row": f"{_B}, b AS (SELECT * FROM bars WHERE symbol NOT IN ('Brand#6', 'Brand#8') OR dt < DATE '2001-06-01') SELECT symbol FROM b GROUP BY 1 HAVING max(dt) < (SELECT max(dt) FROM b)",
    "Q8_staleness": f"{_B}, l AS (SELECT symbol, max(dt) AS last FROM bars GROUP BY 1) SELECT symbol, last, CAST(len(list_filter(generate_series(last, DATE '2001-12-04', INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS BIGINT) AS bdays FROM l",
    "Q9_vendor_spot": f"{PANEL}, x AS (SELECT symbol, idx, px, lag(px) OVER (PARTITION BY symbol ORDER BY idx) AS prev, max(idx) OVER (PARTITION BY symbol) AS m FROM panel) SELECT symbol, round(least(abs(px * 1.004 / px - 1), abs(px * 1.004 / prev - 1)), 6) + 0.0 AS deviation, least(abs(px * 1.004 / px - 1), abs(px * 1.004 / prev - 1)) <= 0.01 AS passes FROM x WHERE idx = m",
    "Q10_vendor_history": f"""{PANEL}, t AS (SELECT symbol, dt, idx, px, px * (1 + day(dt) % 3 / 10000.0) AS q FROM panel), r AS (SELECT symbol, idx, px / lag(px) OVER w - 1 AS ra, q / lag(q) OVER w - 1 AS rb FROM t WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS p FROM r WHERE ra IS NOT NULL), s AS (SELECT symbol, count(*) AS n, corr(ra, rb) AS c, quantile_cont(abs(ra - rb), 0.5) AS m FROM k WHERE p <= 300 GROUP BY 1) SELECT symbol, n, round(c, 5) + 0.0 AS corr, round(m, 5) + 0.0 AS median_diff, n >= 200 AND c >= 0.98 AND m <= 0.001 AS passes FROM s""",
    "Q11_price_fallback": f"{_B}, p AS (SELECT symbol, CAST(substr(symbol, 7) AS INTEGER) AS k, arg_max(close, dt) AS c, arg_max(open, dt) AS o FROM bars GROUP BY 1) SELECT symbol, round(CASE WHEN k % 3 <> 0 THEN c ELSE o END, 4) + 0.0 AS price FROM p WHERE k % 3 <> 0 OR k % 2 = 0",
    "Q12_quote_guard": f"{_B} SELECT symbol, dt, round(CASE WHEN abs(open / close - 1) > 0.05 AND NOT (abs((high + low) / 2 / open - 1) <= 0.02) THEN close ELSE open END, 8) + 0.0 AS price FROM bars",
    "Q13_rate_sanity": f"WITH {dt.RATES_SQL} SELECT 'rates' AS \"check\", CASE WHEN count(*) FILTER (WHERE rf < 0 OR rf >= 0.15) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER (WHERE rf < 0 OR rf >= 0.15) || ' out of range' AS message FROM rates",
    "Q16_priceable_topn": f"{PANEL}, m AS (SELECT symbol, idx, {mom(4, 52)} AS mom FROM panel), p AS (SELECT symbol, row_number() OVER (ORDER BY mom DESC, symbol) AS place FROM m WHERE idx = 200 AND mom IS NOT NULL) SELECT symbol, place FROM p WHERE right(symbol, 1) <> '1' AND place <= 25 ORDER BY place LIMIT 5",
    "R6_top_fraction": f"{PANEL}, m AS (SELECT symbol, idx, {mom(4, 52)} AS mom FROM panel), p AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY mom DESC, symbol) AS p, greatest(1, floor(count(*) OVER (PARTITION BY idx) * 0.2)) AS k FROM m WHERE idx % 52 = 4 AND idx > 56 AND mom IS NOT NULL) SELECT idx, symbol, round(1.0 / k, 6) + 0.0 AS w FROM p WHERE p <= k",
    "A12_rebalance_dates": f"{_B}, t AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(dt)), max(dt), INTERVAL 3 MONTH)) AS DATE) AS target FROM bars) SELECT target, min(dt) AS dt FROM t JOIN bars ON dt >= target GROUP BY 1",
    "A13_asof_fill": f"{_B}, {dt.RATES_SQL}, c AS (SELECT DISTINCT dt FROM bars), r AS (SELECT * FROM rates WHERE month(dt) % 2 = 0) SELECT c.dt, round(coalesce(r.rf, 0), 6) + 0.0 AS rf FROM c ASOF LEFT JOIN r ON c.dt >= r.dt",
    "A14_bounded_fill": f"{PANEL} SELECT symbol, dt, round(last_value(CASE WHEN idx % 7 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) + 0.0 AS x FROM panel",
    "A16_forward_return": f"{_B}, p(d, d1) AS (VALUES (DATE '1996-02-05', DATE '1996-08-05'), (DATE '1997-03-03', DATE '1997-12-24')) SELECT d, d1, a.symbol, round(arg_max(b.close, b.dt) / any_value(a.close) - 1, 6) + 0.0 AS fwd FROM p JOIN bars a ON a.dt = d JOIN bars b ON b.symbol = a.symbol AND b.dt > d AND b.dt <= d1 GROUP BY 1, 2, 3",
    "S3_pivot": f"{_B} SELECT dt, " + ", ".join(f"round(max(CASE WHEN symbol = 'Brand#{k}' THEN close END), 8) + 0.0 AS \"Brand#{k}\"" for k in (1, 2, 3)) + " FROM bars WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1",
    "S2_unpivot": f"{_B} SELECT symbol, dt, 'open' AS field, round(open, 8) + 0.0 AS value FROM bars UNION ALL SELECT symbol, dt, 'close', round(close, 8) + 0.0 FROM bars",
    "P17_holdings": f"""WITH {_FILLS}, h AS (SELECT ticker, sum(shares) AS shares, sum(dollars) AS cost FROM fills WHERE side = 'BUY' GROUP BY 1), p AS (SELECT ticker, max(dollars) / max(shares) AS price FROM fills WHERE ticker <> 'PROMO' GROUP BY 1), x AS (SELECT ticker, shares * price AS value, shares * price - cost AS gain FROM h LEFT JOIN p USING (ticker))
SELECT ticker, round(value, 2) + 0.0 AS value, round(gain, 2) + 0.0 AS gain FROM x UNION ALL SELECT 'TOTAL', round(coalesce(sum(value), 0) + 1000, 2) + 0.0, round(sum(gain), 2) + 0.0 FROM x""",
}
