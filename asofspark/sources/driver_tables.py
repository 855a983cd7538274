"""Turns the driver's order tables into bars, statements, rates and other inputs.

Each adapter has a DataFrame form and, for the oracles, a DuckDB common table expression.
Expressions that only shape test data are written once, as SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand", unit: str = "week") -> DataFrame:
    """symbol, dt, open, high, low, close, volume from the unit prices of order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    # (day, order, line) as one number, so that the aggregate keeps to fixed-width buffers: lines have 3 bits, orders 40.
    order = F.expr("unix_date(cast(l_shipdate as date)) * 8796093022208 + l_orderkey * 8 + l_linenumber")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", F.date_trunc(unit, "l_shipdate").cast("date").alias("dt"))
        .agg(
            F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume"),
        )
    )


def tasks(spark: SparkSession, sf_dir: str, lines: int = 100_000) -> int:
    """Tasks that a panel of every part is dealt over: one for ``lines`` order lines, which have some ten times as many panel rows."""
    return max(8, table(spark, sf_dir, "lineitem").count() // lines)


def closes(spark: SparkSession, sf_dir: str, partitions: int) -> DataFrame:
    """symbol (a part's number, as in the lines), dt, close of weekly bars: lines are shuffled once, by part, so that what is grouped by symbol needs no more exchange."""
    order = F.expr("unix_date(cast(l_shipdate as date)) * 8796093022208 + l_orderkey * 8 + l_linenumber")  # as in bars(); the day is read from it again
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), order.alias("_o"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px")).repartition(partitions, "symbol")
    day = F.expr("date_from_unix_date(cast(shiftright(_o, 43) as int))")
    return lines.groupBy("symbol", F.date_trunc("week", day).cast("date").alias("dt")).agg(F.max_by("px", "_o").alias("close"))


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt: the weeks in which any part has a bar, found without making bars."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.date_trunc("week", "l_shipdate").cast("date").alias("dt")).where("dt is not null").distinct()


def bars_sql(symbol: str = "p_brand", unit: str = "week", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT symbol, dt, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT {symbol} AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS dt, l_quantity, l_extendedprice / l_quantity AS px,
               (epoch_us(l_shipdate) // 86400000000) * 1000000000000 + l_orderkey * 1000 + l_linenumber AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY symbol, dt)"""


#: The panel: every symbol on every calendar row from its first bar on; px is the padded close.
PANEL_SQL = """cal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS idx FROM (SELECT DISTINCT dt FROM bars)),
firsts AS (SELECT symbol, min(idx) AS f FROM bars JOIN cal USING (dt) GROUP BY symbol),
panel AS (
  SELECT s.symbol, c.idx, c.dt, b.open, b.high, b.low, b.close, b.volume,
         last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.idx) AS px
  FROM firsts s JOIN cal c ON c.idx >= s.f LEFT JOIN bars b ON b.symbol = s.symbol AND b.dt = c.dt),
rets AS (SELECT *, px / lag(px) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS ret FROM panel)"""


#: Statement lines as fixed fractions of revenue and gross profit; k is the company, y the year.
_LINES = [
    ("total_assets", "revenue * (0.8 + (k % 7) / 10.0)"),
    ("ebit", "0.4 * gross_profit - 0.05 * revenue"),
    ("depreciation", "0.04 * revenue"),
    ("interest", "0.02 * revenue"),
    ("pretax", "ebit - interest"),
    ("tax_expense", "-0.21 * pretax"),
    ("net_income", "pretax + tax_expense"),
    ("current_assets", "0.45 * total_assets"),
    ("current_liabilities", "total_assets * (0.15 + (k % 5) / 25.0)"),
    ("long_term_debt", "total_assets * (k % 4) / 20.0"),
    ("short_term_debt", "CASE WHEN k % 9 = 0 THEN NULL ELSE 0.02 * total_assets END"),
    ("total_liabilities", "current_liabilities + long_term_debt"),
    ("equity", "total_assets - total_liabilities"),
    ("retained_earnings", "CASE WHEN k % 5 = 0 THEN -1.5 * total_assets ELSE 0.3 * equity + acctbal END"),
    ("cash", "0.1 * total_assets"),
    ("cfo", "net_income + depreciation"),
    ("capex", "-0.06 * revenue"),
    ("shares", "100.0 * (1 + k % 10) * (1 + 0.01 * (y - 1995))"),
    ("receivables", "0.15 * revenue * (CASE WHEN (k + y) % 4 = 0 THEN 2.5 ELSE 1.0 END)"),
    ("ppe", "0.3 * total_assets"),
    ("sga", "0.1 * revenue"),
]
LINES = ["revenue", "gross_profit", *(n for n, _ in _LINES)]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly statements: ticker, sector, report_date, publish_date and LINES (double)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    sums = lines.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y")).agg(
        F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"), F.sum(F.expr("l_quantity * p_retailprice")).alias("_cost")
    )
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", F.col("s_acctbal").alias("acctbal"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("sector"))
    out = sums.join(supplier, "k").join(nation, "s_nationkey").join(region, "n_regionkey").withColumn("gross_profit", F.expr("revenue - _cost"))
    for name, sql in _LINES:
        out = out.withColumn(name, F.expr(sql).cast("double"))
    report = F.make_date("y", F.lit(12), F.lit(31))
    return out.select(
        F.concat(F.lit("S"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("ticker"), "sector", report.alias("report_date"),
        F.date_add(report, (45 + F.col("k") % 60).cast("int")).alias("publish_date"), *LINES,
    )


def statements_sql() -> str:
    steps = """st0 AS (
  SELECT l_suppkey AS k, CAST(year(l_shipdate) AS BIGINT) AS y, sum(l_extendedprice * (1 - l_discount)) AS revenue,
         sum(l_extendedprice * (1 - l_discount)) - sum(l_quantity * p_retailprice) AS gross_profit
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
st1 AS (
  SELECT st0.*, s_acctbal AS acctbal, r_name AS sector FROM st0 JOIN supplier ON k = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
"""
    at = 1
    for name, sql in _LINES:
        steps += f"st{at + 1} AS (SELECT *, CAST({sql} AS DOUBLE) AS {name} FROM st{at}),\n"
        at += 1
    return steps + f"""statements AS (
  SELECT 'S' || lpad(CAST(k AS VARCHAR), 6, '0') AS ticker, sector, make_date(y, 12, 31) AS report_date,
         make_date(y, 12, 31) + CAST(45 + k % 60 AS INTEGER) AS publish_date, {", ".join(LINES)} FROM st{at})"""


#: As-of dates of the registered queries (fixed values).
ASOFS = ["1997-06-30", "1998-06-30"]
ASOFS_SQL = "asofs AS (SELECT CAST(x AS DATE) AS as_of FROM (VALUES ('1997-06-30'), ('1998-06-30')) v(x))"


def asofs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in ASOFS], "as_of string").select(F.col("as_of").cast("date").alias("as_of"))


def prices_asof(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """ticker, as_of, price: mean unit price of a company's lines in the ``days`` up to each as-of date."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    within = (F.col("d") <= F.col("as_of")) & (F.col("d") > F.date_sub("as_of", days))
    ticker = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("ticker")
    return lines.join(F.broadcast(asofs(spark)), within).groupBy(ticker, "as_of").agg(F.avg("px").alias("price"))


PRICES_ASOF_SQL = """prices_asof AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, as_of, avg(l_extendedprice / l_quantity) AS price
  FROM lineitem JOIN asofs ON CAST(l_shipdate AS DATE) <= as_of AND CAST(l_shipdate AS DATE) > as_of - 90 GROUP BY 1, 2)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt, rf: the weekly mean discount."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("dt")).agg(F.avg("l_discount").alias("rf"))


RATES_SQL = "rates AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, avg(l_discount) AS rf FROM lineitem GROUP BY 1)"


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ex_dt, amount: tax of returned lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("ex_dt")).agg(F.sum("l_tax").alias("amount"))


DIVIDENDS_SQL = "dividends AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ex_dt, sum(l_tax) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"
