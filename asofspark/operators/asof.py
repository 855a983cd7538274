"""Point-in-time operators: what was known at a date, and prices around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast hint for a table of ``most`` rows at most, which is counted; a larger one is left to the planner."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def statements_asof(statements: DataFrame, asofs: DataFrame, keep: int = 2) -> DataFrame:
    """The ``keep`` latest statements of each ticker published by each date; ``age`` 1 is the latest.

    A statement is among them from its own publication to that of the ``keep``-th newer one, so each
    meets only the dates of that interval: the join gives ``keep`` rows a ticker and date, however many were published before.
    """
    newer = Window.partitionBy("ticker").orderBy("report_date").rowsBetween(1, Window.unboundedFollowing)
    left = F.get(F.array_sort(F.collect_list("publish_date").over(newer)), F.lit(keep - 1))
    spans = statements.where("publish_date is not null").withColumn("_left", left)
    known = spans.join(few(asofs), (F.col("publish_date") <= F.col("as_of")) & (F.col("_left").isNull() | (F.col("as_of") < F.col("_left")))).drop("_left")
    age = F.row_number().over(Window.partitionBy("ticker", "as_of").orderBy(F.desc("report_date")))
    return known.withColumn("age", age).where(F.col("age") <= keep)


def statements_latest(statements: DataFrame, keep: int = 2) -> DataFrame:
    """The ``keep`` latest statements of each ticker, whenever published."""
    age = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("report_date")))
    return statements.withColumn("age", age).where(F.col("age") <= keep)


def side_by_side(ranked: DataFrame, lines: Sequence[str]) -> DataFrame:
    """One row per ticker and date: lines of age 1, lines of age 2 with suffix _prior, and yearly histories, newest first."""
    at = lambda name, k: F.max(F.when(F.col("age") == k, F.col(name)))
    history = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("age", F.col(name).alias("v"))))), lambda x: x["v"])
    return ranked.groupBy("ticker", "sector", "as_of").agg(
        at("report_date", 1).alias("report_date"), at("publish_date", 1).alias("publish_date"),
        *[at(n, 1).alias(n) for n in lines], *[at(n, 2).alias(f"{n}_prior") for n in lines],
        history("revenue").alias("revenue_history"), history("gross_profit").alias("gross_profit_history"),
    )


def debt(suffix: str = "") -> Column:
    """Long- and short-term debt; missing only if both are."""
    long, short = F.col(f"long_term_debt{suffix}"), F.col(f"short_term_debt{suffix}")
    return F.when(long.isNull() & short.isNull(), F.lit(None)).otherwise(F.coalesce(long, F.lit(0.0)) + F.coalesce(short, F.lit(0.0)))


def enterprise_value(given: Column | None = None) -> Column:
    """The source's value if there is one, else capitalization + debt - cash."""
    own = F.col("market_cap") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    return own if given is None else F.coalesce(given, own)


def canonical_from_statements(wide: DataFrame, prices: DataFrame) -> DataFrame:
    """Derived fields of side_by_side() rows; expenses and investment are negative in statements."""
    paid = F.try_divide(-F.col("tax_expense"), F.col("pretax"))
    rate = F.when(paid < 0, 0.0).when(paid > 0.6, 0.6).otherwise(paid)
    out = wide.join(prices, ["ticker", "as_of"], "left")
    return out.withColumns(
        {
            "total_debt": debt(), "total_debt_prior": debt("_prior"), "ebitda": F.col("ebit") + F.col("depreciation"), "tax_rate": rate,
            "free_cash_flow": F.col("cfo") + F.col("capex"), "market_cap": F.col("price") * F.col("shares"), "income_continuing": F.col("net_income"),
            "securities": F.lit(None).cast("double"), "securities_prior": F.lit(None).cast("double"),
        }
    ).withColumn("enterprise_value", enterprise_value())


def rebalance_dates(calendar: DataFrame, every: str = "3 months") -> DataFrame:
    """First calendar row on or after each target (``every`` from the first day of the first month), without those past the end."""
    span = calendar.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    targets = span.select(F.explode(F.expr(f"sequence(cast(date_trunc('month', a) as date), b, interval {every})")).alias("target"))
    return calendar.join(F.broadcast(targets), F.col("dt") >= F.col("target")).groupBy("target").agg(F.min("dt").alias("dt"))


def last_within(prices: DataFrame, spans: DataFrame, start: str, end: str, price: str = "px") -> DataFrame:
    """Adds _last to ``spans`` (symbol, ``start``, ``end``, ...): the symbol's last price in (start, end], null without one.

    Prices and spans of a symbol are one stream in the order of dates; each span looks back from its end to the last price.
    """
    own = [c for c in spans.columns if c != "symbol"]
    known = prices.where(F.col(price).isNotNull()).select("symbol", F.col("dt").alias("_at"), F.lit(0).alias("_k"), F.struct(F.col("dt").alias("d"), F.col(price).alias("p")).alias("_p"))
    asked = spans.select("symbol", F.col(end).alias("_at"), F.lit(1).alias("_k"), F.struct(*own).alias("_s"))
    seen = F.last("_p", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("_at", "_k"))
    x = known.unionByName(asked, allowMissingColumns=True).withColumn("_seen", seen).where("_k = 1")
    return x.select("symbol", "_s.*", F.when(F.col("_seen.d") > F.col(f"_s.{start}"), F.col("_seen.p")).alias("_last"))


def forward_return(bars: DataFrame, pairs: DataFrame, price: str = "close") -> DataFrame:
    """Return of each symbol from d to d1; a symbol without a price at d1 counts at its last trade in (d, d1]."""
    prices = bars.select("symbol", "dt", F.col(price).alias("p"))
    start = pairs.join(prices, pairs["d"] == prices["dt"]).select("d", "d1", "symbol", F.col("p").alias("p0"))
    ended = last_within(prices, start, "d", "d1", "p").withColumnRenamed("_last", "p1")
    return ended.where("p0 > 0 and p1 > 0").select("d", "d1", "symbol", (F.col("p1") / F.col("p0") - 1).alias("fwd"))


def post_forward(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Event amounts summed on the first bar of their symbol on or after the event: symbol, dt, amount."""
    days = bars.select("symbol", "dt", F.lag("dt").over(Window.partitionBy("symbol").orderBy("dt")).alias("_before"))
    near = events.withColumnRenamed("symbol", "_s")
    met = days.join(near, (F.col("symbol") == F.col("_s")) & (F.col("ex_dt") <= F.col("dt")) & (F.coalesce(F.col("ex_dt") > F.col("_before"), F.lit(True))))
    return met.groupBy("symbol", "dt").agg(F.sum("amount").alias("amount"))


def asof_fill(calendar: DataFrame, values: DataFrame, value: str, default: float | None = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Last value known at or before each calendar row; ``default`` before the first one.  Series are told apart by the columns ``by``."""
    both = calendar.select(*by, "dt", F.lit(True).alias("_row"), F.lit(None).cast("double").alias(value)).unionByName(values.select(*by, "dt", F.lit(False).alias("_row"), value))
    held = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy("dt", "_row"))
    return both.withColumn(value, F.coalesce(held, F.lit(default))).where("_row").select(*by, "dt", value)


def canonical_from_filings(flat: DataFrame, prices: DataFrame, sectors: DataFrame) -> DataFrame:
    """Derived fields of extract_asof() rows (cik, as_of, fields and _prior), with prices (cik, as_of, price) and sectors (cik, sector).

    Filings give taxes, interest and investment as positive numbers.  Without operating income
    it is pretax income plus interest.
    """
    x = flat.join(prices, ["cik", "as_of"], "left").join(sectors, "cik", "left")
    paid = F.try_divide(F.col("tax_expense"), F.col("pretax"))
    ebit = F.coalesce("operating_income", F.col("pretax") + F.coalesce("interest", F.lit(0.0)))
    return x.withColumns(
        {
            "ebit": ebit, "ebitda": ebit + F.col("depreciation"), "total_debt": debt(), "total_debt_prior": debt("_prior"),
            "tax_rate": F.when(paid < 0, 0.0).when(paid > 0.6, 0.6).otherwise(paid), "free_cash_flow": F.col("cfo") - F.col("capex"), "market_cap": F.col("price") * F.col("shares"),
        }
    ).withColumn("enterprise_value", enterprise_value()).withColumn("source", F.lit("filings"))


def canonical_from_labels(values: DataFrame, info: DataFrame) -> DataFrame:
    """One row per ticker and period of read_labelled() values (ticker, period, field, val); cash, debt and shares fall back to ``info`` (ticker, cash, total_debt, shares)."""
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("val"))).alias(f)
    fields = ["revenue", "gross_profit", "ebit", "net_income", "total_assets", "cash", "total_debt", "shares", "cfo", "capex"]
    x = values.groupBy("ticker", "period").agg(*[pick(f) for f in fields])
    own = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in ("cash", "total_debt", "shares")}
    known = info.select("ticker", *[F.col(c).alias(f"_{c}") for c in own])
    return x.join(known, "ticker", "left").withColumns(own).withColumn("free_cash_flow", F.col("cfo") + F.col("capex")).drop(*[f"_{c}" for c in own]).withColumn("source", F.lit("labels"))


SOURCES = ("filings", "statements", "labels")


def route_source(source: str, **tables) -> DataFrame:
    """Canonical rows of the one source that a run uses; ``tables`` has a function for each name.  An unknown name raises ValueError.

    The rows carry their source, and a row of another one raises an error when it is computed, so two sources are never mixed.
    """
    if source not in SOURCES or source not in tables:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(tables))}")
    rows = tables[source]()
    if "source" not in rows.columns:
        return rows.withColumn("source", F.lit(source))
    same = F.when(F.col("source") == source, F.col("source")).otherwise(F.raise_error(F.lit(f"a row isn't of source {source}")).cast("string"))
    return rows.withColumn("source", same)


def pit_violations(selected: DataFrame) -> DataFrame:
    """Rows that show what wasn't known: published after the date, or an older report at a later date."""
    w = Window.partitionBy("ticker").orderBy("as_of")
    back = selected.withColumn("_last", F.lag("report_date").over(w))
    return back.where((F.col("publish_date") > F.col("as_of")) | (F.col("report_date") < F.col("_last"))).drop("_last")
