"""Data contracts and reconciliation checks; each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate_bars(bars: DataFrame) -> DataFrame:
    """rule, symbol, dt of missing or non-positive prices, highs below lows, and repeated dates."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing, low = F.lit(False), F.lit(False)
    for p in prices:
        missing, low = missing | p.isNull() | F.isnan(p), low | (p <= 0)
    rules = F.array_compact(F.array(F.when(missing, F.lit("missing")), F.when(low, F.lit("not positive")), F.when(F.col("high") < F.col("low"), F.lit("high below low"))))
    broken = bars.select("symbol", "dt", F.explode(rules).alias("rule"))
    twice = bars.groupBy("symbol", "dt").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol", "dt", F.lit("repeated date").alias("rule"))
    return broken.unionByName(twice).select("rule", "symbol", "dt")


def validate_panel(panel: DataFrame, px: str = "px") -> DataFrame:
    """rule, symbol, n of a price panel: dates that repeat, symbols without any price, prices of 0 or less."""
    x = panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("dt").alias("_d"), F.count(px).alias("_p"), F.count(F.when(F.col(px) <= 0, 1)).alias("_low"))
    rules = [("repeated date", F.col("_n") - F.col("_d")), ("no price", F.when(F.col("_p") == 0, 1).otherwise(0).cast("long")), ("not positive", F.col("_low"))]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), n.cast("long").alias("n")) for name, n in rules])).alias("e")
    return x.select("symbol", each).select("e.rule", "symbol", "e.n").where("n > 0")


def raise_if_any(violations: DataFrame) -> DataFrame:
    """Fails with the number of violations; returns the (empty) table otherwise."""
    n = violations.count()
    if n:
        raise ValueError(f"{n} violations")
    return violations


def drop_dead(panel: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The panel without symbols that have no value in some field at all; and those symbols."""
    counts = panel.groupBy("symbol").agg(*[F.count(f).alias(f) for f in fields])
    dead = counts.where(F.least(*[F.col(f) for f in fields]) == 0 if len(fields) > 1 else F.col(fields[0]) == 0).select("symbol")
    return panel.join(dead, "symbol", "left_anti"), dead


def trim_partial_tail(bars: DataFrame) -> DataFrame:
    """Bars up to the last date that all symbols have."""
    n = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_n"))
    full = bars.groupBy("dt").agg(F.count_distinct("symbol").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).agg(F.max("dt").alias("_last"))
    return bars.join(F.broadcast(full), F.col("dt") <= F.col("_last")).drop("_last")


def missing_on_last_row(bars: DataFrame) -> DataFrame:
    """Symbols without a bar on the last date."""
    last = bars.agg(F.max("dt").alias("dt"))
    return bars.select("symbol").distinct().join(bars.join(F.broadcast(last), "dt").select("symbol"), "symbol", "left_anti")


def staleness_bdays(bars: DataFrame, today: str) -> DataFrame:
    """symbol, last, bdays: weekdays from each symbol's last bar (included) to a day (excluded)."""
    day = F.lit(today).cast("date")
    last = bars.groupBy("symbol").agg(F.max("dt").alias("last"))
    days = F.when(F.col("last") < day, F.size(F.filter(F.sequence("last", F.date_sub(day, 1)), lambda d: F.weekday(d) < 5))).otherwise(0)
    return last.withColumn("bdays", days)


def vendor_spot_check(ours: DataFrame, theirs: DataFrame, most: float = 0.01) -> DataFrame:
    """Adds deviation: our price against the vendor's current or previous one, whichever is nearer; and whether it passes."""
    x = ours.join(theirs, "symbol")
    off = F.least(F.abs(F.col("price") / F.col("cur") - 1), F.abs(F.col("price") / F.col("prev") - 1))
    return x.select("symbol", off.alias("deviation"), (off <= most).alias("passes"))


def vendor_history_check(ours: DataFrame, theirs: DataFrame, n: int = 500, least: int = 250) -> DataFrame:
    """symbol, n, corr, median_diff, passes over the last n common returns."""
    w = Window.partitionBy("symbol").orderBy("dt")
    ret = lambda df, name: df.select("symbol", "dt", (F.col("px") / F.lag("px").over(w) - 1).alias(name)).where(f"{name} is not null")
    x = ret(ours, "ra").join(ret(theirs, "rb"), ["symbol", "dt"])
    x = x.withColumn("_p", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))).where(F.col("_p") <= n)
    out = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("corr"), F.percentile(F.abs(F.col("ra") - F.col("rb")), F.lit(0.5)).alias("median_diff"))
    return out.withColumn("passes", (F.col("n") >= least) & (F.col("corr") >= 0.98) & (F.col("median_diff") <= 0.001))


def price_with_fallback(quotes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First positive price of each symbol by vendor priority; and the wanted symbols without one."""
    good = quotes.where((F.col("price") > 0) & ~F.isnan("price")).groupBy("symbol").agg(F.min_by("price", "priority").alias("price"))
    return wanted.join(good, "symbol"), wanted.join(good, "symbol", "left_anti")


def quote_guard(quotes: DataFrame, far: float = 0.05, near: float = 0.02) -> DataFrame:
    """Keeps a quote that is far from the close only if an intraday price is near it; else the close."""
    apart = F.abs(F.col("quote") / F.col("close") - 1) > far
    backed = F.coalesce(F.abs(F.col("intraday") / F.col("quote") - 1) <= near, F.lit(False))
    return quotes.withColumn("price", F.when(apart & ~backed, F.col("close")).otherwise(F.col("quote")))


def rate_sanity(rates: DataFrame, most: float = 0.15) -> DataFrame:
    """check, status, message: whether all rates lie in [0, most)."""
    bad = F.count_if((F.col("rf") < 0) | (F.col("rf") >= most))
    return rates.agg(bad.alias("_b")).select(F.lit("rates").alias("check"), F.when(F.col("_b") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat(F.col("_b").cast("string"), F.lit(" out of range")).alias("message"))


def priceable_topn(ranked: DataFrame, prices: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The first n names of a ranking (place) that have a price, among max(5n, 25) candidates."""
    near = ranked.where(F.col("place") <= max(5 * n, 25)).join(prices.where("price > 0").select(key), key, "left_semi")
    return near.withColumn("_p", F.row_number().over(Window.orderBy("place"))).where(F.col("_p") <= n).drop("_p")
