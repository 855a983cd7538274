"""Scoring of weight schedules, locks and accounts against prices."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.operators.asof import last_within


def segments(locks: DataFrame, end: Column | None = None) -> DataFrame:
    """lock_date, until, k of each lock of a book: it holds until the next one (the last until ``end``)."""
    days = locks.select("book", "lock_date").distinct()
    w = Window.partitionBy("book").orderBy("lock_date")
    return days.withColumns({"until": F.lead("lock_date").over(w), "k": F.row_number().over(w)}) if end is None else days.withColumns({"until": F.coalesce(F.lead("lock_date").over(w), end), "k": F.row_number().over(w)})


def score_locks(locks: DataFrame, prices: DataFrame, cost_bps: float, initial: float = 10_000.0) -> DataFrame:
    """One row per lock: turnover, seg_ret, value after it, cum_cost; baskets of (book, lock_date, symbol, w, price).

    A name's segment ends at its last price up to the next lock.  Turnover is against the
    drifted weights of the lock before, which don't depend on fees, so nothing is recursive.
    """
    last = prices.agg(F.max("dt").alias("_end"))
    segs = segments(locks)
    days = segs.join(F.broadcast(last)).withColumn("until", F.coalesce("until", "_end")).drop("_end")
    held = locks.join(days, ["book", "lock_date"])
    name = last_within(prices, held.select("book", "lock_date", "until", "k", "symbol", "w", "price"), "lock_date", "until").withColumnRenamed("_last", "p1")
    name = name.withColumn("r", F.coalesce(F.try_divide(F.col("p1"), F.col("price")) - 1, F.lit(0.0)))
    seg = name.groupBy("book", "lock_date", "k").agg(F.sum(F.col("w") * F.col("r")).alias("seg_ret"))
    seg = days.join(seg, ["book", "lock_date", "k"], "left").withColumn("seg_ret", F.coalesce("seg_ret", F.lit(0.0)))
    drifted = name.join(seg.select("book", "k", "seg_ret"), ["book", "k"]).select("book", (F.col("k") + 1).alias("k"), "symbol", (F.col("w") * (1 + F.col("r")) / (1 + F.col("seg_ret"))).alias("_d"))
    moved = name.select("book", "k", "symbol", "w").join(drifted, ["book", "k", "symbol"], "full_outer")
    turn = moved.groupBy("book", "k").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_d", F.lit(0.0)))).alias("turnover"))
    fee = cost_bps / 1e4
    out = seg.join(turn, ["book", "k"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    w = Window.partitionBy("book").orderBy("k")
    return out.withColumns(
        {
            "value": F.lit(initial) * F.product((1 - fee * F.col("turnover")) * (1 + F.col("seg_ret"))).over(w),
            "cum_cost": 1 - F.product(1 - fee * F.col("turnover")).over(w),
        }
    )


def daily_curve(locks: DataFrame, prices: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """book, dt, equity: daily marks inside each segment with its cash part, chained over the segments.

    The day that two segments share belongs to the earlier one.
    """
    last = prices.agg(F.max("dt").alias("_end"))
    days = segments(locks).join(F.broadcast(last)).withColumn("until", F.coalesce("until", "_end")).drop("_end")
    held = locks.join(days, ["book", "lock_date"])
    marks = held.join(prices.withColumnRenamed("symbol", "_s"), (F.col("symbol") == F.col("_s")) & (F.col("dt") > F.col("lock_date")) & (F.col("dt") <= F.col("until")))
    invested = held.groupBy("book", "k").agg(F.sum("w").alias("_sw"))
    inside = marks.groupBy("book", "k", "dt").agg(F.sum(F.col("w") * F.col("px") / F.col("price")).alias("_m")).join(invested, ["book", "k"]).withColumn("_f", F.col("_m") + 1 - F.col("_sw"))
    end = inside.groupBy("book", "k").agg(F.max_by("_f", "dt").alias("_g"))
    before = end.withColumn("_b", F.coalesce(F.product(F.col("_g")).over(Window.partitionBy("book").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return inside.join(before.select("book", "k", "_b"), ["book", "k"]).select("book", "dt", (F.lit(initial) * F.col("_b") * F.col("_f")).alias("equity"))


def mark_positions(locks: DataFrame, prices: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Entry, last price, return and profit on ``capital`` of every position of each book's last lock."""
    newest = locks.join(locks.groupBy("book").agg(F.max("lock_date").alias("lock_date")), ["book", "lock_date"])
    now = prices.groupBy("symbol").agg(F.max_by("px", "dt").alias("now"))
    r = F.try_divide(F.col("now"), F.col("price")) - 1
    return newest.join(now, "symbol", "left").select("book", "symbol", "w", F.col("price").alias("entry"), "now", (100 * r).alias("ret_pct"), (F.col("w") * capital * r).alias("pnl"))


def sector_weights(positions: DataFrame, sectors: DataFrame) -> DataFrame:
    """Absolute weight of each sector in percent of the book; unknown: Other."""
    x = positions.join(sectors, "symbol", "left").groupBy("book", F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.sum(F.abs("w")).alias("_w"))
    return x.select("book", "sector", (100 * F.col("_w") / F.sum("_w").over(Window.partitionBy("book"))).alias("pct"))


def shadow_levered(scored: DataFrame, leverage: float, spread: float) -> DataFrame:
    """Adds levered: the product over segments of 1 + L r - (L - 1)(rf + spread) years; rows of score_locks() with rf."""
    years = F.datediff("until", "lock_date") / 365.25
    growth = 1 + leverage * F.col("seg_ret") - (leverage - 1) * (F.coalesce("rf", F.lit(0.0)) + spread) * years
    return scored.withColumn("levered", F.product(growth).over(Window.partitionBy("book").orderBy("k")))


def signal_curve(signals: DataFrame, cost_bps: float, cash: float = 0.0, initial: float = 10_000.0, rounds: int = 4) -> DataFrame:
    """run_id, idx, dt, equity of single-asset signals decided at a close and filled at the next open.

    Rows of (run_id, idx, dt, open, close, signal).  What is traded at an open depends on the weight u that
    the position has drifted to, and u on the fee of the trade before: u' = s g / (s g + (1 - s - f |s - u|) c)
    with the target s, the fee f, the growth g of the price and c of cash.  A round
    of this map shrinks an error of u by the factor f, so ``rounds`` window passes are exact to f ** rounds;
    the equity is then a window product.
    """
    w = Window.partitionBy("run_id").orderBy("idx")
    fee, grow = cost_bps / 1e4, 1 + cash / 252
    x = signals.withColumns({"_s": F.coalesce(F.lag("signal").over(w), F.lit(0.0)), "_g": F.lead("open").over(w) / F.col("open")})
    x = x.withColumn("_u", F.lit(0.0))
    for _ in range(rounds):
        stock = F.col("_s") * F.col("_g")
        after = F.try_divide(stock, stock + (1 - F.col("_s") - fee * F.abs(F.col("_s") - F.col("_u"))) * grow)
        x = x.withColumn("_after", after).withColumn("_u", F.coalesce(F.lag("_after").over(w), F.lit(0.0)))
    rest = 1 - F.col("_s") - fee * F.abs(F.col("_s") - F.col("_u"))
    x = x.withColumns({"_m": F.col("_s") * F.col("_g") + rest * grow, "_now": F.col("_s") * F.col("close") / F.col("open") + rest})
    before = F.coalesce(F.product("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return x.select("run_id", "idx", "dt", (initial * grow * before * F.col("_now")).alias("equity"))


def signal_curve_free(signals: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """signal_curve() without costs and interest, as a window product of overnight and intraday legs."""
    w = Window.partitionBy("run_id").orderBy("idx")
    x = signals.withColumns({"_w": F.coalesce(F.lag("signal").over(w), F.lit(0.0)), "_o1": F.lead("open").over(w)})
    g = 1 + F.col("_w") * (F.col("_o1") / F.col("open") - 1)
    x = x.withColumn("_g", F.coalesce(F.product(g).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return x.select("run_id", "idx", "dt", (initial * F.col("_g") * (1 + F.col("_w") * (F.col("close") / F.col("open") - 1))).alias("equity"))


def stop_exits(held: DataFrame, closes: DataFrame, stop: float) -> DataFrame:
    """First close at or below entry x (1 - stop) of each long within its segment: run_id, symbol, start, exit_dt."""
    met = held.where("w > 0").join(closes.withColumnRenamed("symbol", "_s"), (F.col("symbol") == F.col("_s")) & (F.col("dt") >= F.col("start")) & (F.col("dt") < F.col("end")))
    hit = met.where(F.col("px") <= F.col("entry") * (1 - stop))
    return hit.groupBy("run_id", "symbol", "start").agg(F.min("dt").alias("exit_dt"))


def schedule_curve(
    weights: DataFrame, prices: DataFrame, cost_bps: float, initial: float = 10_000.0, rates: DataFrame | None = None, cash_rate: float = 0.0,
    financing: float = 0.0, borrow_bps: float = 0.0, rows_a_year: float = 252.0,
) -> DataFrame:
    """run_id, mark, equity, turnover at each rebalance of multi-asset schedules (run_id, mark, symbol, w), filled at px of the mark.

    A rebalance trades to its weights from those that the last ones have drifted to; fees come off the equity.
    What is not invested earns ``cash_rate``, or the rate of each row of ``rates`` (idx, rf); negative cash pays that
    plus ``financing``, shorts pay ``borrow_bps``, both a year and as simple interest within a segment.  A
    name without a price at either end stands still.  Drifted weights don't depend on fees, so nothing is
    recursive: growth comes from joins and the equity is a window product.
    """
    spans = weights.select("run_id", "mark").distinct()
    w = Window.partitionBy("run_id").orderBy("mark")
    spans = spans.withColumn("next", F.lead("mark").over(w))
    at = prices.select("symbol", F.col("idx").alias("_i"), "px")
    legs = weights.join(spans, ["run_id", "mark"])
    legs = legs.join(at.withColumnsRenamed({"_i": "mark", "px": "p0"}), ["symbol", "mark"], "left").join(at.withColumnsRenamed({"_i": "next", "px": "p1"}), ["symbol", "next"], "left")
    legs = legs.withColumn("g", F.coalesce(F.try_divide(F.col("p1"), F.col("p0")), F.lit(1.0)))
    seg = legs.groupBy("run_id", "mark", "next").agg(F.sum(F.col("w") * F.col("g")).alias("_grown"), (1 - F.sum("w")).alias("_cash"), F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("_short"))
    years = (F.col("next") - F.col("mark")) / rows_a_year
    if rates is None:
        seg = seg.withColumn("_rf", years * cash_rate)
    else:  # the sum of the rates from one mark to the next, as a difference of running sums
        total = rates.select(F.col("idx").alias("_i"), F.sum("rf").over(Window.orderBy("idx")).alias("_c"))
        seg = seg.join(total.withColumnsRenamed({"_i": "mark", "_c": "_c0"}), "mark", "left").join(total.withColumnsRenamed({"_i": "next", "_c": "_c1"}), "next", "left")
        seg = seg.withColumn("_rf", (F.col("_c1") - F.col("_c0")) / rows_a_year)
    interest = F.col("_rf") + F.when(F.col("_cash") < 0, years * financing).otherwise(0.0)
    earned = F.col("_grown") + F.col("_cash") * (1 + F.coalesce(interest, F.lit(0.0))) - F.coalesce(F.col("_short") * years * (borrow_bps / 1e4), F.lit(0.0))
    seg = seg.withColumn("_total", F.when(F.col("next").isNotNull(), earned).otherwise(1.0)).select("run_id", "mark", "_total")
    drifted = legs.join(seg, ["run_id", "mark"]).where("next is not null").select("run_id", F.col("next").alias("mark"), "symbol", (F.col("w") * F.col("g") / F.col("_total")).alias("_d"))
    moved = weights.select("run_id", "mark", "symbol", "w").join(drifted, ["run_id", "mark", "symbol"], "full_outer")
    turn = moved.groupBy("run_id", "mark").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_d", F.lit(0.0)))).alias("turnover"))
    paid = F.product(1 - F.col("turnover") * (cost_bps / 1e4)).over(w)
    grown = F.coalesce(F.product("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return turn.join(seg, ["run_id", "mark"]).select("run_id", F.col("mark").cast("long").alias("mark"), (initial * paid * grown).alias("equity"), "turnover")


def turnover_per_year(scored: DataFrame, rows_a_year: float) -> DataFrame:
    """Mean turnover a year of each run of schedule_curve()."""
    years = (F.max("mark") - F.min("mark")) / rows_a_year
    return scored.groupBy("run_id").agg(F.try_divide(F.sum("turnover"), years).alias("turnover_year"))


def two_leg_mix(legs: DataFrame, w: float, bps: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, dt, equity of two return streams (dt, ra, rb) mixed w : 1 - w and set back at each month's start, with cost on both legs.

    Many runs go through at once, told apart by the columns ``by``.
    """
    month = F.trunc("dt", "month")
    inside = Window.partitionBy(*by, "_mo").orderBy("dt")
    x = legs.withColumn("_mo", month).withColumns({"_a": F.product(1 + F.col("ra")).over(inside), "_b": F.product(1 + F.col("rb")).over(inside)})
    end = x.groupBy(*by, "_mo").agg(F.max_by("_a", "dt").alias("_ea"), F.max_by("_b", "dt").alias("_eb"))
    wo = Window.partitionBy(*by).orderBy("_mo")
    total = w * F.col("_ea") + (1 - w) * F.col("_eb")
    end = end.withColumns({"_drift": F.lag(w * F.col("_ea") / total).over(wo), "_total": total})
    end = end.withColumn("_turn", F.when(F.col("_drift").isNull(), 1.0).otherwise(2 * F.abs(w - F.col("_drift"))))
    end = end.withColumn("_start", F.coalesce(F.product(F.col("_total") * (1 - F.col("_turn") * bps / 1e4)).over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    out = x.join(end, [*by, "_mo"])
    return out.select(*by, "dt", (10_000.0 * F.col("_start") * (1 - F.col("_turn") * bps / 1e4) * (w * F.col("_a") + (1 - w) * F.col("_b"))).alias("equity"))


def constant_mix(legs: DataFrame, w: float | None = None, initial: float = 10_000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, dt, equity of daily w ra + (1 - w) rb; without w, by inverse volatility over the whole sample of each run."""
    if w is None:
        iv = legs.groupBy(*by).agg((1 / F.stddev_samp("ra")).alias("_ia"), (1 / F.stddev_samp("rb")).alias("_ib"))
        x = (legs.join(iv, list(by)) if by else legs.join(F.broadcast(iv))).withColumn("_w", F.col("_ia") / (F.col("_ia") + F.col("_ib")))
    else:
        x = legs.withColumn("_w", F.lit(w))
    r = F.col("_w") * F.col("ra") + (1 - F.col("_w")) * F.col("rb")
    return x.select(*by, "dt", (initial * F.product(1 + r).over(Window.partitionBy(*by).orderBy("dt"))).alias("equity"))


def lever_to_vol(legs: DataFrame, rf: float = 0.0, spread: float = 0.004, year: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, leverage and mean levered return of a stream ``rb`` brought to the volatility of ``ra``."""
    lev = F.stddev_samp("ra") / F.stddev_samp("rb")
    return legs.groupBy(*by).agg(lev.alias("leverage"), (lev * F.avg("rb") - (lev - 1) * (rf + spread) / year).alias("mean_levered"))


def tranche(curves: DataFrame) -> DataFrame:
    """Mean of all curves on the dates that all of them have."""
    k = curves.select("run_id").distinct().agg(F.count(F.lit(1)).alias("_k"))
    x = curves.groupBy("dt").agg(F.count(F.lit(1)).alias("_n"), F.avg("equity").alias("equity"))
    return x.join(F.broadcast(k), F.col("_n") == F.col("_k")).select("dt", "equity")


def equal_capital(curves: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """Curves rebased to 1 and averaged over those that exist on a date."""
    base = F.first("equity").over(Window.partitionBy("run_id").orderBy("dt"))
    return curves.withColumn("_e", F.col("equity") / base).groupBy("dt").agg((initial * F.avg("_e")).alias("equity"))


def buy_and_hold(panel: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """A curve for each symbol: price over its first price."""
    first = F.first("px").over(Window.partitionBy("symbol").orderBy("dt"))
    return panel.select(F.col("symbol").alias("run_id"), "dt", (initial * F.col("px") / first).alias("equity"))


def holdings_report(holdings: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """Market value and unrealized gain of each holding, with a TOTAL row that includes cash; unpriced rows are NULL."""
    x = holdings.join(prices, "ticker", "left").withColumn("value", F.col("shares") * F.col("price")).withColumn("gain", F.col("value") - F.col("cost"))
    total = x.agg(F.lit("TOTAL").alias("ticker"), (F.coalesce(F.sum("value"), F.lit(0.0)) + cash).alias("value"), F.sum("gain").alias("gain"))
    return x.select("ticker", "value", "gain").unionByName(total)


def twin_value(flows: DataFrame, curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, twin: every flow grown from the first curve date on or after it to the end; a flow after the last date adds nothing.

    The curve's dates and the flows' are one ordered stream in which each flow looks forward to the next curve row; accounts
    or runs, told apart by the columns ``by`` of both tables, are streams of their own.
    """
    none = F.lit(None).cast("double")
    both = curve.select(*by, "dt", F.lit(1).alias("_k"), "equity", none.alias("amount")).unionByName(flows.select(*by, "dt", F.lit(0).alias("_k"), none.alias("equity"), "amount"))
    ahead = Window.partitionBy(*by).orderBy("dt", "_k").rowsBetween(0, Window.unboundedFollowing)
    x = both.withColumns({"_anchor": F.first("equity", ignorenulls=True).over(ahead), "_end": F.last("equity", ignorenulls=True).over(ahead)})
    return x.where("_k = 0").groupBy(*by).agg(F.sum(F.col("amount") * F.col("_end") / F.col("_anchor")).alias("twin"))


def gap_report(gaps: DataFrame) -> DataFrame:
    """gap_bps of each row (dt, real, twin), and the drift a year from first to last."""
    x = gaps.withColumn("gap_bps", (F.col("real") / F.col("twin") - 1) * 1e4)
    years = F.datediff(F.max("dt"), F.min("dt")) / 365.25
    drift = x.agg(F.try_divide(F.max_by("gap_bps", "dt") - F.min_by("gap_bps", "dt"), years).alias("drift_bps_year"))
    return x.join(F.broadcast(drift))


#: Shares below which a lot or a sale is done, and days from which a gain is long term (fixed values).
LEAST_SHARES, YEAR_AND_DAY = 1e-9, 366
LOT_SCHEMA = "account string, ticker string, kind string, bought date, sold date, shares double, basis double, gain double, term string"


def lots_hifo(fills: DataFrame) -> DataFrame:
    """Open lots, realized sales and oversold errors of fills (account, date, side, ticker, shares, dollars, seq).

    A sale takes the open lots of the highest cost a share, the oldest of equal ones; what was held a
    year and a day is long term.  Fills stream by in order of (account, ticker, date); only the open lots of one account's
    ticker are held, in a heap, so a fill costs the logarithm of their number.
    """
    names = [c.split()[0] for c in LOT_SCHEMA.split(", ")]
    kinds = pa.schema([(c, {"date": pa.date32(), "double": pa.float64(), "string": pa.string()}[k]) for c, k in (f.split() for f in LOT_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, heap, rows = None, [], []  # heap of (-unit cost, order, day, [shares left])

        def closed() -> None:
            for unit, _, day, left in sorted(heap, key=lambda lot: lot[1]):
                rows.append((*owner, "open", day, None, left[0], -unit * left[0], None, None))
            heap.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.field(k).type) for k in range(len(names))], schema=kinds)
            rows.clear()

        for batch in batches:
            for account, ticker, day, side, shares, dollars in zip(*(batch.column(c).to_pylist() for c in ("account", "ticker", "date", "side", "shares", "dollars")), strict=True):
                if (account, ticker) != owner:
                    closed()
                    owner, order = (account, ticker), 0
                each = dollars / shares
                order += 1
                if side == "BUY":
                    heapq.heappush(heap, (-each, order, day, [shares]))
                    continue
                while shares > LEAST_SHARES and heap:
                    unit, _, bought, left = heap[0]
                    n = min(left[0], shares)
                    rows.append((*owner, "realized", bought, day, n, -unit * n, (each + unit) * n, "LT" if (day - bought).days >= YEAR_AND_DAY else "ST"))
                    shares -= n
                    left[0] -= n
                    if left[0] <= LEAST_SHARES:
                        heapq.heappop(heap)
                if shares > LEAST_SHARES:
                    rows.append((*owner, "oversold", None, day, shares, None, None, None))
            yield from sent()
        closed()
        yield from sent()

    ordered = fills.select("account", "ticker", "date", "side", F.col("shares").cast("double"), F.col("dollars").cast("double"), "seq")
    return ordered.repartition("account", "ticker").sortWithinPartitions("account", "ticker", "date", "seq").mapInArrow(run, LOT_SCHEMA)


def lots_report(lots: DataFrame, prices: DataFrame, asof: str) -> DataFrame:
    """Unrealized gain of open lots, when each goes long term, and whether it does so by the date and by that year's end."""
    day = F.lit(asof).cast("date")
    x = lots.where("kind = 'open'").join(prices, "ticker", "left")
    on = F.date_add("bought", YEAR_AND_DAY)
    gain = F.col("shares") * F.col("price") - F.col("basis")
    year_end = F.make_date(F.year(day), F.lit(12), F.lit(31))
    return x.select("account", "ticker", "bought", "shares", gain.alias("unrealized"), on.alias("long_term_on"), (on <= day).alias("is_long_term"), ((on <= year_end) & (gain > 0)).alias("gain_long_by_year_end"))


def realized_by_year(lots: DataFrame) -> DataFrame:
    """Shares, basis and gain of realized sales, by account, year of sale and term."""
    x = lots.where("kind = 'realized'").groupBy("account", F.year("sold").alias("year"), "term")
    return x.agg(F.sum("shares").alias("shares"), F.sum("basis").alias("basis"), F.sum("gain").alias("gain"))
