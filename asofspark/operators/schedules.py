"""Daily equity of weight schedules: fills at the next open, stops, interest, borrow fees, and no-trade bands.

Joins and windows turn a schedule into few rows a run and day.  A position that is set at one fill
moves with its price until the next fill at which its name has a price, so all positions of a fill are
one sum a day, in units of the equity at that fill.  What is left to follow day by day are the cash
and those units: a fold over rows ordered by run and day that keeps some numbers a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fees of trades from their dollar amounts (positive, one a name).
Cost = Callable[[np.ndarray], np.ndarray]


def proportional(bps: float) -> Cost:
    return lambda dollars: dollars * (bps / 1e4)


def two_tier(bps: float, upto: float, beyond_bps: float) -> Cost:
    """``bps`` of a trade's first ``upto`` dollars and ``beyond_bps`` of the rest."""
    return lambda dollars: np.minimum(dollars, upto) * (bps / 1e4) + np.maximum(dollars - upto, 0) * (beyond_bps / 1e4)


def fill_grid(weights: DataFrame, prices: DataFrame, fill: str = "next_open") -> DataFrame:
    """run_id, mark, k, f, symbol, w, p, q: every name of a run at every fill from its first one on.

    k numbers the run's marks, f is the row that a mark is filled at, w the target (0 if the name isn't in it), p the
    fill price (null if there is none or it isn't positive), q the price that the name is valued at then (p, or the last close).
    ``weights`` has (run_id, mark, symbol, w); a row without symbol marks a rebalance to cash.  ``prices`` is a panel
    (symbol, idx, open, close, px).
    """
    if fill not in ("next_open", "close"):
        raise ValueError(f"unknown fill {fill!r}")
    step = 1 if fill == "next_open" else 0
    last = prices.agg(F.max("idx").alias("_n"))
    marks = weights.select("run_id", "mark").distinct().withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("mark"))).withColumn("f", F.col("mark") + step)
    marks = marks.join(F.broadcast(last), F.col("f") <= F.col("_n")).drop("_n")
    wanted = weights.where("symbol is not null and w <> 0")
    names = wanted.join(marks, ["run_id", "mark"]).groupBy("run_id", "symbol").agg(F.min("k").alias("_first"))
    grid = names.join(marks, "run_id").where("k >= _first").drop("_first").join(wanted.select("run_id", "mark", "symbol", "w"), ["run_id", "mark", "symbol"], "left")
    at = F.col("open") if step else F.col("close")
    before = Window.partitionBy("symbol").orderBy("idx")
    known = prices.select("symbol", F.col("idx").alias("f"), F.when(at > 0, at).alias("p"), (F.lag("px").over(before) if step else F.col("px")).alias("_carried"))
    grid = grid.join(known, ["symbol", "f"], "left")
    return grid.select("run_id", "mark", "k", "f", "symbol", F.coalesce("w", F.lit(0.0)).alias("w"), "p", F.coalesce("p", "_carried").alias("q"))


def _positions(grid: DataFrame) -> DataFrame:
    """Adds what each name holds when it comes to a fill (``origin``: the fill that set it, ``h``: its value in units of the equity at
    that fill), and ``end``, the row of the next fill at which it has a price."""
    w = Window.partitionBy("run_id", "symbol").orderBy("k")
    set_here = F.when(F.col("p").isNotNull(), F.struct(F.col("w").alias("w"), F.col("k").alias("k"), F.col("p").alias("p")))
    was = F.last(set_here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = grid.withColumn("_was", was).withColumn("end", F.first(F.when(F.col("p").isNotNull(), F.col("f")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    held = F.col("_was.w") != 0
    return x.withColumns({"origin": F.when(held, F.col("_was.k")), "h": F.when(held, F.col("_was.w") * F.col("q") / F.col("_was.p"))}).drop("_was")


def _daily(legs: DataFrame, prices: DataFrame, stop: float | None) -> tuple[DataFrame, DataFrame | None]:
    """Values of all legs by day, each with its stop (``exit``, the row where it is sold, or null); and these stops by leg.

    A long leg stops at the first close that is ``stop`` below its fill price or lower.
    """
    spread = legs.withColumn("t", F.explode(F.sequence("f", "_until"))).join(prices.select("symbol", F.col("idx").alias("t"), "close", "px"), ["symbol", "t"])
    days = spread.withColumn("v", F.col("w") * F.col("px") / F.col("p"))
    if stop is None:
        return days.withColumn("exit", F.lit(None).cast("long")), None
    exits = days.where((F.col("w") > 0) & (F.col("close") <= F.col("p") * (1 - stop))).groupBy("run_id", "symbol", "k").agg(F.min("t").alias("exit"))
    return days.join(exits, ["run_id", "symbol", "k"], "left"), exits


_ROW = ["run_id", "t", "kind", "k", "j", "a", "b"]
_FILL, _STOP, _HELD, _END = range(4)


def daily_curve(
    weights: DataFrame, prices: DataFrame, cost: float | Cost = 0.0, fill: str = "next_open", cash_rate: float | DataFrame = 0.0, financing: float | DataFrame = 0.0,
    borrow_bps: float = 0.0, stop: float | None = None, initial: float = 10_000.0, year: int = 252,
) -> DataFrame:
    """run_id, idx, equity, traded, fees of every schedule (run_id, mark, symbol, w) on every row of the panel ``prices``.

    A mark's weights are filled at the next row's open (or at the mark's close) as fractions of the equity there.
    Each name's trade pays ``cost``: basis points, or a function of dollar amounts.  A name without a positive price at
    a fill keeps its shares and is valued at its last close; one that isn't in the weights is sold.  After the fill,
    long positions at or below ``stop`` under their fill price are sold at the close and stay out until the next fill;
    then shorts pay ``borrow_bps`` a year on their value, negative cash pays ``financing`` and positive cash earns
    ``cash_rate``.  Both are yearly rates: numbers, or tables (idx, rate) that are carried forward and 0 before they begin.
    """
    fees: Cost = cost if callable(cost) else proportional(cost)
    x = _positions(fill_grid(weights, prices, fill))
    last = prices.agg(F.max("idx").alias("_n"))
    legs = x.where("p is not null and w <> 0").join(F.broadcast(last)).withColumn("_until", F.coalesce(F.col("end") - 1, "_n"))
    days, exits = _daily(legs.where("_until >= f").select("run_id", "symbol", "k", "f", "p", "w", "_until"), prices, stop)
    if exits is not None:  # what was stopped before a fill isn't held there
        gone = exits.select("run_id", "symbol", F.col("k").alias("origin"), "exit")
        x = x.join(gone, ["run_id", "symbol", "origin"], "left").withColumn("origin", F.when(F.col("exit").isNull() | (F.col("exit") >= F.col("f")), F.col("origin")))
    none = F.lit(None).cast("double")
    row = lambda df, t, kind, k, j, a, b: df.select("run_id", F.col(t).cast("long").alias("t"), F.lit(kind).alias("kind"), k.cast("long").alias("k"), j.cast("long").alias("j"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    at_fill = x.where("origin is not null or (p is not null and w <> 0)")
    rows = row(at_fill, "f", _FILL, F.col("origin"), F.col("k"), F.when(F.col("origin").isNotNull(), F.col("h")).otherwise(0.0), F.when(F.col("p").isNotNull(), F.col("w")))
    alive = days.where("exit is null or t < exit").groupBy("run_id", "t", "k").agg(F.sum("v").alias("m"), F.sum(F.greatest(-F.col("v"), F.lit(0.0))).alias("s"))
    rows = rows.unionByName(row(alive, "t", _HELD, F.col("k"), F.lit(None), F.col("m"), F.col("s")))
    if stop is not None:
        rows = rows.unionByName(row(days.where("t = exit"), "t", _STOP, F.col("k"), F.lit(None), F.col("w") * F.col("close") / F.col("p"), none))
    calendar = _with_rates(prices.select("idx").distinct(), {"a": cash_rate, "b": financing})
    ends = weights.select("run_id").distinct().join(F.broadcast(last)).select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))).alias("idx")).join(calendar, "idx")
    rows = rows.unionByName(row(ends, "idx", _END, F.lit(None), F.lit(None), F.col("a"), F.col("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, cash, units, waiting, held, short, traded, paid = None, initial, {}, [], 0.0, 0.0, 0.0, 0.0
        for batch in batches:
            out: list[tuple] = []
            for run_id, t, kind, k, j, a, b in zip(*(batch.column(c).to_pylist() for c in _ROW), strict=True):
                if run_id != owner:
                    owner, cash, units, waiting, held, short, traded, paid = run_id, initial, {}, [], 0.0, 0.0, 0.0, 0.0
                if kind == _FILL:
                    waiting.append((j, units[k] * a if k is not None else 0.0, b))
                    continue
                if waiting:
                    equity = cash + sum(v for _, v, _ in waiting)
                    moves = np.array([w * equity - v for _, v, w in waiting if w is not None])
                    fee = float(fees(np.abs(moves)).sum()) if len(moves) else 0.0
                    units[waiting[0][0]] = equity
                    cash -= float(moves.sum()) + fee
                    traded, paid, waiting = traded + float(np.abs(moves).sum()), paid + fee, []
                if kind == _STOP:
                    sold = units[k] * a
                    fee = float(fees(np.array([abs(sold)])).sum())
                    cash, traded, paid = cash + sold - fee, traded + abs(sold), paid + fee
                elif kind == _HELD:
                    held, short = held + units[k] * a, short + units[k] * b
                else:
                    cash -= short * (borrow_bps / 1e4 / year)
                    cash *= 1 + (b if cash < 0 else a) / year
                    out.append((run_id, t, cash + held, traded, paid))
                    held, short, traded, paid = 0.0, 0.0, 0.0, 0.0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["run_id", "idx", "equity", "traded", "fees"])

    ordered = rows.withColumn("run_id", F.col("run_id").cast("string")).repartition("run_id").sortWithinPartitions("run_id", "t", "kind", "k")
    return ordered.mapInArrow(run, "run_id string, idx long, equity double, traded double, fees double")


def _with_rates(calendar: DataFrame, rates: dict[str, float | DataFrame]) -> DataFrame:
    """The calendar (idx; some thousand rows) with a column for each yearly rate."""
    for name, rate in rates.items():
        if isinstance(rate, DataFrame):
            column: Column = F.coalesce(F.last("_rate", ignorenulls=True).over(Window.orderBy("idx")), F.lit(0.0))
            calendar = calendar.join(rate.select("idx", F.col("rate").alias("_rate")), "idx", "left").withColumn(name, column).drop("_rate")
        else:
            calendar = calendar.withColumn(name, F.lit(float(rate)))
    return calendar


def banded_weights(weights: DataFrame, prices: DataFrame, bands: list[float], cap: float | None = 1.0, fill: str = "next_open") -> DataFrame:
    """run_id, band, mark, symbol, w: the weights that each schedule trades to with a no-trade band, for all ``bands`` at once.

    A name's current weight is its share of what is held, scaled to the target's gross; within band x |target| of the
    target it stays, else it goes to the nearest edge.  A name that isn't in the target goes altogether; an empty book buys
    the target.  Where the result's gross is above ``cap`` all of it is scaled down.  Weights of names without
    a price at the fill aren't given.  What such a name that is still held is worth beside the others is measured before fees and interest.
    """
    grid = fill_grid(weights, prices, fill).withColumn("run_id", F.col("run_id").cast("string"))
    marks = weights.select(F.col("run_id").cast("string").alias("run_id"), "mark").distinct()
    # A rebalance to cash trades all that is held; one at which a run has no name yet has no row and needs none.
    spread = grid.withColumn("band", F.explode(F.array(*[F.lit(float(b)) for b in bands])))

    def settled(held: dict[str, float], cash: float, rows: list[tuple], band: float) -> tuple[dict[str, float], float, list[tuple[str, float]]]:
        value = {s: held[s] * q for s, _, _, q in rows if s in held}
        equity = cash + sum(value.values())
        priced = {s: value[s] for s, _, p, _ in rows if p is not None and s in value}
        total, gross = sum(map(abs, priced.values())), sum(abs(w) for _, w, _, _ in rows)
        new = {s: w for s, w, _, _ in rows}
        if held and total > 0 and gross > 0:
            for s, w, _, _ in rows:
                new[s] = min(max(priced.get(s, 0.0) / total * gross, w - band * abs(w)), w + band * abs(w))
            size = sum(map(abs, new.values()))
            if cap is not None and size > cap:
                new = {s: w * (cap / size) for s, w in new.items()}
        given = []
        for s, _, p, _ in rows:
            if p is None:
                continue
            cash += value.get(s, 0.0) - new[s] * equity
            held.pop(s, None)
            if new[s] != 0:
                held[s] = new[s] * equity / p
                given.append((s, new[s]))
        return held, cash, given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cash, rows = None, {}, 1.0, []
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, cash, rows
            if key is not None:
                held, cash, given = settled(held, cash, rows, key[1])
                out.extend((*key, s, w) for s, w in given)
                rows = []

        def sent() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["run_id", "band", "mark", "symbol", "w"])
                out.clear()

        for batch in batches:
            for run_id, band, mark, symbol, w, p, q in zip(*(batch.column(c).to_pylist() for c in ("run_id", "band", "mark", "symbol", "w", "p", "q")), strict=True):
                if (run_id, band, mark) != key:
                    close()
                    if key is None or (run_id, band) != key[:2]:
                        held, cash = {}, 1.0
                    key = (run_id, band, mark)
                rows.append((symbol, w, p, q))
            yield from sent()
        close()
        yield from sent()

    ordered = spread.select("run_id", "band", F.col("mark").cast("long").alias("mark"), "symbol", "w", "p", "q").repartition("run_id", "band").sortWithinPartitions("run_id", "band", "mark", "symbol")
    traded = ordered.mapInArrow(run, "run_id string, band double, mark long, symbol string, w double")
    # Marks whose weights are all 0 stay as rebalances to cash.
    every = marks.withColumn("band", F.explode(F.array(*[F.lit(float(b)) for b in bands]))).select("run_id", "band", F.col("mark").cast("long").alias("mark"))
    cash_only = every.join(traded.select("run_id", "band", "mark").distinct(), ["run_id", "band", "mark"], "left_anti")
    return traded.unionByName(cash_only.select("run_id", "band", "mark", F.lit(None).cast("string").alias("symbol"), F.lit(0.0).alias("w")))


def traded_per_year(curve: DataFrame, rows_a_year: float, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``by``, turnover: traded dollars over mean equity, a year, of rows of daily_curve()."""
    years = (F.max("idx") - F.min("idx") + 1) / rows_a_year
    return curve.groupBy(*by).agg((F.sum("traded") / F.avg("equity") / years).alias("turnover"))
