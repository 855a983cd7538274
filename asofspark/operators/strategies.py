"""Strategies as functions, a registry of them, a look-ahead check, and operators as SQL views.

A strategy makes weights from a panel and a table of parameters: (panel, params) -> rows of run_id, mark, symbol, w,
where params has a run_id and what the strategy reads, so that any number of variants are one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.operators import filings, metrics, ranking, research, scoring
from asofspark.operators import schedules as sd
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt

Strategy = Callable[[DataFrame, DataFrame], DataFrame]
PICKERS: dict[str, Strategy] = {}


def picker(name: str) -> Callable[[Strategy], Strategy]:
    """Registers a strategy; a name is taken once."""

    def add(strategy: Strategy) -> Strategy:
        if name in PICKERS:
            raise ValueError(f"{name!r} is registered")
        PICKERS[name] = strategy
        return strategy

    return add


def pick(name: str, panel: DataFrame, params: DataFrame) -> DataFrame:
    if name not in PICKERS:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(sorted(PICKERS))}")
    return PICKERS[name](panel, params)


def _at_cycle(panel: DataFrame, params: DataFrame, warmup: int) -> DataFrame:
    """Panel rows at each run's cycle rows (``every``, ``offset``), with the run's parameters."""
    return panel.join(F.broadcast(params), (F.col("idx") % F.col("every") == F.col("offset")) & (F.col("idx") >= warmup)).withColumn("mark", F.col("idx").cast("long"))


@picker("trend")
def trend(panel: DataFrame, params: DataFrame, looks: tuple[int, ...] = (13, 26, 52), vol: int = 26) -> DataFrame:
    """Share of rising lookbacks over volatility, scaled to a gross of ``gross``; params: every, offset, gross."""
    x = ts.trend_strength(panel, looks).withColumn("vol", ts.rolling_vol(vol, 52))
    w = wt.inverse_vol_weights(_at_cycle(x, params, 2 * max(looks)).select("run_id", "mark", "symbol", "strength", "vol", "gross"))
    return w.select("run_id", "mark", "symbol", (F.col("w") * F.col("gross")).alias("w"))


@picker("top_momentum")
def top_momentum(panel: DataFrame, params: DataFrame, skip: int = 4, look: int = 52) -> DataFrame:
    """The ``n`` best of the momentum that ends ``skip`` rows ago, at equal weight; params: every, offset, n."""
    x = panel.withColumn("mom", ts.momentum(skip, look)).where("mom is not null and close is not null")
    place = F.row_number().over(Window.partitionBy("run_id", "mark").orderBy(F.desc("mom"), "symbol"))
    best = _at_cycle(x, params, skip + look).withColumn("_p", place).where("_p <= n")
    return best.select("run_id", "mark", "symbol", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("run_id", "mark"))).alias("w"))


@picker("equal_weight")
def equal_weight(panel: DataFrame, params: DataFrame) -> DataFrame:
    """Every name with a price on the row; params: every, offset."""
    x = _at_cycle(panel.where("close is not null"), params, 0)
    return x.select("run_id", "mark", "symbol", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("run_id", "mark"))).alias("w"))


def backtest(strategy: str | Strategy, panel: DataFrame, params: DataFrame, **curve) -> DataFrame:
    """daily_curve() of a strategy's weights; ``curve`` are its further arguments."""
    weights = pick(strategy, panel, params) if isinstance(strategy, str) else strategy(panel, params)
    return sd.daily_curve(weights, panel, **curve)


def looks_ahead(strategy: str | Strategy, panel: DataFrame, params: DataFrame, row: int) -> DataFrame:
    """run_id, mark, symbol, before, after: weights of marks up to ``row`` that change if all later prices do.  Empty for an honest strategy."""
    run = (lambda p: pick(strategy, p, params)) if isinstance(strategy, str) else (lambda p: strategy(p, params))
    known = panel.columns
    later = lambda c: F.when(F.col("idx") > row, F.col(c) * (2 + F.col("idx") % 3 + F.pmod(F.xxhash64("symbol"), F.lit(5)))).otherwise(F.col(c))
    other = panel.withColumns({c: later(c) for c in ("open", "high", "low", "close", "px") if c in known})
    if "ret" in known:
        other = other.withColumn("ret", F.col("px") / F.lag("px").over(ts.by_symbol()) - 1)
    one, two = (run(p).where(F.col("mark") <= row).select("run_id", "mark", "symbol", F.col("w").alias(n)) for p, n in ((panel, "before"), (other, "after")))
    both = one.join(two, ["run_id", "mark", "symbol"], "full_outer")
    same = F.abs(F.col("before") - F.col("after")) <= 1e-12
    return both.where(~F.coalesce(same, F.lit(False)))


#: Operators that create_view() knows by name.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "long_screen": ranking.long_screen, "short_screen": ranking.short_screen, "screen_funnel": ranking.screen_funnel, "annual_facts": filings.annual_facts,
    "pick": pick, "backtest": backtest, "daily_curve": sd.daily_curve, "banded_weights": sd.banded_weights, "summary": metrics.summary, "score_locks": scoring.score_locks,
    "rank_signals": research.rank_signals, "ic_table": research.ic_table,
}


def create_view(spark: SparkSession, view: str, operator: str | Callable[..., DataFrame], tables: list[str], *first, **arguments) -> None:
    """CREATE TEMP VIEW of an operator over named tables or views, for use in SQL.

    ``first`` come before the tables and ``arguments`` after them; an argument that names a table is given as
    ``spark.table(name)``.  Nothing is computed before the view is read.
    """
    if isinstance(operator, str) and operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(sorted(OPERATORS))}")
    run = OPERATORS[operator] if isinstance(operator, str) else operator
    run(*first, *[spark.table(t) for t in tables], **arguments).createOrReplaceTempView(view)


def leverage_ladder(returns: DataFrame, levels: list[float], spread: float = 0.004, year: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, leverage, dt, equity: a stream of returns (``by``, dt, ret, rf) at several leverages, financed at the dated rate plus ``spread``."""
    x = returns.withColumn("leverage", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    r = F.col("leverage") * F.col("ret") - (F.col("leverage") - 1) * (F.coalesce("rf", F.lit(0.0)) + spread) / year
    return x.select(*by, "leverage", "dt", (10_000.0 * F.product(1 + r).over(Window.partitionBy(*by, "leverage").orderBy("dt"))).alias("equity"))


def stitched_signals(grid: DataFrame, winners: DataFrame, best: DataFrame, test: int, untuned: str) -> DataFrame:
    """symbol, scheme, idx, signal over all test rows: of the winners in turn, of the run that is best over everything, of an untuned one, and 1 for holding.

    ``grid`` has (symbol, run_id, idx, signal); ``winners`` (symbol, fold, run_id) and ``best`` (symbol, run_id) one run each.
    """
    begin = winners.groupBy("symbol").agg(F.min("fold").cast("long").alias("_from"))
    rows = grid.join(begin, "symbol").where(F.col("idx") >= F.col("_from"))
    rows = rows.withColumn("fold", (F.col("_from") + F.floor((F.col("idx") - F.col("_from")) / test) * test).cast("long")).drop("_from")
    named = lambda df, name: df.select("symbol", F.lit(name).alias("scheme"), "idx", "signal")
    picked = rows.join(winners.select("symbol", F.col("fold").cast("long").alias("fold"), "run_id"), ["symbol", "fold", "run_id"])
    plain = rows.where(F.col("run_id") == untuned)
    out = named(picked, "walk forward").unionByName(named(rows.join(best.select("symbol", "run_id"), ["symbol", "run_id"]), "best of all"))
    return out.unionByName(named(plain, "untuned")).unionByName(named(plain.withColumn("signal", F.lit(1.0)), "hold"))


def last_rows(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """label, mark of each date (label, date): the last calendar row at or before it."""
    return calendar.join(F.broadcast(dates), F.col("dt") <= F.col("date")).groupBy("label").agg(F.max("idx").cast("long").alias("mark"))


def stacked_beta(multiple: float, beta: Column | str = "beta") -> Column:
    """Beta of a book with 1 / multiple in a fund of that multiple and the rest in a sleeve."""
    return F.lit(1.0) + (1 - 1 / multiple) * F.coalesce(F.col(beta) if isinstance(beta, str) else beta, F.lit(0.0))
