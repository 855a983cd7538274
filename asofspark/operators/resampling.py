"""Moving-block resamples by block summaries.

A resample of n rows joins its blocks, not its rows: a block's sums, or its growth, peak, trough and
deepest fall, are known for every start beforehand.  Summaries of 2^k rows come from two of half
the length by looking ahead; any length is a few of them.  Starts come from an integer hash,
so that every engine draws the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Summary = dict[str, Column]


def _powers(block: int) -> list[int]:
    return [1 << b for b in range(block.bit_length())]


def block_summaries(rows: DataFrame, by: tuple[str, ...], block: int, one: Summary, joined: Callable[[Summary, Summary], Summary]) -> DataFrame:
    """``by``, len, idx and a summary's columns, for runs of ``block`` rows and of every power of two up to it that begin at idx.

    ``rows`` has ``by`` and idx (0, 1, ... without gaps); ``one`` is a row's summary, ``joined`` that of two runs, the second after the first.
    """
    w = Window.partitionBy(*by).orderBy("idx")
    names, sizes = list(one), _powers(block)
    at = lambda size: {c: F.col(f"_{c}_{size}") for c in names}
    later = lambda parts, ahead: {c: F.lead(v, ahead).over(w) for c, v in parts.items()}
    x = rows.select(*by, "idx", *[v.alias(f"_{c}_1") for c, v in one.items()])
    for half in sizes[:-1]:
        x = x.withColumns({f"_{c}_{2 * half}": v for c, v in joined(at(half), later(at(half), half)).items()})
    whole, done = at(sizes[-1]), sizes[-1]
    for size in sizes[-2::-1]:
        if block & size:
            whole, done = joined(whole, later(at(size), done)), done + size
    if block not in sizes:
        x = x.withColumns({f"_{c}_{block}": v for c, v in whole.items()})
    every = sorted({*sizes, block})
    each = F.explode(F.array(*[F.struct(F.lit(size).cast("long").alias("len"), *[v.alias(c) for c, v in at(size).items()]) for size in every]))
    return x.select(*by, "idx", each.alias("_s")).select(*by, "idx", "_s.*").where(F.col(names[0]).isNotNull())


def resample_pieces(sizes: DataFrame, by: tuple[str, ...], block: int, n_boot: int, seed: int) -> DataFrame:
    """``by``, boot, pos, idx, len: the runs of rows that a resample puts one after the other; the last block is cut to n rows in all.

    ``sizes`` has ``by`` and n, the rows of each stream (at least one block).
    """
    x = sizes.select(*by, "n", F.ceil(F.col("n") / block).cast("long").alias("_blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("boot"))
    x = x.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    start = F.pmod(F.col("boot") * F.lit(2654435761) + F.col("_blk") * F.lit(40503) + F.lit(seed * 97), F.lit(2147483647)) % (F.col("n") - block + 1)
    rest = F.col("n") - F.col("_blk") * block
    bit = lambda size: F.when(rest.bitwiseAND(F.lit(size)) != 0, F.struct((F.shiftright(rest, size.bit_length()) * (2 * size)).alias("off"), F.lit(size).cast("long").alias("len")))
    last = F.array_compact(F.array(*[bit(size) for size in reversed(_powers(block))]))
    full = F.array(F.struct(F.lit(0).cast("long").alias("off"), F.lit(block).cast("long").alias("len")))
    x = x.withColumn("_start", start).withColumn("_p", F.explode(F.when(F.col("_blk") < F.col("_blocks") - 1, full).otherwise(last)))
    return x.select(*by, "boot", (F.col("_blk") * block + F.col("_p.off")).alias("pos"), (F.col("_start") + F.col("_p.off")).alias("idx"), "_p.len")


def numbered(rows: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Adds idx: 0, 1, ... in each stream's order."""
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def stream_sizes(rows: DataFrame, by: tuple[str, ...], least: int) -> DataFrame:
    """``by`` and n; a stream of fewer than ``least`` rows raises an error when it is computed."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.when(n < least, F.raise_error(F.lit(f"fewer than {least} rows")).cast("long")).otherwise(n).alias("n"))


def sharpe_difference(pairs: DataFrame, block: int, n_boot: int = 2000, seed: int = 0, year: int = 252, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """``by``, observed, low, high, p: difference of annual Sharpes of aligned streams (``by``, idx, ra, rb), its 95 % interval and the share of resamples at or below 0.

    All pairs go through at once.  A resample is the sum of its blocks' sums and squares.
    """
    one = {"n": F.lit(1).cast("long"), "a": F.col("ra"), "a2": F.col("ra") * F.col("ra"), "b": F.col("rb"), "b2": F.col("rb") * F.col("rb")}
    known = block_summaries(pairs, by, block, one, lambda x, y: {c: x[c] + y[c] for c in x})
    met = resample_pieces(stream_sizes(pairs, by, 5 * block), by, block, n_boot, seed).join(known, [*by, "len", "idx"])
    n = F.sum("n")
    sharpe = lambda c: (F.sum(c) / n) / F.sqrt((F.sum(f"{c}2") - F.sum(c) * F.sum(c) / n) / (n - 1)) * year**0.5
    boots = met.groupBy(*by, "boot").agg((sharpe("a") - sharpe("b")).alias("d"))
    plain = lambda c: F.avg(c) / F.stddev_samp(c) * year**0.5
    observed = pairs.groupBy(*by).agg((plain("ra") - plain("rb")).alias("observed"))
    stats = boots.groupBy(*by).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") <= 0).cast("double")).alias("p"))
    return observed.join(stats, list(by))


def resampled_means(panel: DataFrame, rows: int, block: int, n_boot: int, seed: int = 0) -> DataFrame:
    """boot, symbol, n, mean: cross-sections of a panel (symbol, idx, ret) drawn jointly, so that a resample takes the same rows of all symbols.

    ``rows`` is the number of the panel's rows (idx 0 to rows - 1); a symbol without a return in a row misses it there, too.
    """
    grid = panel.select("symbol", "idx", F.coalesce("ret", F.lit(0.0)).alias("r"), F.col("ret").isNotNull().cast("long").alias("k"))
    first = grid.groupBy("symbol").agg(F.min("idx").alias("_f"))
    lead = first.where("_f > 0").select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_f") - 1)).alias("idx"), F.lit(0.0).alias("r"), F.lit(0).cast("long").alias("k"))
    known = block_summaries(grid.unionByName(lead), ("symbol",), block, {"k": F.col("k"), "r": F.col("r")}, lambda x, y: {c: x[c] + y[c] for c in x})
    size = panel.sparkSession.range(1).select(F.lit(rows).cast("long").alias("n"))
    met = resample_pieces(size, (), block, n_boot, seed).join(known, ["len", "idx"])
    return met.groupBy("boot", "symbol").agg(F.sum("k").alias("n"), F.try_divide(F.sum("r"), F.sum("k")).alias("mean"))


def deepest_falls(rows: DataFrame, block: int, n_boot: int = 500, seed: int = 0, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``by``, boot, drawdown: the deepest fall of every resampled path of returns (``by``, idx, r); a return below -1 counts as -1.

    A run of rows is known by its growth, its highest and lowest value on the way (from 1 before it), and its deepest
    fall.  After another run, its lowest value also falls from that one's highest.
    """
    g = 1 + F.greatest("r", F.lit(-1.0))
    one = {"g": g, "peak": F.greatest(g, F.lit(1.0)), "low": g, "fall": F.least(g, F.lit(1.0))}

    def joined(x: Summary, y: Summary) -> Summary:
        there = y["g"].isNotNull()
        some = {"g": x["g"] * y["g"], "peak": F.greatest(x["peak"], x["g"] * y["peak"]), "low": F.least(x["low"], x["g"] * y["low"]), "fall": F.least(x["fall"], y["fall"], x["g"] * y["low"] / x["peak"])}
        return {c: F.when(there, v) for c, v in some.items()}

    known = block_summaries(rows, by, block, one, joined)
    met = resample_pieces(stream_sizes(rows, by, block), by, block, n_boot, seed).join(known, [*by, "len", "idx"])
    w = Window.partitionBy(*by, "boot").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_g", F.coalesce(F.product("g").over(w), F.lit(1.0)))
    met = met.withColumn("_peak", F.coalesce(F.max(F.col("_g") * F.col("peak")).over(w), F.lit(1.0)))
    return met.groupBy(*by, "boot").agg((F.min(F.least(F.col("fall"), F.col("_g") * F.col("low") / F.col("_peak"))) - 1).alias("drawdown"))


def drawdown_quantiles(rows: DataFrame, block: int, n_boot: int = 500, seed: int = 0, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``by``, scheme, p50, p5 of the deepest falls at the mean leverage and at each row's own, of rows (``by``, idx, ret, leverage)."""
    mean = F.avg("leverage").over(Window.partitionBy(*by))
    schemes = {"constant": F.col("_mean") * F.col("ret"), "dynamic": F.col("leverage") * F.col("ret")}
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), r.alias("r")) for s, r in schemes.items()]))
    runs = rows.withColumn("_mean", mean).select(*by, "idx", each.alias("_e")).select(*by, "idx", "_e.*")
    worst = deepest_falls(runs, block, n_boot, seed, (*by, "scheme"))
    return worst.groupBy(*by, "scheme").agg(F.percentile("drawdown", F.lit(0.5)).alias("p50"), F.percentile("drawdown", F.lit(0.05)).alias("p5"))


def overfit_curve(results: DataFrame, sizes: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, k, best_in, then_out: expectation, over all subsets of k of a group's runs, of the best in-sample metric and of that run's out-of-sample one.

    In the order of the metric, the run at place i is the best of a subset if it is drawn and none before it is: with
    probability C(N - i, k - 1) / C(N, k), which falls from k / N by a factor a place.  Equal metrics go by run_id, runs
    without one count as absent; a k above the number of runs has no row.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("in_sample"), "run_id")
    ranked = results.where("in_sample is not null").withColumns({"_i": F.row_number().over(order).cast("long"), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    x = ranked.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in sizes]))).where("k <= _n")
    step = F.greatest(F.col("_n") - F.col("_i") - F.col("k") + 1, F.lit(0)) / F.greatest(F.col("_n") - F.col("_i"), F.lit(1))
    before = Window.partitionBy(*by, "k").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_s", step).withColumn("_p", F.col("k") / F.col("_n") * F.coalesce(F.product("_s").over(before), F.lit(1.0)))
    return x.groupBy(*by, "k").agg(F.sum(F.col("_p") * F.col("in_sample")).alias("best_in"), F.sum(F.col("_p") * F.col("out_sample")).alias("then_out"))
