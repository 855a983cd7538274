"""Observation panels, checks of locks and book postures: compositions of the other operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.functions import factors as fx
from asofspark.operators import ranking
from asofspark.operators import weights as wt


def dual_view_prices(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """symbol, dt, adjusted (for returns), raw (for capitalizations), where both have a price."""
    one = adjusted.select("symbol", "dt", F.col("px").alias("adjusted"))
    return one.join(raw.select("symbol", "dt", F.col("px").alias("raw")), ["symbol", "dt"])


def collect_obs(names: DataFrame, signals: DataFrame, low: float, high: float, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Names of the screen before its scrubs, with factors, F-Score, and the momentum and forward return of ``signals`` (ticker, as_of, mom, fwd)."""
    x = ranking.screen_funnel(names, low, high, excluded).where("drop_reason is null or drop_reason in ('altman_z', 'beneish_m')")
    x = ranking.with_factors(x).withColumn("fscore", fx.piotroski())
    return x.join(signals, ["ticker", "as_of"], "left")


def research_panel(names: DataFrame, signals: DataFrame) -> DataFrame:
    """ticker, as_of, eight raw factors and the forward return."""
    more = {"gross_profitability": fx.gross_profitability(), "asset_growth": fx.asset_growth(), "net_issuance": fx.net_issuance()}
    x = ranking.with_factors(names).withColumns(more).join(signals.select("ticker", "as_of", "fwd"), ["ticker", "as_of"], "left")
    return x.select("ticker", "as_of", *fx.ALL, *more, "fwd")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; without one, in the warehouse in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cache_obs(obs: DataFrame, path: str) -> DataFrame:
    """Writes observations once and reads them back, so that all schemes start from the same stored rows."""
    obs.write.mode("errorifexists").parquet(path)
    return obs.sparkSession.read.schema(obs.schema).parquet(path)


def snapshot_weights(locks: DataFrame, looks: tuple[str, ...], year: int = 252) -> DataFrame:
    """book, lock_date, symbol, w recomputed from each lock's own snapshot: share of rising looks over the volatility of the window."""
    x = locks.select(F.col("strategy").alias("book"), "lock_date", F.explode("signal_snapshot.closes").alias("symbol", "s"))
    px = F.col("s.window64")
    x = x.withColumn("_last", F.element_at(px, -1))
    rising = sum((F.when(F.col("_last") / F.element_at("s.looks", F.lit(k)) - 1 > 0, 1.0).otherwise(0.0) for k in looks), F.lit(0.0)) / len(looks)
    moves = F.transform(F.sequence(F.lit(1), F.size(px) - 1), lambda i: F.get(px, i) / F.get(px, i - 1) - 1)
    each = x.select("book", "lock_date", "symbol", rising.alias("strength"), F.explode(moves).alias("_r"))
    vol = each.groupBy("book", "lock_date", "symbol", "strength").agg((F.stddev_samp("_r") * year**0.5).alias("vol"))
    return wt.inverse_vol_weights(vol, ("book", "lock_date")).select("book", "lock_date", "symbol", "w")


def verify_lock(locks: DataFrame, looks: tuple[str, ...], most: float = 5e-6, year: int = 252) -> DataFrame:
    """book, lock_date, names, deviation, ok: the worst difference between a lock's weights and those of its snapshot.

    A lock without a snapshot is checked by its construction: weights that are positive and sum to 1 at most.
    """
    held = locks.select(F.col("strategy").alias("book"), "lock_date", F.col("signal_snapshot").isNotNull().alias("_snap"), F.explode("picks").alias("symbol", "w"))
    again = snapshot_weights(locks.where("signal_snapshot is not null"), looks, year).withColumnRenamed("w", "_w")
    x = held.join(again, ["book", "lock_date", "symbol"], "full_outer")
    off = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_w", F.lit(0.0)))
    out = x.groupBy("book", "lock_date").agg(F.count("w").alias("names"), F.max(off).alias("_off"), F.max("_snap").alias("_snap"), F.min("w").alias("_least"), F.sum("w").alias("_sum"))
    plain = (F.col("_least") > 0) & (F.col("_sum") <= 1 + 1e-9)
    return out.select("book", "lock_date", "names", F.when(F.col("_snap"), F.col("_off")).alias("deviation"), F.when(F.col("_snap"), F.col("_off") <= most).otherwise(plain).alias("ok"))


def regime_posture(weights: DataFrame, betas: DataFrame, defensive: list[str], by: tuple[str, ...] = ("run_id", "mark")) -> DataFrame:
    """Posture of each basket with its beta: the weighted mean of its names' rolling betas (mark, symbol, beta) at the date."""
    beta = weights.join(betas, ["mark", "symbol"]).groupBy(*by).agg(F.sum(F.col("w") * F.col("beta")).alias("beta"))
    return wt.posture(weights, defensive, by).join(beta, list(by), "left")


def tickers_priced(traded: DataFrame, prices: DataFrame) -> DataFrame:
    """check, status, message: whether every traded ticker has a price by some vendor; WARN up to one in ten without, FAIL beyond."""
    known = prices.where("price is not null").select("ticker").distinct().withColumn("_known", F.lit(True))
    x = traded.select("ticker").distinct().join(known, "ticker", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_known").isNull(), 1)).alias("missing"))
    status = F.when(F.col("missing") == 0, "PASS").when(F.col("missing") * 10 <= F.col("n"), "WARN").otherwise("FAIL")
    return x.select(F.lit("tickers").alias("check"), status.alias("status"), F.concat(F.col("missing"), F.lit(" of "), F.col("n"), F.lit(" without a price")).alias("message"))


def breadth_shares(ranks: DataFrame, shares: list[float], fwd: str = "fwd") -> DataFrame:
    """share, long, long_short: as breadth(), with a share of each date's names instead of a number."""
    score = ranks.where("pct is not null").groupBy("date", "name", fwd).agg(F.round(F.avg("pct"), 9).alias("score"))
    w = Window.partitionBy("date")
    x = score.withColumns({"_t": F.row_number().over(w.orderBy(F.desc("score"), "name")), "_b": F.row_number().over(w.orderBy("score", "name")), "_n": F.count(F.lit(1)).over(w)})
    x = x.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("share"))))
    top, low = F.avg(F.when(F.col("_t") <= F.col("_k"), F.col(fwd))), F.avg(F.when(F.col("_b") <= F.col("_k"), F.col(fwd)))
    return x.groupBy("share", "date").agg(top.alias("t"), (top - low).alias("s")).groupBy("share").agg(F.avg("t").alias("long"), F.avg("s").alias("long_short"))


def stitched_walk(grid: DataFrame, winners: DataFrame, test: int, best: DataFrame, untuned: str) -> DataFrame:
    """symbol, scheme, growth: log growth over all test rows of the winners in turn, of the run that is best over everything, of an untuned run, and of holding.

    ``grid`` has (symbol, run_id, idx, x, hold); ``winners`` (symbol, fold, run_id) and ``best`` (symbol, run_id) one run each.
    """
    fold = winners.groupBy("symbol").agg(F.min("fold").alias("_from"))
    rows = grid.join(fold, "symbol").where(F.col("idx") >= F.col("_from"))
    start = F.col("_from") + F.floor((F.col("idx") - F.col("_from")) / test) * test
    picked = rows.withColumn("fold", start).join(winners.select("symbol", F.col("fold").cast("long").alias("fold"), "run_id"), ["symbol", "fold", "run_id"])
    total = lambda df, name, c: df.groupBy("symbol").agg(F.sum(c).alias("growth")).select("symbol", F.lit(name).alias("scheme"), "growth")
    plain = rows.where(F.col("run_id") == untuned)
    out = total(picked, "walk forward", "x").unionByName(total(rows.join(best.select("symbol", "run_id"), ["symbol", "run_id"]), "best of all", "x"))
    return out.unionByName(total(plain, "untuned", "x")).unionByName(total(plain, "hold", "hold"))
