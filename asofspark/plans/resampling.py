"""Queries on resamples of all pairs and symbols, and on selection among many runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.operators import panel as pn
from asofspark.operators import resampling as rp
from asofspark.operators import timeseries as ts
from asofspark.plans.common import rounded
from asofspark.plans.research import GRID, PAIR, grid_results, pairs
from asofspark.plans.timeseries import PANEL
from asofspark.plans.timeseries import SQL as TS_SQL
from asofspark.sources import driver_tables as dt

RESAMPLES, PATHS = 2000, 500


def q_difference(spark, d):
    """Every candidate pair's difference of Sharpes over 2,000 resamples of 13 weeks."""
    x = pn.panel(dt.bars(spark, d)).where("ret is not null").select("symbol", "idx", "ret")
    one = lambda s, r: x.select(F.col("symbol").alias(s), "idx", F.col("ret").alias(r))
    rows = pairs(spark, d).select("a", "b", F.concat_ws("|", "a", "b").alias("pair")).join(one("a", "ra"), "a").join(one("b", "rb"), ["b", "idx"]).select("pair", F.col("idx").alias("_row"), "ra", "rb")
    return rounded(rp.sharpe_difference(rp.numbered(rows, ("pair",), "_row"), 13, RESAMPLES, 7), 5)


def q_rows(spark, d):
    """Mean return of every symbol on 500 jointly resampled histories."""
    p = pn.panel(dt.bars(spark, d))
    rows = pn.calendar(dt.bars(spark, d)).count()
    return rounded(rp.resampled_means(p.select("symbol", F.col("idx").cast("long").alias("idx"), "ret"), rows, 26, PATHS, 3))


def q_drawdowns(spark, d):
    """Tail drawdowns of every symbol at constant and dynamic leverage over 500 resampled paths."""
    x = ts.dynamic_leverage(pn.panel(dt.bars(spark, d)), 13, 52, 4).where("ret is not null and leverage is not null")
    x = x.select("symbol", F.col("idx").alias("_row"), F.round("ret", 9).alias("ret"), F.round("leverage", 6).alias("leverage"))
    return rounded(rp.drawdown_quantiles(rp.numbered(x, ("symbol",), "_row"), 13, PATHS, 5), 5)


def q_overfit(spark, d):
    return rounded(rp.overfit_curve(grid_results(spark, d), [1, 5, 20, 50]), 4)


def q_overfit_symbol(spark, d):
    runs = grid_results(spark, d).withColumn("symbol", F.split_part("run_id", F.lit("|"), F.lit(1)))
    return rounded(rp.overfit_curve(runs, [1, 2, 3, 4], ("symbol",)), 4)


QUERIES = {
    "X17_bootstrap_diff": q_difference, "X18_bootstrap_rows": q_rows, "X19_bootstrap_drawdowns": q_drawdowns, "X23_overfit_curve": q_overfit, "X23_overfit_by_symbol": q_overfit_symbol,
}


def rows_sql(sizes: str, by: str, block: int, n_boot: int, seed: int) -> str:
    """Rows drawn one by one (``by``, boot, pos, idx) for streams of ``sizes`` (``by``, n)."""
    key = f"{by}, " if by else ""
    return f"""SELECT {key}boot, blk * {block} + j.j AS pos, (boot * 2654435761 + blk * 40503 + {seed} * 97) % 2147483647 % (n - {block} + 1) + j.j AS idx
FROM (SELECT {key}n, b.boot, unnest(range(CAST(ceil(n / {block}.0) AS BIGINT))) AS blk FROM {sizes}, (SELECT range AS boot FROM range({n_boot})) b), (SELECT range AS j FROM range({block})) j WHERE blk * {block} + j.j < n"""


_SHARPE = "(avg(ra) / stddev_samp(ra) - avg(rb) / stddev_samp(rb)) * sqrt(252)"


def _overfit_sql(by: str, sizes: str) -> str:
    """The same expectation by binomial coefficients, as products of quotients."""
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""rr AS (SELECT {key}in_sample, out_sample, row_number() OVER ({part}ORDER BY in_sample DESC, run_id) AS i, count(*) OVER ({part}) AS n FROM rs WHERE in_sample IS NOT NULL),
pp AS (SELECT {key}k, in_sample, out_sample, CASE WHEN n - i < k - 1 THEN 0 ELSE CAST(k AS DOUBLE) / n * coalesce(list_product(list_transform(range(1, i), lambda j: (n - k + 1.0 - j) / (n - j))), 1) END AS p FROM rr, (SELECT unnest({sizes}) AS k) WHERE k <= n)
SELECT {key}CAST(k AS BIGINT) AS k, round(sum(p * in_sample), 4) + 0.0 AS best_in, round(sum(p * out_sample), 4) + 0.0 AS then_out FROM pp GROUP BY {key}k"""


SQL = {
    "X17_bootstrap_diff": f"""{PAIR}, ix AS (SELECT a || '|' || b AS pair, row_number() OVER (PARTITION BY a, b ORDER BY x.idx) - 1 AS idx, x.ret AS ra, y.ret AS rb FROM prs JOIN rets x ON x.symbol = a JOIN rets y ON y.symbol = b AND y.idx = x.idx WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL),
nn AS (SELECT pair, count(*) AS n FROM ix GROUP BY 1), rw AS ({rows_sql('nn', 'pair', 13, RESAMPLES, 7)}), bs AS (SELECT pair, boot, {_SHARPE} AS d FROM rw JOIN ix USING (pair, idx) GROUP BY 1, 2),
ob AS (SELECT pair, {_SHARPE} AS o FROM ix GROUP BY 1) SELECT pair, round(any_value(o), 5) + 0.0 AS observed, round(quantile_cont(d, 0.025), 5) + 0.0 AS low, round(quantile_cont(d, 0.975), 5) + 0.0 AS high, round(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS p FROM bs JOIN ob USING (pair) GROUP BY 1""",
    "X18_bootstrap_rows": f"""{PANEL}, nn AS (SELECT count(*) AS n FROM cal), rw AS ({rows_sql('nn', '', 26, PATHS, 3)}), sy AS (SELECT DISTINCT symbol FROM panel)
SELECT boot, sy.symbol, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean FROM rw CROSS JOIN sy LEFT JOIN rets r ON r.symbol = sy.symbol AND r.idx = rw.idx GROUP BY 1, 2""",
    "X19_bootstrap_drawdowns": f"""WITH lv AS ({TS_SQL["T19_dynamic_leverage"]}), rt AS ({PANEL} SELECT symbol, dt, idx, round(ret, 9) AS ret FROM rets),
ix AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS idx, ret, leverage, avg(leverage) OVER (PARTITION BY symbol) AS m FROM rt JOIN lv USING (symbol, dt) WHERE ret IS NOT NULL AND leverage IS NOT NULL), nn AS (SELECT symbol, count(*) AS n FROM ix GROUP BY 1),
rw AS ({rows_sql('nn', 'symbol', 13, PATHS, 5)}), e AS (SELECT symbol, boot, pos, 'constant' AS scheme, m * ret AS r FROM rw JOIN ix USING (symbol, idx) UNION ALL SELECT symbol, boot, pos, 'dynamic', leverage * ret FROM rw JOIN ix USING (symbol, idx)),
v AS (SELECT symbol, scheme, boot, pos, product(1 + greatest(r, -1.0)) OVER (PARTITION BY symbol, scheme, boot ORDER BY pos) AS v FROM e), w AS (SELECT symbol, scheme, boot, v / greatest(max(v) OVER (PARTITION BY symbol, scheme, boot ORDER BY pos), 1.0) - 1 AS dd FROM v), dn AS (SELECT symbol, scheme, boot, min(dd) AS d FROM w GROUP BY 1, 2, 3)
SELECT symbol, scheme, round(quantile_cont(d, 0.5), 5) + 0.0 AS p50, round(quantile_cont(d, 0.05), 5) + 0.0 AS p5 FROM dn GROUP BY 1, 2""",
    "X23_overfit_curve": f"{GRID}, rs AS (SELECT * FROM res), {_overfit_sql('', '[1, 5, 20, 50]')}",
    "X23_overfit_by_symbol": f"{GRID}, rs AS (SELECT *, split_part(run_id, '|', 1) AS symbol FROM res), {_overfit_sql('symbol', '[1, 2, 3, 4]')}",
}
