"""Queries on daily schedule curves, stops and no-trade bands: 26 offsets of the trend sleeve over the whole panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.operators import metrics as me
from asofspark.operators import panel as pn
from asofspark.operators import schedules as sd
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt
from asofspark.operators.observations import cache_obs, scratch
from asofspark.plans.common import rounded, significant_sql
from asofspark.plans.portfolio import TREND
from asofspark.sources import driver_tables as dt

BANDS = [0.0, 0.05, 0.1, 0.2]
YEAR = 52


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel, stored: a curve reads it for fills, values and its calendar."""
    return cache_obs(pn.panel(dt.bars(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long")), scratch(spark, "panel"))


def offsets(panel_rows: DataFrame) -> DataFrame:
    """run_id, mark, symbol, w: inverse-volatility weights of the trend signal at each of 26 offsets, stored."""
    x = ts.trend_strength(panel_rows, (13, 26, 52)).withColumn("vol", ts.rolling_vol(26, 52))
    runs = panel_rows.sparkSession.range(26).select(F.concat(F.lit("o"), F.col("id")).alias("run_id"), F.col("id").alias("offset"))
    s = x.join(F.broadcast(runs), (F.col("idx") % 26 == F.col("offset")) & (F.col("idx") >= 104)).select("run_id", F.col("idx").alias("mark"), "symbol", "strength", "vol")
    return cache_obs(wt.inverse_vol_weights(s).select("run_id", "mark", "symbol", "w"), scratch(panel_rows.sparkSession, "weights"))


def _short(w: DataFrame) -> DataFrame:
    return w.withColumn("w", F.when(F.col("symbol").startswith("Brand#1"), -F.col("w")).otherwise(F.col("w")))


def _rates(spark: SparkSession, sf_dir: str, spread: float) -> DataFrame:
    return pn.calendar(dt.bars(spark, sf_dir)).join(dt.rates(spark, sf_dir), "dt").select(F.col("idx").cast("long").alias("idx"), (F.col("rf") + spread).alias("rate"))


def _shown(curve: DataFrame) -> DataFrame:
    return rounded(curve.select("run_id", "idx", "equity", "traded"), 4, ("equity", "traded"))


def q_daily(spark, d):
    p = panel(spark, d)
    w = offsets(p).withColumn("w", 1.2 * F.col("w"))
    return _shown(sd.daily_curve(w, p, 10.0, cash_rate=_rates(spark, d, 0.0), financing=_rates(spark, d, 0.01), year=YEAR))


def q_close(spark, d):
    p = panel(spark, d)
    return _shown(sd.daily_curve(_short(offsets(p)), p, sd.two_tier(8.0, 900.0, 25.0), "close", 0.02, 0.03, 50.0, year=YEAR))


def q_stopped(spark, d):
    p = panel(spark, d)
    return _shown(sd.daily_curve(offsets(p), p, 10.0, cash_rate=0.02, stop=0.08, year=YEAR))


def banded(spark, d):
    p = panel(spark, d)
    return p, cache_obs(sd.banded_weights(offsets(p), p, BANDS), scratch(spark, "banded"))


def q_banded(spark, d):
    _, w = banded(spark, d)
    return rounded(w.where("symbol is not null").select("run_id", "band", "mark", "symbol", "w"))


def q_turnover(spark, d):
    p, w = banded(spark, d)
    runs = w.withColumn("run_id", F.concat_ws("|", "run_id", "band"))
    years = sd.traded_per_year(sd.daily_curve(runs, p, 10.0, year=YEAR), YEAR).withColumn("band", F.split_part("run_id", F.lit("|"), F.lit(2)).cast("double"))
    return rounded(me.distribution(years, "band", "turnover"))


QUERIES = {
    "P8_daily_curve": q_daily, "P8_close_curve": q_close, "P9_stopped_curve": q_stopped, "W16_banded_path": q_banded, "P22_turnover_by_band": q_turnover,
}

_BASE = TREND.replace("WITH", "WITH RECURSIVE", 1).replace("runs(run_id, o) AS (VALUES ('o0', 0), ('o7', 7))", "runs AS (SELECT 'o' || range AS run_id, range AS o FROM range(26))")


def grid_sql(source: str, step: int = 1) -> str:
    """gd (run_id, mark, k, f, symbol, w, p, q): every name of a run at every fill; nm and mk: its names and marks."""
    at, carried = ("open", "lag(px) OVER (PARTITION BY symbol ORDER BY idx)") if step else ("close", "px")
    return f"""mk AS (SELECT * FROM (SELECT run_id, mark, row_number() OVER (PARTITION BY run_id ORDER BY mark) AS k, mark + {step} AS f FROM (SELECT DISTINCT run_id, mark FROM {source})) WHERE f <= (SELECT max(idx) FROM cal)),
nm AS (SELECT DISTINCT run_id, symbol FROM {source} JOIN mk USING (run_id, mark) WHERE symbol IS NOT NULL AND w <> 0),
pr AS (SELECT symbol, idx AS f, CASE WHEN {at} > 0 THEN {at} END AS p, {carried} AS c FROM panel),
gd AS (SELECT m.run_id, m.mark, m.k, m.f, n.symbol, coalesce(s.w, 0) AS w, p, coalesce(p, c) AS q FROM nm n JOIN mk m USING (run_id) LEFT JOIN {source} s ON s.run_id = m.run_id AND s.mark = m.mark AND s.symbol = n.symbol LEFT JOIN pr ON pr.symbol = n.symbol AND pr.f = m.f)"""


def curve_sql(source: str, bps: str, rates: str, step: int = 1, borrow: float = 0.0, stop: float | None = None) -> str:
    """cu (run_id, t, equity, traded): a recursion over the panel's rows; ``bps`` is the fee of a list element x, ``rates`` a table rt (t, rf, fin)."""
    hit = f"w > 0 AND close <= p * (1 - {stop})" if stop is not None else "false"
    return f"""{grid_sql(source, step)}, rt AS ({rates}),
ps AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN struct_pack(w := w, k := k, p := p) END IGNORE NULLS) OVER (PARTITION BY run_id, symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
  first_value(CASE WHEN p IS NOT NULL THEN f END IGNORE NULLS) OVER (PARTITION BY run_id, symbol ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fin FROM gd),
lgs AS (SELECT g.run_id, g.symbol, g.k, g.f, g.p, g.w, c.idx AS t, c.close, c.px, g.w * c.px / g.p AS v FROM ps g JOIN panel c ON c.symbol = g.symbol AND c.idx >= g.f AND c.idx < coalesce(g.fin, 1000000) WHERE g.p IS NOT NULL AND g.w <> 0),
exs AS (SELECT run_id, symbol, k, min(t) AS e FROM lgs WHERE {hit} GROUP BY 1, 2, 3),
lx AS (SELECT l.*, e FROM lgs l LEFT JOIN exs USING (run_id, symbol, k)),
hd AS (SELECT run_id, t, list(struct_pack(k := k, m := m, s := s)) AS hs FROM (SELECT run_id, t, k, sum(v) AS m, sum(greatest(-v, 0)) AS s FROM lx WHERE e IS NULL OR t < e GROUP BY 1, 2, 3) GROUP BY 1, 2),
sx AS (SELECT run_id, t, list(struct_pack(k := k, x := w * close / p)) AS xs FROM lx WHERE t = e GROUP BY 1, 2),
pz AS (SELECT ps.*, CASE WHEN was.w <> 0 AND (e IS NULL OR e >= ps.f) THEN was.k END AS o, was.w * q / was.p AS h FROM ps LEFT JOIN exs ON exs.run_id = ps.run_id AND exs.symbol = ps.symbol AND exs.k = ps.was.k),
fl AS (SELECT run_id, f AS t, list(struct_pack(o := o, h := coalesce(h, 0), w := CASE WHEN p IS NOT NULL THEN w END)) AS fs FROM pz WHERE o IS NOT NULL OR (p IS NOT NULL AND w <> 0) GROUP BY 1, 2),
dd AS (SELECT r.run_id, t, rf, fin, coalesce(fs, []) AS fs, coalesce(hs, []) AS hs, coalesce(xs, []) AS xs, k AS j FROM (SELECT DISTINCT run_id FROM {source}) r CROSS JOIN rt LEFT JOIN fl USING (run_id, t) LEFT JOIN hd USING (run_id, t) LEFT JOIN sx USING (run_id, t) LEFT JOIN (SELECT run_id, f AS t, k FROM mk) USING (run_id, t)),
cu AS (SELECT run_id, CAST(-1 AS BIGINT) AS t, CAST(10000 AS DOUBLE) AS cash, CAST([] AS DOUBLE[]) AS vs, CAST(0 AS DOUBLE) AS equity, CAST(0 AS DOUBLE) AS traded FROM (SELECT DISTINCT run_id FROM {source})
 UNION ALL SELECT run_id, t, c3 * (1 + CASE WHEN c3 < 0 THEN fin ELSE rf END / {YEAR}.0), us, c3 * (1 + CASE WHEN c3 < 0 THEN fin ELSE rf END / {YEAR}.0) + held, tr FROM (
  SELECT *, c2 + coalesce(list_sum(sold), 0) - coalesce(list_sum(list_transform(sold, lambda x: {bps})), 0) - short * {borrow} / 1e4 / {YEAR} AS c3, coalesce(list_sum(list_transform(moves, lambda x: abs(x))), 0) + coalesce(list_sum(sold), 0) AS tr FROM (
   SELECT *, coalesce(list_sum(list_transform(hs, lambda x: us[x.k] * x.m)), 0) AS held, coalesce(list_sum(list_transform(hs, lambda x: us[x.k] * x.s)), 0) AS short, list_transform(xs, lambda x: us[x.k] * x.x) AS sold FROM (
    SELECT *, cash - coalesce(list_sum(moves), 0) - coalesce(list_sum(list_transform(list_transform(moves, lambda x: abs(x)), lambda x: {bps})), 0) AS c2 FROM (
     SELECT *, CASE WHEN j IS NULL THEN vs ELSE list_append(vs, v1) END AS us, list_transform(list_filter(fs, lambda x: x.w IS NOT NULL), lambda x: x.w * v1 - coalesce(vs[x.o], 0) * x.h) AS moves FROM (
      SELECT d.*, c.cash, c.vs, c.cash + coalesce(list_sum(list_transform(fs, lambda x: coalesce(c.vs[x.o], 0) * x.h)), 0) AS v1 FROM cu c JOIN dd d ON d.run_id = c.run_id AND d.t = c.t + 1))))))"""


_SHOWN = f"SELECT run_id, t AS idx, {significant_sql('equity')} AS equity, {significant_sql('traded')} AS traded FROM cu WHERE t >= 0"
_DATED = """SELECT idx AS t, coalesce(last_value(rf IGNORE NULLS) OVER (ORDER BY idx), 0) AS rf, coalesce(last_value(rf + 0.01 IGNORE NULLS) OVER (ORDER BY idx), 0) AS fin FROM cal LEFT JOIN rates USING (dt)"""


def _fixed(rf: float, fin: float) -> str:
    return f"SELECT idx AS t, CAST({rf} AS DOUBLE) AS rf, CAST({fin} AS DOUBLE) AS fin FROM cal"


#: bn: the weights that each run trades to with each band, as a recursion over its marks on lists in the order of its names.
_BANDED = f"""{grid_sql("iv").replace("mk AS", "mk0 AS").replace("nm AS", "nm0 AS").replace("pr AS", "pr0 AS").replace("gd AS", "gd0 AS").replace("JOIN mk ", "JOIN mk0 ").replace("FROM nm ", "FROM nm0 ").replace("JOIN pr ON pr.", "JOIN pr0 pr ON pr.")},
gl AS (SELECT run_id, k, any_value(mark) AS mark, list(symbol ORDER BY symbol) AS ss, list(w ORDER BY symbol) AS ws, list(p ORDER BY symbol) AS p, list(coalesce(q, 0) ORDER BY symbol) AS q, count(*) AS n FROM gd0 GROUP BY 1, 2),
bn AS (SELECT run_id, band, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS mark, CAST([] AS VARCHAR[]) AS ss, CAST([] AS DOUBLE[]) AS p, CAST([] AS DOUBLE[]) AS new, CAST(1 AS DOUBLE) AS cash, list_transform(range(n), lambda i: CAST(0 AS DOUBLE)) AS sh FROM (SELECT run_id, any_value(n) AS n FROM gl GROUP BY 1), (SELECT unnest([{", ".join(map(str, BANDS))}])::DOUBLE AS band)
 UNION ALL SELECT run_id, band, k, mark, ss, p, new, cash + coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN p[i] IS NULL THEN 0 ELSE val[i] - new[i] * eq END)), 0), list_transform(range(1, n + 1), lambda i: CASE WHEN p[i] IS NULL THEN sh[i] ELSE new[i] * eq / p[i] END) FROM (
  SELECT *, CASE WHEN tot > 0 AND gross > 0 AND size > 1 THEN list_transform(new0, lambda x: x / size) ELSE new0 END AS new FROM (
   SELECT *, list_sum(list_transform(new0, lambda x: abs(x))) AS size FROM (
    SELECT *, CASE WHEN tot > 0 AND gross > 0 THEN list_transform(range(1, n + 1), lambda i: least(greatest(CASE WHEN p[i] IS NULL THEN 0 ELSE val[i] END / tot * gross, ws[i] - band * abs(ws[i])), ws[i] + band * abs(ws[i]))) ELSE ws END AS new0 FROM (
     SELECT *, cash + list_sum(val) AS eq, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN p[i] IS NULL THEN 0 ELSE abs(val[i]) END)) AS tot, list_sum(list_transform(ws, lambda x: abs(x))) AS gross FROM (
      SELECT g.*, b.band, b.cash, b.sh, list_transform(range(1, n + 1), lambda i: b.sh[i] * g.q[i]) AS val FROM bn b JOIN gl g ON g.run_id = b.run_id AND g.k = b.k + 1))))))"""
_PATH = f"{_BASE}, {_BANDED}, bt AS (SELECT run_id, band, mark, unnest(ss) AS symbol, unnest(new) AS w, unnest(p) AS p FROM bn WHERE k > 0)"
_RUNS = "bw AS (SELECT run_id || '|' || CAST(band AS VARCHAR) AS run_id, mark, symbol, w FROM bt WHERE p IS NOT NULL AND w <> 0)"

SQL = {
    "P8_daily_curve": f"{_BASE}, {dt.RATES_SQL}, lw AS (SELECT run_id, mark, symbol, 1.2 * w AS w FROM iv), {curve_sql('lw', 'x * 0.001', _DATED)} {_SHOWN}",
    "P8_close_curve": f"{_BASE}, lw AS (SELECT run_id, mark, symbol, CASE WHEN symbol LIKE 'Brand#1%' THEN -w ELSE w END AS w FROM iv), {curve_sql('lw', 'least(x, 900) * 8e-4 + greatest(x - 900, 0) * 25e-4', _fixed(0.02, 0.03), 0, 50.0)} {_SHOWN}",
    "P9_stopped_curve": f"{_BASE}, {curve_sql('iv', 'x * 0.001', _fixed(0.02, 0.0), stop=0.08)} {_SHOWN}",
    "W16_banded_path": f"{_PATH} SELECT run_id, band, mark, symbol, round(w, 6) + 0.0 AS w FROM bt WHERE p IS NOT NULL AND w <> 0",
    "P22_turnover_by_band": f"""{_PATH}, {_RUNS}, {curve_sql('bw', 'x * 0.001', _fixed(0.0, 0.0))},
y AS (SELECT run_id, CAST(split_part(run_id, '|', 2) AS DOUBLE) AS band, sum(traded) / avg(equity) / ((max(t) - min(t) + 1) / {YEAR}.0) AS v FROM cu WHERE t >= 0 GROUP BY 1)
SELECT band, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(min(v), 6) + 0.0 AS least, round(max(v), 6) + 0.0 AS most, round(max(v) - min(v), 6) + 0.0 AS spread FROM y GROUP BY 1""",
}
