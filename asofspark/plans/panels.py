"""Queries on filings, observation panels, source routing, lock checks and variants of one operator as parameter rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofspark.operators import asof as pit
from asofspark.operators import blocks as bl
from asofspark.operators import books as bk
from asofspark.operators import filings as fl
from asofspark.operators import observations as ob
from asofspark.operators import panel as pn
from asofspark.operators import quality as qu
from asofspark.operators import ranking as rk
from asofspark.operators import research as rs
from asofspark.operators import scoring as sc
from asofspark.operators import timeseries as ts
from asofspark.operators import weights as wt
from asofspark.plans import portfolio as pf
from asofspark.plans.books import _G, grid
from asofspark.plans.common import rounded, significant_sql
from asofspark.plans.fundamentals import _FSCORE, CANONICAL_SQL, EXCLUDED, HIGH, LOW, _ranks_sql, canonical
from asofspark.plans.parts import _LABEL_ROWS, LABELS, SECTORS, labelled, sics
from asofspark.plans.research import OBS, pairs, ranks
from asofspark.plans.timeseries import BY, PANEL, mom, r6, roll
from asofspark.plans.timeseries import SQL as TS_SQL
from asofspark.sources import driver_tables as dt
from asofspark.sources import sinks

#: Statement lines that filings report, with their tags; filings give investment and taxes as positive numbers.
TAGS = {
    "net_income": "NetIncomeLoss", "revenue": "Revenues", "gross_profit": "GrossProfit", "operating_income": "OperatingIncomeLoss", "pretax": "IncomeBeforeTaxes", "interest": "InterestExpense",
    "depreciation": "Depreciation", "tax_expense": "IncomeTaxExpense", "cfo": "OperatingCashFlow", "capex": "PaymentsForPlant", "cash": "Cash", "equity": "StockholdersEquity",
    "total_assets": "Assets", "long_term_debt": "LongTermDebt", "short_term_debt": "ShortTermDebt", "shares": "SharesOutstanding",
}


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual facts of all companies, from fact rows with later amendments among them; one company in six reports no operating income."""
    s = dt.statements(spark, sf_dir).withColumns({"tax_expense": -F.col("tax_expense"), "capex": -F.col("capex")})
    s = s.withColumn("operating_income", F.when(F.substring("ticker", 2, 6).cast("int") % 6 != 0, F.col("ebit")))
    long = s.unpivot(["ticker", "report_date", "publish_date"], list(TAGS), "field", "val").where("val is not null")
    tags = spark.createDataFrame([(f, t, 0) for f, t in TAGS.items()], "field string, tag string, prio int")
    base = long.join(tags, "field").select(F.col("ticker").alias("cik"), "tag", F.lit(0).alias("unit_pos"), F.lit(0).alias("arr_pos"), F.lit(None).cast("date").alias("start"), F.col("report_date").alias("end"), F.col("publish_date").alias("filed"), "val", F.lit("10-K").alias("form"), F.lit("FY").alias("fp"))
    later = base.withColumns({"arr_pos": F.lit(1), "filed": F.date_add("filed", 200), "val": F.col("val") * 1.5, "form": F.lit("10-K/A")})
    return fl.annual_facts(base.unionByName(later), tags)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.extract_asof(filed(spark, sf_dir), dt.asofs(spark), list(TAGS))


FLAT = f"""{dt.statements_sql()}, {dt.ASOFS_SQL}, {dt.PRICES_ASOF_SQL}, fk AS (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS k, row_number() OVER (PARTITION BY ticker, as_of ORDER BY report_date DESC) AS age FROM statements JOIN asofs ON publish_date <= as_of),
fv AS (SELECT * REPLACE (-tax_expense AS tax_expense, -capex AS capex), CASE WHEN k % 6 <> 0 THEN ebit END AS operating_income FROM fk WHERE age <= 2),
fx AS (SELECT ticker AS cik, as_of, max(report_date) AS fy_end, {", ".join(f"max(CASE WHEN age = 1 THEN {f} END) AS {f}, max(CASE WHEN age = 2 THEN {f} END) AS {f}_prior" for f in TAGS)} FROM fv GROUP BY 1, 2 HAVING count(*) = 2)"""


def q_flat(spark, d):
    x = flat(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("val"), F.col(f"{f}_prior").alias("prior")) for f in TAGS])).alias("e")
    return rounded(x.select("cik", "as_of", "fy_end", each).select("cik", "as_of", "fy_end", "e.*"), 2, ("val", "prior"))


def from_filings(spark, d):
    prices = dt.prices_asof(spark, d).withColumnRenamed("ticker", "cik")
    sector = sics(spark, d).select(F.concat(F.lit("S"), F.substring("cik", 5, 6)).alias("cik"), fl.sic_to_sector(F.col("code"), SECTORS).alias("sector"))
    return pit.canonical_from_filings(flat(spark, d), prices, sector)


FILED = ["ebit", "ebitda", "total_debt", "total_debt_prior", "tax_rate", "free_cash_flow", "market_cap", "enterprise_value"]
_FILINGS = f"""{FLAT}, sec AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS cik, 100 + s_suppkey * 37 % 9000 AS code FROM supplier),
ca0 AS (SELECT fx.*, price, CASE {" ".join(f"WHEN code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in SECTORS)} END AS sector, coalesce(operating_income, pretax + coalesce(interest, 0)) AS ebit,
  CASE WHEN long_term_debt IS NULL AND short_term_debt IS NULL THEN NULL ELSE coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END AS total_debt,
  CASE WHEN long_term_debt_prior IS NULL AND short_term_debt_prior IS NULL THEN NULL ELSE coalesce(long_term_debt_prior, 0) + coalesce(short_term_debt_prior, 0) END AS total_debt_prior,
  least(greatest(tax_expense / nullif(pretax, 0), 0), 0.6) AS tax_rate, cfo - capex AS free_cash_flow, price * shares AS market_cap
  FROM fx LEFT JOIN prices_asof p ON p.ticker = fx.cik AND p.as_of = fx.as_of LEFT JOIN sec ON sec.cik = fx.cik),
ca AS (SELECT *, ebit + depreciation AS ebitda, market_cap + coalesce(total_debt, 0) - coalesce(cash, 0) AS enterprise_value FROM ca0)"""


def q_filings(spark, d):
    return rounded(from_filings(spark, d).select("cik", "as_of", "sector", *FILED, "source"), 2)


def from_labels(spark, d):
    s = dt.statements(spark, d)
    info = s.groupBy("ticker").agg(F.max_by("cash", "report_date").alias("cash"), F.max_by("long_term_debt", "report_date").alias("total_debt"), F.max_by("shares", "report_date").alias("shares"))
    return pit.canonical_from_labels(sinks.read_labelled(labelled(spark, d), LABELS), info)


def q_labels(spark, d):
    return rounded(from_labels(spark, d).select("ticker", "period", "revenue", "ebit", "net_income", "total_assets", "cash", "total_debt", "shares", "source"), 2)


def q_route(spark, d):
    """Names of each source by itself: what a run on that source would see."""
    tables = {"filings": lambda: from_filings(spark, d), "statements": lambda: canonical(spark, d), "labels": lambda: from_labels(spark, d)}
    out = None
    for name in pit.SOURCES:
        x = pit.route_source(name, **tables).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cash"), 0).alias("cash"))
        out = x if out is None else out.unionByName(x)
    return rounded(out, 0)


def momentum_signals(spark, d):
    """ticker, as_of, mom, fwd from mean unit prices in the 90 days up to days around each date."""
    lines = dt.table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    marks = dt.asofs(spark).withColumn("shift", F.explode(F.array(F.lit(-365), F.lit(-30), F.lit(0), F.lit(365)))).withColumn("m", F.date_add("as_of", F.col("shift")))
    ticker = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("ticker")
    x = lines.join(marks, (F.col("d") <= F.col("m")) & (F.col("d") > F.date_sub("m", 90))).groupBy(ticker, "as_of", "shift").agg(F.avg("px").alias("p"))
    at = lambda k: F.max(F.when(F.col("shift") == k, F.col("p")))
    return x.groupBy("ticker", "as_of").agg((at(-30) / at(-365) - 1).alias("mom"), (at(365) / at(0) - 1).alias("fwd"))


SIGNALS = """sh(shift) AS (VALUES (-365), (-30), (0), (365)), pxs AS (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, as_of, shift, avg(l_extendedprice / l_quantity) AS p
  FROM lineitem, asofs, sh WHERE CAST(l_shipdate AS DATE) <= as_of + shift AND CAST(l_shipdate AS DATE) > as_of + shift - 90 GROUP BY 1, 2, 3),
pm AS (SELECT ticker, as_of, max(p) FILTER (WHERE shift = -30) / max(p) FILTER (WHERE shift = -365) - 1 AS mom, max(p) FILTER (WHERE shift = 365) / max(p) FILTER (WHERE shift = 0) - 1 AS fwd FROM pxs GROUP BY 1, 2)"""
#: Lines that are changed by year, as the driver's ratios are equal in all years but for rounding.
_MOVED = ("long_term_debt", "current_assets", "revenue")
_YEARLY = ", ".join(f"{n}{s} * (1 + (year(report_date) - {int(bool(s))}) % 3 / 100.0) AS {n}{s}" for n in _MOVED for s in ("", "_prior"))
MOVED = CANONICAL_SQL.replace("canonical AS (", "canonical0 AS (", 1).replace("factored AS (", f"canonical AS (SELECT * REPLACE ({_YEARLY}) FROM canonical0),\nfactored AS (", 1)


def moved(spark, d):
    x = canonical(spark, d)
    for s in ("", "_prior"):
        x = x.withColumns({f"{n}{s}": F.col(f"{n}{s}") * (1 + (F.year("report_date") - int(bool(s))) % 3 / 100.0) for n in _MOVED})
    return x


def observations(spark, d):
    return ob.collect_obs(moved(spark, d), momentum_signals(spark, d), LOW, HIGH, EXCLUDED)


_OBS_COLS = ["ev_ebit", "price_fcf", "roic", "gm_stability", "net_debt_ebitda", "mom", "fwd"]


def _obs_rows(x):
    return rounded(x.select("ticker", "as_of", *_OBS_COLS, F.col("fscore").cast("long").alias("fscore")), 5)


def q_collect(spark, d):
    return _obs_rows(observations(spark, d))


def q_cache(spark, d):
    return _obs_rows(ob.cache_obs(observations(spark, d), ob.scratch(spark, "obs")))


def q_research(spark, d):
    return rounded(ob.research_panel(moved(spark, d), momentum_signals(spark, d)), 5)


def q_drag(spark, d):
    x = rk.composite(observations(spark, d), {f: 0.2 for f in rk.fx.LOWER_BETTER}, ("as_of", "sector")).withColumn("composite", F.round("composite", 9))
    fields = [f"{f}_pct" for f in rk.fx.LOWER_BETTER]
    x = x.withColumns({f: F.round(f, 9) for f in fields} | {"mom": F.round("mom", 9), "fwd": F.round("fwd", 9)})
    return rounded(rs.decompose_drag(x, [*fields, "composite"], "mom"), 5)


def q_validate_panel(spark, d):
    p = pn.panel(dt.bars(spark, d)).select("symbol", "dt", F.when(F.col("symbol") == "Brand#9", F.lit(None)).when(F.dayofmonth("dt") == 3, -F.col("px")).otherwise(F.col("px")).alias("px"))
    return qu.validate_panel(p.unionByName(p.where("symbol = 'Brand#7' and month(dt) = 2")))


def q_priced(spark, d):
    p = dt.prices_asof(spark, d).withColumn("price", F.when(~F.col("ticker").endswith("77"), F.col("price")))
    return ob.tickers_priced(dt.statements(spark, d).select("ticker"), p)


def q_dual(spark, d):
    x = pn.panel(dt.bars(spark, d)).where("close is not null")
    w = Window.partitionBy("symbol").orderBy("dt")
    growth = x.select("symbol", "dt", (F.col("px") / F.first("px").over(w)).alias("px"))
    return rounded(ob.dual_view_prices(growth, x.select("symbol", "dt", F.col("close").alias("px"))))


def q_ext_vol(spark, d):
    sig, _ = pf.trend(spark, d)
    vols = pn.panel(dt.bars(spark, d)).withColumn("vol", ts.rolling_vol(13, 52)).select(F.col("idx").alias("mark"), "symbol", "vol")
    return rounded(pf._long(wt.ext_vol_weights(sig, vols).select("run_id", "mark", "symbol", "w"), "mark"))


def snapshots(spark, d):
    """Locks of the trend book with the closes that their weights came from."""
    p = pn.panel(dt.bars(spark, d))
    sig, _ = pf.trend(spark, d)
    w = wt.inverse_vol_weights(sig).where("run_id = 'o0'").select("mark", "symbol", "w")
    before = Window.partitionBy("symbol").orderBy("idx").rowsBetween(-26, 0)
    look = F.create_map(*[c for n in pf.LOOKS for c in (F.lit(str(n)), F.lag("px", n).over(Window.partitionBy("symbol").orderBy("idx")))])
    x = p.select("symbol", "idx", "dt", F.struct(F.collect_list("px").over(before).alias("window64"), look.alias("looks")).alias("s"))
    x = x.join(w, (F.col("idx") == F.col("mark")) & (x["symbol"] == w["symbol"])).select(x["symbol"], "dt", "s", "w")
    return x.groupBy(F.lit("trend").alias("strategy"), F.col("dt").alias("lock_date")).agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", "w"))).alias("picks"), F.struct(F.max("dt").alias("asof"), F.map_from_entries(F.collect_list(F.struct("symbol", "s"))).alias("closes")).alias("signal_snapshot")
    )


def q_verify(spark, d):
    """Locks of which every fifth had its weights changed afterwards, and every seventh has lost its snapshot."""
    x = snapshots(spark, d).withColumn("_i", F.row_number().over(Window.orderBy("lock_date")))  # one row a lock
    x = x.withColumn("picks", F.transform_values("picks", lambda _, w: F.when(F.col("_i") % 5 == 0, w * 1.02).otherwise(w)))
    x = x.withColumn("signal_snapshot", F.when(F.col("_i") % 7 != 3, F.col("signal_snapshot")))
    return rounded(ob.verify_lock(x, tuple(map(str, pf.LOOKS)), year=52))


def q_regime(spark, d):
    sig, _ = pf.trend(spark, d)
    beta = ts.rolling_beta(pn.panel(dt.bars(spark, d)), "Brand#1", 26).select(F.col("idx").alias("mark"), "symbol", F.round("beta", 6).alias("beta")).where("beta is not null")
    return rounded(pf._long(ob.regime_posture(wt.inverse_vol_weights(sig), beta, ["Brand#10", "Brand#11"]), "mark"), 5)


VARIANTS = [("base", 0.6, 10.0), ("cheap", 0.6, 0.0), ("core", 0.9, 10.0), ("even", 0.5, 25.0)]


def q_variants(spark, d):
    """One two-leg book under four parameter rows, as runs of one job."""
    v = spark.createDataFrame(VARIANTS, "variant string, w double, bps double")
    x = pf.legs(spark, d).join(v, how="cross")  # four rows
    return rounded(sc.two_leg_mix(x, F.col("w"), F.col("bps"), ("variant", "w", "bps")).select("variant", "dt", "equity"), 5, ("equity",))


def q_dated(spark, d):
    """The trend book at one and a half times its weights, with dated financing of what is borrowed."""
    sig, _ = pf.trend(spark, d)
    w = wt.inverse_vol_weights(sig).select("run_id", F.col("mark").cast("long").alias("mark"), "symbol", (1.5 * F.col("w")).alias("w"))
    p = pn.panel(dt.bars(spark, d))
    rates = pn.calendar(dt.bars(spark, d)).join(dt.rates(spark, d), "dt").select(F.col("idx").cast("long").alias("idx"), "rf")
    return rounded(sc.schedule_curve(w, p.select("symbol", F.col("idx").cast("long").alias("idx"), "px"), 10.0, rates=rates, financing=0.015, rows_a_year=52.0), 6, ("equity",))


def q_shares(spark, d):
    return rounded(ob.breadth_shares(ranks(spark, d), [0.1, 0.2, 0.5]), 5)


def q_stitched(spark, d):
    g = grid(spark, d)
    w = Window.partitionBy("symbol").orderBy("idx")
    hold = pn.panel(dt.bars(spark, d)).select("symbol", F.col("idx").cast("long").alias("idx"), F.log(F.col("px") / F.lag("px").over(w)).alias("hold"))
    rows = g.join(hold, ["symbol", "idx"])
    best = rs.grid_rank(g.groupBy("symbol", "run_id").agg(F.round(F.sum("x"), 9).alias("all")), ["symbol"], "all")
    return rounded(ob.stitched_walk(rows, bk.walk_forward(g, 104, 26, 144), 26, best, "5-20"), 5)


def q_pair_spreads(spark, d):
    """Spread and z-score of every candidate pair, and the positions that follow from them."""
    p = pn.panel(dt.bars(spark, d))
    x = ts.pair_spreads(p, pairs(spark, d).select(F.concat_ws("|", "a", "b").alias("pair"), "a", "b", F.lit(0.9).alias("beta")), 30)
    z = x.select("pair", F.col("idx").cast("long").alias("idx"), F.round("z", 6).alias("z"))
    held = wt.pair_positions(z, 1.5, 0.3, 4.0)
    return rounded(held.groupBy("pair").agg(F.count("z").alias("rows"), F.sum(F.abs("position")).cast("long").alias("held"), F.sum("position").cast("long").alias("net"), F.avg("z").alias("mean_z")), 5)


def q_part_momentum(spark, d):
    """Momentum, volatility and their ranks over weekly bars of every part: the number of symbols grows with the table."""
    return rounded(bl.momentum_table(dt.bars(spark, d, "p_partkey"), dt.weeks(spark, d), dt.tasks(spark, d)), 4)


QUERIES = {
    "T7_part_momentum": q_part_momentum,
    "T21_pair_spreads": q_pair_spreads,
    "A4_fundamentals_flat": q_flat, "A5_canonical_filings": q_filings, "A9_canonical_labels": q_labels, "A18_route_source": q_route, "X6_collect_obs": q_collect, "S20_cache_obs": q_cache,
    "X8_research_panel": q_research, "X7_decompose_drag": q_drag, "Q2_validate_panel": q_validate_panel, "Q13_tickers_priced": q_priced, "S4_dual_view": q_dual, "W3_ext_vol_weights": q_ext_vol,
    "X28_verify_lock": q_verify, "X29_regime_posture": q_regime, "X31_variants": q_variants, "X31_dated_financing": q_dated, "X5_breadth_shares": q_shares, "X22_stitched": q_stitched,
}
_OBS_SQL = f"""WITH {MOVED}, {SIGNALS}, elig AS (SELECT f.*, mom, fwd FROM funnel f LEFT JOIN pm USING (ticker, as_of) WHERE drop_reason IS NULL OR drop_reason IN ('altman_z', 'beneish_m'))"""
_OBS_OUT = f"{_OBS_SQL} SELECT ticker, as_of, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _OBS_COLS) + f", CASE WHEN total_assets_prior IS NULL THEN NULL ELSE CAST({_FSCORE} AS BIGINT) END AS fscore FROM elig"
_DRAG = ["ev_ebit_pct", "price_fcf_pct", "roic_pct", "gm_stability_pct", "net_debt_ebitda_pct", "composite", "mom"]
SQL = {
    "T7_part_momentum": f"""WITH {dt.bars_sql("p_partkey")}, {dt.PANEL_SQL}, x AS (SELECT idx, {mom(4, 52)} AS mom, ({roll('stddev_samp', 'ret', 26)}) * sqrt(52) AS vol, lead(px, 4) OVER ({BY}) / px - 1 AS fwd FROM rets),
y AS (SELECT *, 100.0 * (rank() OVER (PARTITION BY idx ORDER BY mom) + (count(*) OVER (PARTITION BY idx, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY idx) AS pct FROM x WHERE mom IS NOT NULL)
SELECT idx, count(*) AS n, round(avg(mom), 4) + 0.0 AS mom, round(avg(vol), 4) + 0.0 AS vol, round(avg(fwd) FILTER (WHERE pct > 90) - avg(fwd) FILTER (WHERE pct <= 10), 4) + 0.0 AS spread FROM y GROUP BY 1""",
    "T21_pair_spreads": f"""{PANEL.replace("WITH", "WITH RECURSIVE", 1)}, mem AS (SELECT DISTINCT symbol, right(symbol, 1) AS grp FROM panel), prs AS (SELECT x.symbol AS a, y.symbol AS b, x.symbol || '|' || y.symbol AS pair FROM mem x JOIN mem y USING (grp) WHERE x.symbol < y.symbol),
sp AS (SELECT pair, x.idx, x.px - 0.9 * y.px AS s FROM prs JOIN panel x ON x.symbol = a JOIN panel y ON y.symbol = b AND y.idx = x.idx),
zs AS (SELECT pair, idx, row_number() OVER (PARTITION BY pair ORDER BY idx) AS k, round((s - ({roll('avg', 's', 30, 'PARTITION BY pair ORDER BY idx')})) / ({roll('stddev_samp', 's', 30, 'PARTITION BY pair ORDER BY idx')}), 6) AS z FROM sp),
p AS (SELECT DISTINCT pair, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos FROM prs UNION ALL SELECT p.pair, zs.k, CAST(CASE WHEN z IS NULL THEN pos WHEN pos = 0 THEN CASE WHEN abs(z) > 1.5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END WHEN abs(z) < 0.3 OR abs(z) > 4.0 THEN 0 ELSE pos END AS BIGINT) FROM p JOIN zs ON zs.pair = p.pair AND zs.k = p.k + 1)
SELECT pair, count(z) AS rows, CAST(sum(abs(pos)) AS BIGINT) AS held, CAST(sum(pos) AS BIGINT) AS net, round(avg(z), 5) + 0.0 AS mean_z FROM p JOIN zs USING (pair, k) GROUP BY 1""",
    "A4_fundamentals_flat": f"WITH {FLAT} " + " UNION ALL ".join(f"SELECT cik, as_of, fy_end, '{f}' AS field, {significant_sql(f)} AS val, {significant_sql(f + '_prior')} AS prior FROM fx" for f in TAGS),
    "A5_canonical_filings": f"WITH {_FILINGS} SELECT cik, as_of, sector, {', '.join(f'round({c}, 2) + 0.0 AS {c}' for c in FILED)}, 'filings' AS source FROM ca",
    "A9_canonical_labels": f"""WITH {dt.statements_sql()}, {_LABEL_ROWS}, i AS (SELECT ticker, arg_max(cash, report_date) AS cash, arg_max(long_term_debt, report_date) AS total_debt, arg_max(shares, report_date) AS shares FROM statements GROUP BY 1),
p AS (SELECT ticker, period, {", ".join(f"max(CASE WHEN field = '{f}' THEN val END) AS {f}" for f in LABELS)} FROM lb WHERE val IS NOT NULL GROUP BY 1, 2)
SELECT ticker, period, {", ".join(f"round(p.{f}, 2) + 0.0 AS {f}" for f in LABELS if f != "cash")}, round(coalesce(p.cash, i.cash), 2) + 0.0 AS cash, round(total_debt, 2) + 0.0 AS total_debt, round(shares, 2) + 0.0 AS shares, 'labels' AS source FROM p LEFT JOIN i USING (ticker)""",
    "A18_route_source": f"""WITH {CANONICAL_SQL}, {_LABEL_ROWS}, i AS (SELECT ticker, arg_max(cash, report_date) AS c FROM statements GROUP BY 1), l AS (SELECT ticker, period, max(CASE WHEN field = 'cash' THEN val END) AS cash FROM lb WHERE val IS NOT NULL GROUP BY 1, 2),
u AS (SELECT 'statements' AS source, cash FROM canonical UNION ALL SELECT 'filings', cash FROM (SELECT ticker, as_of, max(CASE WHEN age = 1 THEN cash END) AS cash FROM ranked WHERE age <= 2 GROUP BY 1, 2 HAVING count(*) = 2) UNION ALL SELECT 'labels', coalesce(cash, c) FROM l JOIN i USING (ticker))
SELECT source, count(*) AS n, round(sum(cash), 0) + 0.0 AS cash FROM u GROUP BY 1""",
    "X6_collect_obs": _OBS_OUT,
    "S20_cache_obs": _OBS_OUT,
    "X8_research_panel": f"WITH {MOVED}, {SIGNALS} SELECT ticker, as_of, " + ", ".join(f"round({e}, 5) + 0.0 AS {c}" for c, e in [(c, c) for c in _OBS_COLS[:5]] + [("gross_profitability", "gross_profitability"), ("asset_growth", "total_assets / nullif(total_assets_prior, 0) - 1"), ("net_issuance", "shares / nullif(shares_prior, 0) - 1"), ("fwd", "fwd")]) + " FROM factored LEFT JOIN pm USING (ticker, as_of)",
    "X7_decompose_drag": f"""{_OBS_SQL}, {_ranks_sql("elig", "as_of, sector")}, lg AS ({" UNION ALL ".join(f"SELECT as_of, '{c}' AS field, round({c}, 9) AS v, round(fwd, 9) AS f FROM elig_c WHERE fwd IS NOT NULL AND {c} IS NOT NULL" for c in _DRAG)}),
rk AS (SELECT *, rank() OVER (PARTITION BY as_of, field ORDER BY v) + (count(*) OVER (PARTITION BY as_of, field, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY as_of, field ORDER BY f) + (count(*) OVER (PARTITION BY as_of, field, f) - 1) / 2.0 AS b FROM lg),
ic AS (SELECT field, as_of, corr(a, b) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 5) SELECT field, round(avg(ic), 5) + 0.0 AS mean_ic, count(ic) AS dates FROM ic GROUP BY 1""",
    "Q2_validate_panel": f"""{PANEL}, p AS (SELECT symbol, dt, CASE WHEN symbol = 'Brand#9' THEN NULL WHEN day(dt) = 3 THEN -px ELSE px END AS px FROM panel), q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE symbol = 'Brand#7' AND month(dt) = 2),
c AS (SELECT symbol, count(*) - count(DISTINCT dt) AS twice, CASE WHEN count(px) = 0 THEN 1 ELSE 0 END AS dead, count(*) FILTER (WHERE px <= 0) AS low FROM q GROUP BY 1)
SELECT 'repeated date' AS rule, symbol, CAST(twice AS BIGINT) AS n FROM c WHERE twice > 0 UNION ALL SELECT 'no price', symbol, CAST(dead AS BIGINT) FROM c WHERE dead > 0 UNION ALL SELECT 'not positive', symbol, CAST(low AS BIGINT) FROM c WHERE low > 0""",
    "Q13_tickers_priced": f"""WITH {dt.statements_sql()}, {dt.ASOFS_SQL}, {dt.PRICES_ASOF_SQL}, t AS (SELECT DISTINCT ticker FROM statements), k AS (SELECT DISTINCT ticker, 1 AS ok FROM prices_asof WHERE NOT ends_with(ticker, '77')), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok IS NULL) AS m FROM t LEFT JOIN k USING (ticker))
SELECT 'tickers' AS "check", CASE WHEN m = 0 THEN 'PASS' WHEN m * 10 <= n THEN 'WARN' ELSE 'FAIL' END AS status, m || ' of ' || n || ' without a price' AS message FROM c""",
    "S4_dual_view": f"{PANEL}, x AS (SELECT symbol, dt, close, px FROM panel WHERE close IS NOT NULL) SELECT symbol, dt, round(px / first_value(px) OVER (PARTITION BY symbol ORDER BY dt), 6) + 0.0 AS adjusted, round(close, 6) + 0.0 AS raw FROM x",
    "W3_ext_vol_weights": f"{pf.TREND}, xv AS (SELECT symbol, idx, ({roll('stddev_samp', 'ret', 13)}) * sqrt(52) AS v FROM rets), a AS (SELECT run_id, mark, symbol, strength / nullif(v, 0) AS w0 FROM sig JOIN xv USING (symbol) WHERE idx = mark AND strength / nullif(v, 0) <> 0) SELECT run_id, mark, symbol, round(w0 / sum(abs(w0)) OVER (PARTITION BY run_id, mark), 6) + 0.0 AS w FROM a",
    "X28_verify_lock": f"""{pf.TREND}, lk AS (SELECT mark, symbol, w, dense_rank() OVER (ORDER BY mark) AS i FROM iv WHERE run_id = 'o0'), pk AS (SELECT *, CASE WHEN i % 5 = 0 THEN w * 1.02 ELSE w END AS p FROM lk),
c AS (SELECT mark, any_value(i) AS i, count(*) AS names, max(abs(p - w)) AS off, min(p) AS least, sum(p) AS total FROM pk GROUP BY 1)
SELECT 'trend' AS book, dt AS lock_date, names, CASE WHEN i % 7 <> 3 THEN round(off, 6) + 0.0 END AS deviation, CASE WHEN i % 7 <> 3 THEN off <= 5e-6 ELSE least > 0 AND total <= 1 + 1e-9 END AS ok FROM c JOIN cal ON idx = mark""",
    "X29_regime_posture": f"""{pf.TREND}, bt AS (SELECT symbol, dt, beta FROM ({TS_SQL["T24_rolling_beta"]}) WHERE beta IS NOT NULL), b AS (SELECT run_id, mark, sum(w * beta) AS beta FROM iv JOIN cal ON idx = mark JOIN bt USING (symbol, dt) GROUP BY 1, 2),
x AS (SELECT run_id, mark, sum(abs(w)) AS deployed, sum(CASE WHEN symbol IN ('Brand#10', 'Brand#11') THEN abs(w) ELSE 0 END) AS s FROM iv GROUP BY 1, 2)
SELECT run_id, mark, round(deployed, 5) + 0.0 AS deployed, round(s / deployed, 5) + 0.0 AS defensive, round(1 - s / deployed, 5) + 0.0 AS risk, round(beta, 5) + 0.0 AS beta FROM x LEFT JOIN b USING (run_id, mark)""",
    "X31_variants": f"""{pf.LEGS}, pr(variant, pw, bps) AS (VALUES {", ".join(f"('{v}', {w}, {b})" for v, w, b in VARIANTS)}),
x AS (SELECT variant, pw, bps, dt, date_trunc('month', dt) AS mo, exp(sum(ln(1 + ra)) OVER (PARTITION BY variant, date_trunc('month', dt) ORDER BY dt)) AS a, exp(sum(ln(1 + rb)) OVER (PARTITION BY variant, date_trunc('month', dt) ORDER BY dt)) AS b FROM legs, pr),
e AS (SELECT variant, pw, bps, mo, arg_max(a, dt) AS ea, arg_max(b, dt) AS eb FROM x GROUP BY 1, 2, 3, 4), f AS (SELECT *, pw * ea + (1 - pw) * eb AS tot, lag(pw * ea / (pw * ea + (1 - pw) * eb)) OVER (PARTITION BY variant ORDER BY mo) AS drift FROM e),
g AS (SELECT *, CASE WHEN drift IS NULL THEN 1.0 ELSE 2 * abs(pw - drift) END AS turn FROM f), h AS (SELECT *, coalesce(exp(sum(ln(tot * (1 - turn * bps / 1e4))) OVER (PARTITION BY variant ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS st FROM g)
SELECT x.variant, dt, {significant_sql("10000 * st * (1 - turn * x.bps / 1e4) * (x.pw * a + (1 - x.pw) * b)")} AS equity FROM x JOIN h ON h.variant = x.variant AND h.mo = x.mo""",
    "X31_dated_financing": f"""{pf.TREND}, {dt.RATES_SQL}, big AS (SELECT run_id, mark, symbol, 1.5 * w AS w FROM iv), rc AS (SELECT idx, sum(rf) OVER (ORDER BY idx) AS c FROM cal JOIN rates USING (dt)),
{pf.schedule_sql("big", "+ (1 - sum(w)) * (coalesce(((SELECT c FROM rc WHERE idx = any_value(nx)) - (SELECT c FROM rc WHERE idx = mark)) / 52.0 + CASE WHEN 1 - sum(w) < 0 THEN 0.015 * (any_value(nx) - mark) / 52.0 ELSE 0 END, 0))")}
SELECT run_id, mark, {significant_sql("equity")} AS equity, {r6("turnover")} AS turnover FROM cv""",
    "X5_breadth_shares": f"""{OBS}, s AS (SELECT date, name, fwd, round(avg(pct), 9) AS score FROM rk WHERE pct IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, name) AS t, row_number() OVER (PARTITION BY date ORDER BY score, name) AS b, count(*) OVER (PARTITION BY date) AS n FROM s),
k AS (SELECT t.*, sh.share, greatest(1, floor(n * sh.share)) AS k FROM t, (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE]) AS share) sh), u AS (SELECT share, date, avg(fwd) FILTER (WHERE t <= k) AS l, avg(fwd) FILTER (WHERE t <= k) - avg(fwd) FILTER (WHERE b <= k) AS ls FROM k GROUP BY 1, 2) SELECT share, round(avg(l), 5) + 0.0 AS "long", round(avg(ls), 5) + 0.0 AS long_short FROM u GROUP BY 1""",
    "X22_stitched": f"""{_G}, f AS (SELECT unnest(generate_series(144, (SELECT max(idx) FROM gy), 26)) AS fold), s AS (SELECT symbol, fold, run_id, sum(x) FILTER (WHERE idx < fold) AS trained FROM gy JOIN f ON idx >= fold - 104 AND idx < fold + 26 GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY trained DESC NULLS LAST, run_id) AS p FROM s), wn AS (SELECT symbol, fold, run_id FROM p WHERE p = 1),
al AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a DESC NULLS LAST, run_id) AS p FROM (SELECT symbol, run_id, round(sum(x), 9) AS a FROM gy GROUP BY 1, 2)), hd AS (SELECT symbol, idx, ln(px / lag(px) OVER (PARTITION BY symbol ORDER BY idx)) AS hold FROM panel),
r AS (SELECT gy.*, hold, 144 + (idx - 144) // 26 * 26 AS fold FROM gy JOIN hd USING (symbol, idx) JOIN (SELECT symbol, min(fold) AS f0 FROM wn GROUP BY 1) USING (symbol) WHERE idx >= f0)
SELECT symbol, 'walk forward' AS scheme, round(sum(x), 5) + 0.0 AS growth FROM r JOIN wn USING (symbol, fold, run_id) GROUP BY 1 UNION ALL SELECT symbol, 'best of all', round(sum(x), 5) + 0.0 FROM r JOIN (SELECT symbol, run_id FROM al WHERE p = 1) USING (symbol, run_id) GROUP BY 1
UNION ALL SELECT symbol, 'untuned', round(sum(x), 5) + 0.0 FROM r WHERE run_id = '5-20' GROUP BY 1 UNION ALL SELECT symbol, 'hold', round(sum(hold), 5) + 0.0 FROM r WHERE run_id = '5-20' GROUP BY 1""",
}
