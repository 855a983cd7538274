"""Queries on statements: as-of selection, factors, funnel, composite and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.functions import factors as fx
from asofspark.operators import asof as pit
from asofspark.operators import ranking
from asofspark.plans.common import rounded, rounded_sql
from asofspark.sources import driver_tables as dt

#: Capitalization band and excluded sector for the driver's companies (fixed values).
LOW, HIGH, EXCLUDED = 1e6, 1e7, ("AFRICA",)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = pit.statements_asof(dt.statements(spark, sf_dir), dt.asofs(spark))
    return pit.canonical_from_statements(pit.side_by_side(ranked, dt.LINES), dt.prices_asof(spark, sf_dir))


_FSCORE = """(CASE WHEN net_income / total_assets > 0 THEN 1 ELSE 0 END) + (CASE WHEN cfo > 0 THEN 1 ELSE 0 END)
      + (CASE WHEN net_income / total_assets > net_income_prior / total_assets_prior THEN 1 ELSE 0 END) + (CASE WHEN cfo > net_income THEN 1 ELSE 0 END)
      + (CASE WHEN coalesce(long_term_debt, 0) / total_assets < coalesce(long_term_debt_prior, 0) / total_assets_prior THEN 1 ELSE 0 END)
      + (CASE WHEN current_assets / current_liabilities > current_assets_prior / current_liabilities_prior THEN 1 ELSE 0 END)
      + (CASE WHEN shares <= shares_prior THEN 1 ELSE 0 END)
      + (CASE WHEN gross_profit / revenue > gross_profit_prior / revenue_prior THEN 1 ELSE 0 END)
      + (CASE WHEN revenue / total_assets > revenue_prior / total_assets_prior THEN 1 ELSE 0 END)"""
_AT = ",\n         ".join(f"max(CASE WHEN age = 1 THEN {n} END) AS {n}, max(CASE WHEN age = 2 THEN {n} END) AS {n}_prior" for n in dt.LINES)
CANONICAL_SQL = f"""{dt.statements_sql()}, {dt.ASOFS_SQL}, {dt.PRICES_ASOF_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY report_date DESC) AS age
  FROM statements JOIN asofs ON publish_date <= as_of),
wide AS (
  SELECT ticker, sector, as_of, max(CASE WHEN age = 1 THEN report_date END) AS report_date, max(CASE WHEN age = 1 THEN publish_date END) AS publish_date,
         {_AT},
         stddev_samp(gross_profit / revenue) FILTER (WHERE revenue <> 0) AS gm_stability
  FROM ranked WHERE age <= 2 GROUP BY 1, 2, 3),
canon0 AS (
  SELECT w.*, price,
         CASE WHEN long_term_debt IS NULL AND short_term_debt IS NULL THEN NULL ELSE coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END AS total_debt,
         CASE WHEN long_term_debt_prior IS NULL AND short_term_debt_prior IS NULL THEN NULL ELSE coalesce(long_term_debt_prior, 0) + coalesce(short_term_debt_prior, 0) END AS total_debt_prior,
         ebit + depreciation AS ebitda, CASE WHEN -tax_expense / nullif(pretax, 0) < 0 THEN 0.0 WHEN -tax_expense / nullif(pretax, 0) > 0.6 THEN 0.6 ELSE -tax_expense / nullif(pretax, 0) END AS tax_rate,
         cfo + capex AS free_cash_flow, price * shares AS market_cap
  FROM wide w LEFT JOIN prices_asof USING (ticker, as_of)),
canonical AS (SELECT *, market_cap + coalesce(total_debt, 0) - coalesce(cash, 0) AS enterprise_value FROM canon0),
factored AS (
  SELECT *,
    CASE WHEN enterprise_value <> 0 AND ebit > 0 THEN enterprise_value / ebit END AS ev_ebit,
    CASE WHEN market_cap <> 0 AND free_cash_flow > 0 THEN market_cap / free_cash_flow END AS price_fcf,
    CASE WHEN coalesce(total_debt, 0) + equity - coalesce(cash, 0) > 0 THEN ebit * (1 - tax_rate) / (coalesce(total_debt, 0) + equity - coalesce(cash, 0)) END AS roic,
    CASE WHEN ebitda > 0 THEN (total_debt - cash) / ebitda END AS net_debt_ebitda,
    CASE WHEN total_assets > 0 THEN gross_profit / total_assets END AS gross_profitability,
    1.2 * (coalesce(current_assets, 0) - coalesce(current_liabilities, 0)) / total_assets + 1.4 * retained_earnings / total_assets + 3.3 * ebit / total_assets
      + 0.6 * market_cap / nullif(total_liabilities, 0) + revenue / total_assets AS altman_z,
    -4.84 + 0.92 * (receivables / revenue) / (receivables_prior / revenue_prior) + 0.528 * (gross_profit_prior / revenue_prior) / (gross_profit / revenue)
      + 0.404 * (1 - (current_assets + ppe) / total_assets) / (1 - (current_assets_prior + ppe_prior) / total_assets_prior)
      + 0.892 * revenue / revenue_prior + 0.115 * (depreciation_prior / (depreciation_prior + ppe_prior)) / (depreciation / (depreciation + ppe))
      - 0.172 * (sga / revenue) / (sga_prior / revenue_prior) + 4.679 * (net_income - cfo) / total_assets
      - 0.327 * ((total_debt + current_liabilities) / total_assets) / ((total_debt_prior + current_liabilities_prior) / total_assets_prior) AS beneish_m
  FROM canonical),
funnel AS (
  SELECT *, CASE WHEN market_cap IS NULL OR market_cap NOT BETWEEN 1e6 AND 1e7 THEN 'cap' WHEN sector IN ('AFRICA') THEN 'sector'
                 WHEN altman_z < 1.81 THEN 'altman_z' WHEN beneish_m > -1.78 THEN 'beneish_m' END AS drop_reason
  FROM factored)"""


def _ranks_sql(table: str, by: str, digits: int | None = None) -> str:
    """Average-tie percentiles of the five factors within ``by``, at ``digits`` decimals."""
    parts = []
    for f, low in fx.LOWER_BETTER.items():
        v = f if digits is None else f"round({f}, {digits}) + 0.0"
        order = f"{v} {'DESC' if low else 'ASC'}"
        parts.append(
            f"CASE WHEN {f} IS NOT NULL AND sector IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY {by}, {f} IS NULL ORDER BY {order})"
            f" + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0) / count({f}) OVER (PARTITION BY {by}) END AS {f}_pct"
        )
    names = list(fx.LOWER_BETTER)
    have = " + ".join(f"(CASE WHEN {f}_pct IS NULL THEN 0 ELSE 1 END)" for f in names)
    total = " + ".join(f"coalesce({f}_pct, 0) * 0.2" for f in names)
    return f"""{table}_r AS (SELECT *, {", ".join(parts)} FROM {table}),
{table}_c AS (SELECT *, {have} AS n_factors, CASE WHEN {have} >= 4 THEN ({total}) / (0.2 * ({have})) END AS composite FROM {table}_r)"""


def screens_sql(digits: int | None = None) -> tuple[str, str]:
    """The long and the short screen; with ``digits`` ranks are of values at so many decimals."""
    at = lambda v: v if digits is None else f"round({v}, {digits}) + 0.0"
    long = f"""{CANONICAL_SQL}, passed AS (SELECT * FROM funnel WHERE drop_reason IS NULL), {_ranks_sql("passed", "as_of, sector", digits)},
longs AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY {at('composite')} DESC NULLS LAST, ticker) AS place FROM passed_c)"""
    short = f"""{long}, pool AS (SELECT * FROM funnel WHERE drop_reason IS NULL OR drop_reason IN ('altman_z', 'beneish_m')), {_ranks_sql("pool", "as_of, sector", digits)},
legs0 AS (SELECT *, 100.0 - composite AS leg_value,
  CASE WHEN altman_z IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY as_of, altman_z IS NULL ORDER BY {at('altman_z')} DESC) + (count(*) OVER (PARTITION BY as_of, {at('altman_z')}) - 1) / 2.0) / count(altman_z) OVER (PARTITION BY as_of) END AS leg_z,
  CASE WHEN beneish_m IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY as_of, beneish_m IS NULL ORDER BY {at('beneish_m')}) + (count(*) OVER (PARTITION BY as_of, {at('beneish_m')}) - 1) / 2.0) / count(beneish_m) OVER (PARTITION BY as_of) END AS leg_m
  FROM pool_c),
shorts AS (SELECT *, (leg_value IS NOT NULL)::INT + (leg_z IS NOT NULL)::INT + (leg_m IS NOT NULL)::INT AS legs,
  (coalesce(leg_value, 0) + coalesce(leg_z, 0) + coalesce(leg_m, 0)) / nullif((leg_value IS NOT NULL)::INT + (leg_z IS NOT NULL)::INT + (leg_m IS NOT NULL)::INT, 0) AS score FROM legs0)"""
    return long, short


LONG_SQL, SHORT_SQL = screens_sql()
#: Decimals at which the screens compare values.  Sums of money differ beyond them by the order of their rows, so that companies of equal rows would be ranked by chance.
DIGITS = 7
LONG_TIED_SQL, SHORT_TIED_SQL = screens_sql(DIGITS)


def q_statements_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = pit.statements_asof(dt.statements(spark, sf_dir), dt.asofs(spark))
    return rounded(ranked.select("ticker", "as_of", F.col("age").cast("long").alias("age"), "report_date", "publish_date", "revenue", "total_assets"), 2)


def q_statements_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pit.statements_latest(dt.statements(spark, sf_dir)).select("ticker", F.col("age").cast("long").alias("age"), "report_date", "revenue"), 2)


def q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(canonical(spark, sf_dir).select("ticker", "as_of", "total_debt", "ebitda", "tax_rate", "free_cash_flow", "market_cap", "enterprise_value"), 2)


def q_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.with_factors(canonical(spark, sf_dir))
    x = x.withColumns({"gross_profitability": fx.gross_profitability(), "altman_z": fx.altman_z(), "beneish_m": fx.beneish_m(), "asset_growth": fx.asset_growth(), "net_issuance": fx.net_issuance()})
    return rounded(x.select("ticker", "as_of", *fx.ALL, "gross_profitability", "altman_z", "beneish_m", "asset_growth", "net_issuance"))


def q_fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The F-Score after a change of some lines by year, as the driver's ratios are equal in all years but for rounding."""
    year = lambda s: 1 + (F.year("report_date") - (1 if s else 0)) % 3 / 100.0
    x = canonical(spark, sf_dir)
    for s in ("", "_prior"):
        x = x.withColumns({f"{n}{s}": F.col(f"{n}{s}") * year(s) for n in ("long_term_debt", "current_assets", "revenue")})
    return x.select("ticker", "as_of", fx.piotroski().cast("long").alias("fscore"))


def q_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.screen_funnel(canonical(spark, sf_dir), LOW, HIGH, EXCLUDED)
    return x.groupBy("as_of", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_long_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.long_screen(canonical(spark, sf_dir), LOW, HIGH, EXCLUDED, digits=DIGITS)
    return rounded(x.select("as_of", "ticker", "sector", F.col("place").cast("long").alias("place"), "composite", *[f"{f}_pct" for f in fx.ALL]), 4)


def q_short_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.short_screen(canonical(spark, sf_dir), LOW, HIGH, EXCLUDED, digits=DIGITS)
    return rounded(x.select("as_of", "ticker", "leg_value", "leg_z", "leg_m", "legs", "score"), 4)


def q_long_short_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = canonical(spark, sf_dir)
    return rounded(ranking.long_short_book(ranking.long_screen(names, LOW, HIGH, EXCLUDED), ranking.short_screen(names, LOW, HIGH, EXCLUDED), 10))


def q_screen_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top names and the whole universe of each date, at equal weights."""
    x = ranking.long_screen(canonical(spark, sf_dir), LOW, HIGH, EXCLUDED).where("composite is not null")
    top = ranking.top_n(x, ("as_of",), "composite", n=10, key="ticker").select("as_of", "ticker", F.lit("top").alias("book"), "w")
    every = ranking.top_n(x, ("as_of",), "composite", share=1.0, key="ticker").select("as_of", "ticker", F.lit("universe").alias("book"), "w")
    return rounded(top.unionByName(every))


def q_basket_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.long_screen(canonical(spark, sf_dir), LOW, HIGH, EXCLUDED).where("place <= 10 and composite is not null").select("as_of", "ticker")
    day = lambda d: x.where(F.col("as_of") == F.lit(d).cast("date"))
    return ranking.basket_diff(day(dt.ASOFS[1]), day(dt.ASOFS[0]), key="ticker")


def q_pit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of point-in-time violations of the as-of selection: none."""
    ranked = pit.statements_asof(dt.statements(spark, sf_dir), dt.asofs(spark), keep=1)
    return pit.pit_violations(ranked).agg(F.count(F.lit(1)).alias("violations"))


def q_screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked table with a colour bucket by composite."""
    x = ranking.long_screen(canonical(spark, sf_dir), LOW, HIGH, EXCLUDED, digits=DIGITS).where("composite is not null")
    bucket = F.when(F.round("composite", DIGITS) >= 65, "high").when(F.round("composite", DIGITS) >= 40, "middle").otherwise("low")
    return rounded(x.select("as_of", "ticker", bucket.alias("bucket"), F.round("composite", 1).alias("composite"), *[F.round(f, 2).alias(f) for f in fx.ALL]), 2)


QUERIES = {
    "A6_statements_asof": q_statements_asof, "A7_statements_latest": q_statements_latest, "A8_canonical": q_canonical, "F11_factors": q_factors, "F9_piotroski": q_fscore,
    "Q14_funnel": q_funnel, "R3_long_screen": q_long_screen, "R4_short_screen": q_short_screen, "R8_long_short_book": q_long_short_book,
    "R9_screen_schedule": q_screen_schedule, "R7_basket_diff": q_basket_diff, "A20_pit_gate": q_pit_gate, "S19_screen_report": q_screen_report,
}
_PCTS = " ".join(f"{f}_pct" for f in fx.ALL)
_LONG_OUT = f"SELECT as_of, ticker, sector, place, {rounded_sql('composite ' + _PCTS, 4)} FROM longs"
SQL = {
    "A6_statements_asof": f"WITH {CANONICAL_SQL} SELECT ticker, as_of, age, report_date, publish_date, {rounded_sql('revenue total_assets', 2)} FROM ranked WHERE age <= 2",
    "A7_statements_latest": f"WITH {CANONICAL_SQL} SELECT ticker, age, report_date, {rounded_sql('revenue', 2)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC) AS age FROM statements) WHERE age <= 2",
    "A8_canonical": f"WITH {CANONICAL_SQL} SELECT ticker, as_of, {rounded_sql('total_debt ebitda tax_rate free_cash_flow market_cap enterprise_value', 2)} FROM canonical",
    "F11_factors": f"WITH {CANONICAL_SQL} SELECT ticker, as_of, {rounded_sql('ev_ebit price_fcf roic gm_stability net_debt_ebitda gross_profitability altman_z beneish_m')}, round(total_assets / total_assets_prior - 1, 6) + 0.0 AS asset_growth, round(shares / shares_prior - 1, 6) + 0.0 AS net_issuance FROM factored",
    "F9_piotroski": f"""WITH {CANONICAL_SQL}, y AS (SELECT * REPLACE (
  long_term_debt * (1 + year(report_date) % 3 / 100.0) AS long_term_debt, current_assets * (1 + year(report_date) % 3 / 100.0) AS current_assets, revenue * (1 + year(report_date) % 3 / 100.0) AS revenue,
  long_term_debt_prior * (1 + (year(report_date) - 1) % 3 / 100.0) AS long_term_debt_prior, current_assets_prior * (1 + (year(report_date) - 1) % 3 / 100.0) AS current_assets_prior, revenue_prior * (1 + (year(report_date) - 1) % 3 / 100.0) AS revenue_prior) FROM canonical)
SELECT ticker, as_of, CASE WHEN total_assets_prior IS NULL THEN NULL ELSE CAST({_FSCORE} AS BIGINT) END AS fscore FROM y""",
    "Q14_funnel": f"WITH {CANONICAL_SQL} SELECT as_of, coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM funnel GROUP BY 1, 2",
    "R3_long_screen": f"WITH {LONG_TIED_SQL} SELECT as_of, ticker, sector, place, {rounded_sql('composite ' + _PCTS, 4)} FROM longs",
    "R4_short_screen": f"WITH {SHORT_TIED_SQL} SELECT as_of, ticker, {rounded_sql('leg_value leg_z leg_m', 4)}, legs, {rounded_sql('score', 4)} FROM shorts",
    "R8_long_short_book": f"""WITH {SHORT_SQL}, a AS (SELECT as_of, ticker, 0.05 AS w FROM longs WHERE place <= 10 AND composite IS NOT NULL),
b AS (SELECT as_of, ticker, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS p FROM shorts s WHERE legs >= 2 AND NOT EXISTS (SELECT 1 FROM a WHERE a.as_of = s.as_of AND a.ticker = s.ticker))
SELECT as_of, ticker, CAST(w AS DOUBLE) AS w FROM a UNION ALL SELECT as_of, ticker, CAST(-0.05 AS DOUBLE) FROM b WHERE p <= 10""",
    "R9_screen_schedule": f"""WITH {LONG_SQL}, x AS (SELECT *, count(*) OVER (PARTITION BY as_of) AS n FROM longs WHERE composite IS NOT NULL)
SELECT as_of, ticker, 'top' AS book, round(1.0 / least(n, 10), 6) + 0.0 AS w FROM x WHERE place <= 10 UNION ALL SELECT as_of, ticker, 'universe', round(1.0 / n, 6) + 0.0 FROM x""",
    "R7_basket_diff": f"""WITH {LONG_SQL}, x AS (SELECT as_of, ticker FROM longs WHERE place <= 10 AND composite IS NOT NULL),
a AS (SELECT ticker FROM x WHERE as_of = DATE '1998-06-30'), b AS (SELECT ticker FROM x WHERE as_of = DATE '1997-06-30')
SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN b.ticker IS NULL THEN 'added' WHEN a.ticker IS NULL THEN 'dropped' ELSE 'held' END AS status FROM a FULL OUTER JOIN b ON a.ticker = b.ticker""",
    "A20_pit_gate": f"WITH {CANONICAL_SQL}, s AS (SELECT *, lag(report_date) OVER (PARTITION BY ticker ORDER BY as_of) AS before FROM ranked WHERE age = 1) SELECT count(*) AS violations FROM s WHERE publish_date > as_of OR report_date < before",
    "S19_screen_report": f"WITH {LONG_TIED_SQL} SELECT as_of, ticker, CASE WHEN round(composite, {DIGITS}) >= 65 THEN 'high' WHEN round(composite, {DIGITS}) >= 40 THEN 'middle' ELSE 'low' END AS bucket, round(round(composite, 1), 2) + 0.0 AS composite, {rounded_sql(' '.join(fx.ALL), 2)} FROM longs WHERE composite IS NOT NULL",
}
