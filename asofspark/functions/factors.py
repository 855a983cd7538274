"""Fundamental factors as column expressions; a missing or invalid input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def _per(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ev_ebit() -> Column:
    """EV / EBIT where EV is not 0 and EBIT is positive."""
    return F.when((c("enterprise_value") != 0) & (c("ebit") > 0), _per(c("enterprise_value"), c("ebit")))


def price_fcf() -> Column:
    return F.when((c("market_cap") != 0) & (c("free_cash_flow") > 0), _per(c("market_cap"), c("free_cash_flow")))


def roic() -> Column:
    """After-tax EBIT over debt + equity - cash (debt and cash: 0 if missing), where that is positive."""
    base = F.coalesce("total_debt", F.lit(0.0)) + c("equity") - F.coalesce("cash", F.lit(0.0))
    return F.when(base > 0, _per(c("ebit") * (1 - c("tax_rate")), base))


def gm_stability() -> Column:
    """Sample deviation of the gross margins of the common years with revenue; two at least."""
    n = F.least(F.size("revenue_history"), F.size("gross_profit_history"))
    both = F.arrays_zip(F.slice("revenue_history", 1, n).alias("r"), F.slice("gross_profit_history", 1, n).alias("g"))
    margins = F.filter(F.transform(both, lambda x: _per(x["g"], x["r"])), lambda m: m.isNotNull())
    k = F.size(margins)
    add = lambda a, x: a + x
    mean = F.aggregate(margins, F.lit(0.0), add) / k
    squares = F.aggregate(F.transform(margins, lambda m: (m - mean) * (m - mean)), F.lit(0.0), add)
    return F.when(k >= 2, F.sqrt(squares / (k - 1)))


def net_debt_ebitda() -> Column:
    return F.when(c("ebitda") > 0, _per(c("total_debt") - c("cash"), c("ebitda")))


def gross_profitability() -> Column:
    return F.when(c("total_assets") > 0, _per(c("gross_profit"), c("total_assets")))


def altman_z() -> Column:
    """1.2 WC/TA + 1.4 RE/TA + 3.3 EBIT/TA + 0.6 cap/TL + sales/TA; missing working capital parts count 0."""
    ta = c("total_assets")
    working = F.coalesce("current_assets", F.lit(0.0)) - F.coalesce("current_liabilities", F.lit(0.0))
    return 1.2 * _per(working, ta) + 1.4 * _per(c("retained_earnings"), ta) + 3.3 * _per(c("ebit"), ta) + 0.6 * _per(c("market_cap"), c("total_liabilities")) + _per(c("revenue"), ta)


def altman_zone(z: Column) -> Column:
    return F.when(z < 1.81, "distress").when(z < 2.99, "grey").when(z.isNotNull(), "safe")


def beneish_m() -> Column:
    """Eight-variable manipulation score of this and the prior year (columns with suffix _prior)."""

    def both(f):  # the same ratio in both years
        return f(""), f("_prior")

    dsr, dsr0 = both(lambda s: _per(c(f"receivables{s}"), c(f"revenue{s}")))
    gm, gm0 = both(lambda s: _per(c(f"gross_profit{s}"), c(f"revenue{s}")))
    soft, soft0 = both(lambda s: 1 - _per(c(f"current_assets{s}") + c(f"ppe{s}") + F.coalesce(f"securities{s}", F.lit(0.0)), c(f"total_assets{s}")))
    dep, dep0 = both(lambda s: _per(c(f"depreciation{s}"), c(f"depreciation{s}") + c(f"ppe{s}")))
    sga, sga0 = both(lambda s: _per(c(f"sga{s}"), c(f"revenue{s}")))
    lev, lev0 = both(lambda s: _per(c(f"total_debt{s}") + c(f"current_liabilities{s}"), c(f"total_assets{s}")))
    accruals = _per(c("income_continuing") - c("cfo"), c("total_assets"))
    return (
        -4.84 + 0.920 * _per(dsr, dsr0) + 0.528 * _per(gm0, gm) + 0.404 * _per(soft, soft0) + 0.892 * _per(c("revenue"), c("revenue_prior"))
        + 0.115 * _per(dep0, dep) - 0.172 * _per(sga, sga0) + 4.679 * accruals - 0.327 * _per(lev, lev0)
    )


def piotroski() -> Column:
    """Nine signals of this year against the prior one; long-term debt counts 0 if missing, missing shares give no point."""
    roa, roa0 = _per(c("net_income"), c("total_assets")), _per(c("net_income_prior"), c("total_assets_prior"))
    debt, debt0 = (_per(F.coalesce(f"long_term_debt{s}", F.lit(0.0)), c(f"total_assets{s}")) for s in ("", "_prior"))
    current, current0 = (_per(c(f"current_assets{s}"), c(f"current_liabilities{s}")) for s in ("", "_prior"))
    margin, margin0 = (_per(c(f"gross_profit{s}"), c(f"revenue{s}")) for s in ("", "_prior"))
    turn, turn0 = (_per(c(f"revenue{s}"), c(f"total_assets{s}")) for s in ("", "_prior"))
    signals = [roa > 0, c("cfo") > 0, roa > roa0, c("cfo") > c("net_income"), debt < debt0, current > current0, margin > margin0, turn > turn0]
    total = F.coalesce((c("shares") <= c("shares_prior")).cast("int"), F.lit(0))
    for s in signals:
        total = total + s.cast("int")
    return total


def asset_growth() -> Column:
    return _per(c("total_assets"), c("total_assets_prior")) - 1


def net_issuance() -> Column:
    return _per(c("shares"), c("shares_prior")) - 1


#: The five ranked factors, and whether less is better.
LOWER_BETTER = {"ev_ebit": True, "price_fcf": True, "roic": False, "gm_stability": True, "net_debt_ebitda": True}
ALL = {
    "ev_ebit": ev_ebit, "price_fcf": price_fcf, "roic": roic, "gm_stability": gm_stability, "net_debt_ebitda": net_debt_ebitda,
}
