"""Companies whose sums differ by the order of their rows only are tied."""

from asofspark.operators import ranking


def test_composite_ties_equal_companies(spark):
    rows = [(f"S{k}", "x", "d", *[1.0 + v + k * 1e-15 for _ in range(5)], v + k * 1e-15) for k, v in enumerate((0.3, 0.3, 0.1, 0.1, 0.7))]
    names = spark.createDataFrame(rows, "ticker string, sector string, as_of string, ev_ebit double, price_fcf double, roic double, gm_stability double, net_debt_ebitda double, altman_z double")
    got = {r["ticker"]: r for r in ranking.composite(names, ranking.WEIGHTS, digits=7).collect()}
    assert got["S0"]["roic_pct"] == got["S1"]["roic_pct"] == 70.0 and got["S2"]["ev_ebit_pct"] == got["S3"]["ev_ebit_pct"] == 90.0
    assert got["S0"]["composite"] == got["S1"]["composite"] and got["S4"]["roic_pct"] == 100.0
    legs = {r["ticker"]: r["leg_z"] for r in ranking.ranked(names, {"leg_z": ("altman_z", False)}, ("as_of",), 7).collect()}
    assert legs == {"S0": 50.0, "S1": 50.0, "S2": 90.0, "S3": 90.0, "S4": 20.0}
