"""Known answers, identities and look-ahead checks of the analytics operators."""

import datetime as dtm
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.functions import factors as fx
from asofspark.operators import filings, metrics, panel, quality, ranking, research, scoring, timeseries, weights
from asofspark.sources import sinks
from asofspark.streaming import fills as streaming

DAY = dtm.date(2020, 1, 6)
day = lambda k: DAY + dtm.timedelta(days=k)


def curve(spark, values, step=1):
    return spark.createDataFrame([("r", day(k * step), float(v)) for k, v in enumerate(values)], "run_id string, dt date, equity double")


def bars(spark, closes: dict):
    rows = [(s, day(k), float(c), float(c), float(c), float(c), 1.0) for s, xs in closes.items() for k, c in enumerate(xs) if c is not None]
    return spark.createDataFrame(rows, sinks.BAR_SCHEMA)


def names(spark, **fields):
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double'}" for k, v in fields.items()))


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def underwater(values):
    """Longest stretch from a peak to the first row that reaches it again, or to the end."""
    best, peak, since = 0, values[0], 0
    for k, v in enumerate(values):
        if v >= peak:
            best, peak, since = max(best, k - since if k - since > 1 else 0), v, k
        else:
            best = max(best, k - since)
    return best


def test_metrics_against_plain_versions(spark):
    days = (dtm.date(2023, 3, 1) - dtm.date(2020, 1, 1)).days
    one = metrics.summary(spark.createDataFrame([("r", dtm.date(2020, 1, 1), 80.0), ("r", dtm.date(2023, 3, 1), 170.0)], "run_id string, dt date, equity double")).first()
    assert one["cagr"] == pytest.approx((170 / 80) ** (365.25 / days) - 1, abs=1e-9)
    for values in ([50, 70, 35, 42, 80, 60], [9, 8, 7.5, 8.2, 9.5, 9.1, 9.4, 9.6], [5, 4, 3]):
        worst = min(v / max(values[: k + 1]) - 1 for k, v in enumerate(values))
        assert metrics.summary(curve(spark, values)).first()["max_drawdown"] == pytest.approx(worst)
        assert metrics.underwater_days(curve(spark, values)).first()["max_dd_days"] == underwater(values)
    flat = metrics.summary(curve(spark, [100, 100, 100])).first()
    assert flat["sharpe"] is None and flat["sortino"] is None
    r = np.array([0.01, -0.02, 0.01, 0.01])
    got = metrics.summary(curve(spark, [100, *np.cumprod(1 + r) * 100])).first()
    assert got["sortino"] == pytest.approx(r.mean() / math.sqrt((np.minimum(r, 0) ** 2).mean()) * math.sqrt(252))


def test_factors_against_plain_versions(spark):
    assert value(names(spark, enterprise_value=630.0, ebit=90.0), fx.ev_ebit()) == 630 / 90
    assert value(names(spark, enterprise_value=630.0, ebit=0.0), fx.ev_ebit()) is None
    assert value(names(spark, market_cap=700.0, free_cash_flow=-20.0), fx.price_fcf()) is None
    assert value(names(spark, ebit=80.0, tax_rate=0.2, total_debt=150.0, equity=350.0, cash=60.0), fx.roic()) == pytest.approx(80 * 0.8 / (150 + 350 - 60))
    assert value(names(spark, total_debt=310.0, cash=70.0, ebitda=160.0), fx.net_debt_ebitda()) == 240 / 160
    gm = names(spark, revenue_history=[1000.0, 1000.0], gross_profit_history=[400.0, 300.0])
    assert value(gm, fx.gm_stability()) == pytest.approx(np.std([0.4, 0.3], ddof=1))
    assert value(names(spark, revenue_history=[1000.0], gross_profit_history=[400.0]), fx.gm_stability()) is None
    z = names(spark, total_assets=900.0, total_liabilities=310.0, current_assets=420.0, current_liabilities=170.0, retained_earnings=260.0, ebit=120.0, market_cap=1700.0, revenue=1100.0)
    assert value(z, fx.altman_z()) == pytest.approx(1.2 * 250 / 900 + 1.4 * 260 / 900 + 3.3 * 120 / 900 + 0.6 * 1700 / 310 + 1100 / 900)


def test_percent_rank_ties_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 5.0)], "k string, v double")
    got = {r["k"]: r["p"] for r in df.withColumn("p", ranking.pct_rank("v")).collect()}
    assert got == {"a": 25.0, "b": 62.5, "c": 62.5, "d": None, "e": 100.0}


def test_panel_pads_gaps_and_counts_calendar_rows(spark):
    p = panel.panel(bars(spark, {"A": [1, 2, None, 4, 5], "B": [None, 1, 1, 1, None]}))
    got = {(r["symbol"], r["idx"]): (r["px"], r["ret"]) for r in p.collect()}
    assert got["A", 2] == (2.0, 0.0) and got["A", 3] == (4.0, 1.0) and ("B", 0) not in got and got["B", 4] == (1.0, 0.0)
    mom = {r["idx"]: r["m"] for r in p.where("symbol = 'A'").withColumn("m", timeseries.momentum(1, 2)).collect()}
    assert mom[3] == pytest.approx(1.0) and mom[4] == pytest.approx(1.0) and mom[2] is None


def test_corrupting_the_future_changes_nothing_before_it(spark):
    rng = np.random.default_rng(0)
    base = {s: list(np.cumprod(1 + rng.normal(0, 0.02, 60)) * 100) for s in "AB"}
    after = {s: xs[:40] + [x * 9 for x in xs[40:]] for s, xs in base.items()}
    ops = [
        lambda p: p.withColumn("v", timeseries.sma_cross(3, 10)), lambda p: p.withColumn("v", timeseries.momentum(2, 10)), lambda p: p.withColumn("v", timeseries.rolling_vol(10)),
        lambda p: timeseries.trend_strength(p, (3, 7)).withColumn("v", F.col("strength")), lambda p: timeseries.vol_managed(p, 0.2, 10).withColumn("v", F.col("growth")),
        lambda p: timeseries.dynamic_leverage(p, 5, 10, 3).withColumn("v", F.col("leverage")), lambda p: timeseries.market_regime(p, 10).withColumn("v", F.col("risk_on")),
    ]
    for op in ops:
        a, b = ({(r["symbol"], r["idx"]): r["v"] for r in op(panel.panel(bars(spark, x))).collect() if r["idx"] < 40} for x in (base, after))
        assert a == b and len(a) == 80


def test_locks(spark):
    lock = lambda d, **w: [("b", d, s, v, 100.0) for s, v in w.items()]
    d = [dtm.date(2026, 1, 2), dtm.date(2026, 2, 2), dtm.date(2026, 3, 2)]
    prices = spark.createDataFrame([(s, x, 100.0) for s in "AB" for x in d], "symbol string, dt date, px double")
    schema = "book string, lock_date date, symbol string, w double, price double"
    one = scoring.score_locks(spark.createDataFrame(lock(d[0], A=1.0), schema), prices, 10.0).first()
    assert one["value"] == pytest.approx(9990) and one["turnover"] == 1
    same = scoring.score_locks(spark.createDataFrame(lock(d[0], A=0.5, B=0.5) + lock(d[1], A=0.5, B=0.5), schema), prices, 10.0).orderBy("k").collect()
    assert same[1]["turnover"] == pytest.approx(0) and same[1]["cum_cost"] == pytest.approx(0.001)
    swap = scoring.score_locks(spark.createDataFrame(lock(d[0], A=1.0) + lock(d[1], B=1.0), schema), prices, 10.0).orderBy("k").collect()
    assert swap[1]["turnover"] == pytest.approx(2) and swap[1]["value"] == pytest.approx(10000 * 0.999 * 0.998)


def test_signal_curve_folds_like_a_bar_loop(spark):
    rng = np.random.default_rng(3)
    o, c, s = rng.uniform(90, 110, 40), rng.uniform(90, 110, 40), rng.integers(0, 2, 40).astype(float)
    rows = [("r", k, day(k), float(o[k]), float(c[k]), float(s[k])) for k in range(40)]
    df = spark.createDataFrame(rows, "run_id string, idx long, dt date, open double, close double, signal double")
    cash, shares, want = 10_000.0, 0.0, []
    for k in range(40):
        cash *= 1 + 0.03 / 252
        if k:
            equity = cash + shares * o[k]
            new = equity * s[k - 1] / o[k]
            cash -= (new - shares) * o[k] + abs(new - shares) * o[k] * 5e-4
            shares = new
        want.append(cash + shares * c[k])
    got = [r["equity"] for r in scoring.signal_curve(df, 5.0, 0.03).orderBy("idx").collect()]
    assert np.allclose(got, want, rtol=1e-9)
    free = [r["equity"] for r in scoring.signal_curve_free(df).orderBy("idx").collect()]
    assert np.allclose(free, [r["equity"] for r in scoring.signal_curve(df, 0.0, 0.0).orderBy("idx").collect()])


def test_schedule_curve_is_the_bar_loop_between_rebalances(spark):
    px = {"A": [100, 110, 121, 133.1], "B": [100, 90, 99, 99]}
    prices = spark.createDataFrame([(s, k, float(p)) for s, xs in px.items() for k, p in enumerate(xs)], "symbol string, idx long, px double")
    plan = [("r", 0, "A", 0.5), ("r", 0, "B", 0.3), ("r", 2, "A", 0.2), ("r", 2, "B", 0.6)]
    got = scoring.schedule_curve(spark.createDataFrame(plan, "run_id string, mark long, symbol string, w double"), prices, 10.0).orderBy("mark").collect()
    equity = 10_000 * (1 - 0.8 * 0.001)
    assert got[0]["equity"] == pytest.approx(equity) and got[0]["turnover"] == pytest.approx(0.8)
    growth = 0.5 * 1.21 + 0.3 * 0.99 + 0.2
    turn = abs(0.2 - 0.5 * 1.21 / growth) + abs(0.6 - 0.3 * 0.99 / growth)
    assert got[1]["turnover"] == pytest.approx(turn) and got[1]["equity"] == pytest.approx(equity * growth * (1 - turn * 0.001))


def test_lots_take_the_dearest_first(spark):
    rows = [("a", "2025-01-10", "BUY", "X", 10.0, 1000.0, 1), ("a", "2026-06-01", "BUY", "X", 10.0, 1500.0, 2), ("a", "2026-07-01", "SELL", "X", 5.0, 800.0, 3), ("a", "2026-07-02", "SELL", "X", 99.0, 990.0, 4)]
    df = spark.createDataFrame(rows, "account string, date string, side string, ticker string, shares double, dollars double, seq long").withColumn("date", F.col("date").cast("date"))
    got = scoring.lots_hifo(df).collect()
    first = [r for r in got if r["kind"] == "realized"][0]
    assert (first["basis"], first["gain"], first["term"]) == (750.0, 50.0, "ST")
    assert sorted(r["term"] for r in got if r["kind"] == "realized") == ["LT", "ST", "ST"] and [r["shares"] for r in got if r["kind"] == "oversold"] == [84.0]


def test_bands_and_hrp(spark):
    cur = spark.createDataFrame([("U", 0.43), ("I", 0.20), ("T", 0.115), ("G", 0.04)], "symbol string, w double")
    tgt = spark.createDataFrame([("U", 0.40), ("I", 0.202), ("E", 0.17)], "symbol string, w double")
    got = {r["symbol"]: round(r["trade"], 6) for r in weights.band_trades(cur, tgt, 0.1).collect()}
    assert got == {"U": 0.0, "I": 0.0, "T": -0.115, "G": -0.04, "E": 0.153}
    cov = spark.createDataFrame([(1, "A", "A", 0.04), (1, "A", "B", 0.0), (1, "B", "B", 0.01)], "mark long, a string, b string, cov double")
    hrp = {r["symbol"]: r["w"] for r in weights.hrp_weights(cov).collect()}
    assert hrp["A"] == pytest.approx(0.2) and hrp["B"] == pytest.approx(0.8)


def test_pair_positions(spark):
    z = [0.0, 2.5, 1.0, 0.2, -2.1, None, -5.0, -1.0]
    df = spark.createDataFrame([("p", k, v) for k, v in enumerate(z)], "pair string, idx long, z double")
    got = [r["position"] for r in weights.pair_positions(df, 2.0, 0.5, 4.0).orderBy("idx").collect()]
    assert got == [0, -1, -1, 0, 1, 1, 0, 0]


def test_adf_and_fama_macbeth_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    s = [0.0]
    for e in rng.normal(size=300):
        s.append(0.9 * s[-1] + e)
    got = research.adf_tstat(spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(s)], "k string, i long, s double"), "k", "s", "i").first()
    s = np.array(s)
    d = np.diff(s)
    x, y = np.column_stack([np.ones(len(d) - 1), s[1:-1], d[:-1]]), d[1:]
    b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    t = b[1] / math.sqrt(rss[0] / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["adf_t"] == pytest.approx(t)
    rows = [(day(k), f"n{j}", f, float(v), float(w)) for k in range(3) for j in range(30) for w in [rng.random()] for f, v in (("f1", rng.random()), ("f2", rng.random()))]
    df = spark.createDataFrame(rows, "date date, name string, factor string, pct double, fwd_pct double")
    got = {r["factor"]: r["coef"] for r in research.fama_macbeth(df, ["f1", "f2"]).collect()}
    want = []
    for k in range(3):
        part = {n: ({f: p for d2, n2, f, p, _ in rows if d2 == day(k) and n2 == n}, next(w for d2, n2, _, _, w in rows if d2 == day(k) and n2 == n)) for n in {r[1] for r in rows}}
        x = np.array([[1, v["f1"], v["f2"]] for v, _ in part.values()])
        want.append(np.linalg.lstsq(x, np.array([w for _, w in part.values()]), rcond=None)[0][1:])
    assert np.allclose([got["f1"], got["f2"]], np.mean(want, axis=0))


def test_luck(spark):
    stats = spark.createDataFrame([("r", 500, 0.05, 0.0, 3.0)], "run_id string, n long, sharpe double, skew double, kurtosis double")
    assert research.psr(stats, 0.05).first()["psr"] == pytest.approx(0.5)
    luck = [r["x"] for r in spark.createDataFrame([(1, 1), (2, 10), (3, 100)], "k int, n long").select("k", research.expected_max_sharpe(F.lit(0.01), F.col("n")).alias("x")).orderBy("k").collect()]
    assert luck[0] is None and luck[1] < luck[2]


def test_filings_earliest_wins(spark):
    row = lambda tag, pos, start, filed, val, form="10-K", fp="FY": ("c", tag, 0, pos, start, "2020-12-31", filed, val, form, fp)
    rows = [row("b", 0, "2020-01-01", "2021-02-01", 1.0), row("a", 0, "2020-01-01", "2021-03-01", 2.0), row("a", 1, "2020-10-01", "2021-01-01", 3.0), row("a", 2, "2020-01-01", "2021-01-05", 4.0, "10-Q"), row("b", 1, "2020-01-01", "2021-06-01", 5.0, "10-K/A"), row("i", 0, None, "2021-02-01", 6.0)]
    df = spark.createDataFrame(rows, "cik string, tag string, unit_pos int, arr_pos int, start string, end string, filed string, val double, form string, fp string").withColumns({c: F.col(c).cast("date") for c in ("start", "end", "filed")})
    tags = spark.createDataFrame([("x", "a", 0), ("x", "b", 1), ("y", "i", 0)], "field string, tag string, prio int")
    assert {(r["field"], r["val"]) for r in filings.annual_facts(df, tags).collect()} == {("x", 1.0), ("y", 6.0)}


def test_bar_contract(spark):
    good = bars(spark, {"A": [1, 2, 3]})
    assert quality.validate_bars(good).count() == 0 and quality.raise_if_any(quality.validate_bars(good)).count() == 0
    bad = good.unionByName(good.limit(1)).unionByName(spark.createDataFrame([("B", day(1), 1.0, 0.5, 1.0, -1.0, 1.0), ("B", day(2), None, 1.0, 1.0, 1.0, 1.0)], sinks.BAR_SCHEMA))
    assert {r["rule"] for r in quality.validate_bars(bad).collect()} == {"repeated date", "high below low", "not positive", "missing"}
    with pytest.raises(ValueError):
        quality.raise_if_any(quality.validate_bars(bad))


def test_sinks_and_stream(spark, tmp_path):
    lock = spark.createDataFrame([("b", dtm.date(2026, 1, 2), "A", 1.0, 100.0)], "book string, lock_date date, symbol string, w double, price double")
    sinks.write_lock(lock, f"{tmp_path}/locks")
    with pytest.raises(ValueError):
        sinks.write_lock(lock.withColumn("lock_date", F.lit("2026-01-30").cast("date")), f"{tmp_path}/locks")
    fills = spark.createDataFrame([("a", dtm.date(2026, 1, 2), "BUY", "X", 1.0, 10.0, ""), ("a", dtm.date(2026, 1, 1), "SELL", "X", 1.0, 10.0, "")], sinks.FILL_SCHEMA)
    sinks.append_fills(fills, f"{tmp_path}/fills")
    with pytest.raises(ValueError):
        sinks.append_fills(fills.withColumn("side", F.lit("HOLD")), f"{tmp_path}/fills")
    assert [r["side"] for r in sinks.read_fills(spark, f"{tmp_path}/fills").collect()] == ["SELL", "BUY"]
    streaming.land(streaming.stream_fills(spark, f"{tmp_path}/fills"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    (tmp_path / "wide.csv").write_text("Date,A,B\n2020-01-01,1.5,\n2020-01-02,NaN,2\n")
    assert {tuple(r) for r in sinks.read_panel(spark, f"{tmp_path}/wide.csv", "close").collect()} == {("A", dtm.date(2020, 1, 1), 1.5), ("B", dtm.date(2020, 1, 2), 2.0)}
    (tmp_path / "names.txt").write_text(" brk.b \n\nabc\n")
    assert {r["symbol"] for r in sinks.read_constituents(spark, f"{tmp_path}/names.txt").collect()} == {"BRK-B", "ABC"}
    (tmp_path / "map.json").write_text('{"0": {"ticker": "abc", "cik_str": 42}}')
    assert tuple(sinks.read_ticker_map(spark, f"{tmp_path}/map.json").first()) == ("ABC", "0000000042")
    (tmp_path / "facts.json").write_text('{"cik": "1", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2020-12-31", "filed": "2021-02-01", "val": 5.0, "form": "10-K", "fp": "FY"}]}}}}}')
    got = filings.read_facts(spark, f"{tmp_path}/facts.json").first()
    assert (got["tag"], got["unit"], got["val"], got["start"]) == ("Assets", "USD", 5.0, None)
