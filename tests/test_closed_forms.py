"""Windows and joins that stand for bar loops, against the loops; and refusals."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.operators import asof as pit
from asofspark.operators import books as bk
from asofspark.operators import observations as ob
from asofspark.operators import quality as qu
from asofspark.operators import research as rs
from asofspark.operators import scoring as sc
from asofspark.operators import weights as wt

DAY = datetime.date(2020, 1, 1)


def test_signal_curve_is_the_bar_loop(spark):
    rng = random.Random(1)
    rows = []
    for run in "ab":
        px = 100.0
        for k in range(300):
            o = px * (1 + rng.uniform(-0.1, 0.1))
            px = o * (1 + rng.uniform(-0.1, 0.1))
            rows.append((run, k, DAY + datetime.timedelta(days=k), o, px, rng.choice([0.0, 0.0, 1.0, 0.4])))
    table = spark.createDataFrame(rows, "run_id string, idx long, dt date, open double, close double, signal double")
    got = {(r["run_id"], r["idx"]): r["equity"] for r in sc.signal_curve(table, 30.0, 0.05).collect()}
    for run in "ab":
        cash, shares, last = 10_000.0, 0.0, 0.0
        for _, k, _, o, c, s in [r for r in rows if r[0] == run]:
            cash *= 1 + 0.05 / 252
            want = (cash + shares * o) * last / o
            cash -= (want - shares) * o + abs(want - shares) * o * 0.003
            shares, last = want, s
            assert got[run, k] == pytest.approx(cash + shares * c, rel=1e-8)


def test_schedule_curve_is_the_rebalance_loop(spark):
    rng = random.Random(2)
    px = {(s, k): 50 + 10 * rng.random() + k * rng.uniform(-0.3, 0.3) for s in "xyz" for k in range(0, 101)}
    px.pop(("z", 40))  # stands still into and out of that mark
    weights = [("r", m, s, rng.uniform(-0.6, 1.2)) for m in range(0, 101, 20) for s in "xyz" if rng.random() < 0.8]
    rates = [(k, rng.random() * 0.05) for k in range(101)]
    args = {"cost_bps": 20.0, "financing": 0.02, "borrow_bps": 80.0, "rows_a_year": 50.0}
    w = spark.createDataFrame(weights, "run_id string, mark long, symbol string, w double")
    p = spark.createDataFrame([(s, k, v) for (s, k), v in px.items()], "symbol string, idx long, px double")
    r = spark.createDataFrame(rates, "idx long, rf double")
    got = {x["mark"]: (x["equity"], x["turnover"]) for x in sc.schedule_curve(w, p, rates=r, **args).collect()}
    value, held, marks = 10_000.0, {}, sorted({m for _, m, _, _ in weights})
    for k, m in enumerate(marks):
        want = {s: x for _, n, s, x in weights if n == m}
        turn = sum(abs(want.get(s, 0) - held.get(s, 0)) for s in "xyz")
        value *= 1 - turn * 0.002
        assert got[m] == pytest.approx((value, turn), rel=1e-9)
        if k + 1 == len(marks):
            break
        end = marks[k + 1]
        grown = {s: x * (px[s, end] / px[s, m] if (s, end) in px and (s, m) in px else 1) for s, x in want.items()}
        cash, years = 1 - sum(want.values()), (end - m) / 50
        interest = sum(v for i, v in rates if m < i <= end) / 50 + (0.02 * years if cash < 0 else 0)
        total = sum(grown.values()) + cash * (1 + interest) - sum(max(-x, 0) for x in want.values()) * years * 0.008
        held = {s: v / total for s, v in grown.items()}
        value *= total


def test_pair_positions_are_the_state_machine(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", k, None if rng.random() < 0.05 else rng.choice([0.1, 0.4, 1.0, 1.8, 2.5, 4.5, 5.0]) * rng.choice([-1, 1])) for p in range(6) for k in range(400)]
    got = {(r["pair"], r["idx"]): r["position"] for r in wt.pair_positions(spark.createDataFrame(rows, "pair string, idx long, z double"), 1.5, 0.3, 4.0).collect()}
    state = {}
    for pair, k, z in rows:
        now = state.get(pair, 0)
        if z is not None:
            if now == 0:
                now = (-1 if z > 0 else 1) if abs(z) > 1.5 else 0
            elif abs(z) < 0.3 or abs(z) > 4.0:
                now = 0
        state[pair] = now
        assert got[pair, k] == now


def test_tree_order_and_weights():
    """The order of joining nearest clusters, and halving by inverse-variance risk, on random matrices."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 20):
        x = rng.normal(size=(50, n)) @ rng.normal(size=(n, n))
        cov = np.atleast_2d(np.cov(x.T))
        dist = np.sqrt(np.maximum(0.5 - 0.5 * np.atleast_2d(np.corrcoef(x.T)), 0))
        groups = [[k] for k in range(n)]
        while len(groups) > 1:
            near = {(dist[np.ix_(a, b)].min(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
            _, i, j = min(near)
            groups.append(groups[i] + groups[j])
            del groups[j], groups[i]
        order = wt.spanning_order(dist)
        assert list(order) == groups[0]
        part = cov[np.ix_(order, order)]

        def weights(a, b, part=part):
            if b - a == 1:
                return [1.0]
            m = a + (b - a) // 2
            risk = []
            for i, j in ((a, m), (m, b)):
                v = 1 / np.diag(part)[i:j]
                risk.append(v @ part[i:j, i:j] @ v / v.sum() ** 2)
            share = 1 - risk[0] / sum(risk)
            return [share * x for x in weights(a, m)] + [(1 - share) * x for x in weights(m, b)]

        assert np.allclose(wt.bisection_weights(part), weights(0, n))


def test_statements_asof_with_late_publication(spark):
    rng = random.Random(5)
    day = lambda k: DAY + datetime.timedelta(days=k)
    rows = [(t, day(90 * k), None if rng.random() < 0.1 else day(90 * k + rng.randint(10, 400))) for t in "ab" for k in range(20)]
    dates = [(day(k),) for k in range(0, 2200, 71)]
    for keep in (1, 2, 3):
        got = {tuple(r) for r in pit.statements_asof(spark.createDataFrame(rows, "ticker string, report_date date, publish_date date"), spark.createDataFrame(dates, "as_of date"), keep).select("ticker", "as_of", "age", "report_date").collect()}
        want = set()
        for t in "ab":
            for (d,) in dates:
                known = sorted((r for u, r, p in rows if u == t and p is not None and p <= d), reverse=True)
                want |= {(t, d, k + 1, r) for k, r in enumerate(known[:keep])}
        assert got == want


def test_forward_joins(spark):
    rng = random.Random(6)
    prices = [(s, DAY + datetime.timedelta(days=k), rng.random() + 1) for s in "ab" for k in range(0, 200, rng.randint(3, 5))]
    picks = [(DAY + datetime.timedelta(days=k), s, v) for k in range(0, 230, 17) for s, v in (("a", 2.0), ("b", -1.0), ("c", 3.0))]
    got = {(r["lock_date"], r["symbol"]): r["entry"] for r in bk.entry_prices(spark.createDataFrame(picks, "lock_date date, symbol string, price double"), spark.createDataFrame(prices, "symbol string, dt date, px double")).collect()}
    for d, s, v in picks:
        later = [x for t, e, x in sorted(prices) if t == s and e >= d]
        assert got[d, s] == (later[0] if later else v if v > 0 else None)
    curve = [(DAY + datetime.timedelta(days=3 * k), 100.0 + k) for k in range(30)]
    flows = [(DAY + datetime.timedelta(days=k), 10.0) for k in (0, 1, 44, 500)]
    twin = sc.twin_value(spark.createDataFrame(flows, "dt date, amount double"), spark.createDataFrame(curve, "dt date, equity double")).first()[0]
    assert twin == pytest.approx(sum(10.0 * 129 / next(e for x, e in curve if x >= d) for d, _ in flows[:3]))


def test_normal_functions(spark):
    from statistics import NormalDist

    xs = [-40.0, -8.0, -5.0, -1.5, 0.0, 0.3, 2.0, 6.5, 9.0]
    got = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select(rs.normal_cdf(F.col("x"))).collect()
    assert [r[0] for r in got[:-1]] == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-12) and got[-1][0] is None
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(rs.inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_refusals(spark):
    with pytest.raises(ValueError):
        pit.route_source("vendor", filings=lambda: None)
    mixed = spark.createDataFrame([("a", "filings"), ("b", "labels")], "ticker string, source string")
    with pytest.raises(Exception, match="isn't of source filings"):
        pit.route_source("filings", filings=lambda: mixed).collect()
    sig = spark.createDataFrame([("r", 1, "a", 1.0), ("r", 1, "b", 1.0)], "run_id string, mark int, symbol string, strength double")
    vols = spark.createDataFrame([(1, "a", 0.2)], "mark int, symbol string, vol double")
    with pytest.raises(Exception, match="no volatility of b"):
        wt.ext_vol_weights(sig, vols).collect()
    assert [r["w"] for r in wt.ext_vol_weights(sig.where("symbol = 'a'"), vols).collect()] == [1.0]
    one = spark.createDataFrame([("r", 10, 0.1, 0.0, 3.0)], "run_id string, n long, sharpe double, skew double, kurtosis double")
    with pytest.raises(Exception, match="fewer than two trials"):
        rs.deflated_sharpe(one, spark.createDataFrame([(1.0,)], "sharpe_annual double")).collect()
    panel = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY, -1.0), ("b", DAY, None)], "symbol string, dt date, px double")
    assert {tuple(r) for r in qu.validate_panel(panel).collect()} == {("repeated date", "a", 1), ("not positive", "a", 1), ("no price", "b", 1)}


def test_verify_lock(spark):
    rng = random.Random(7)
    closes = {s: {"window64": [100.0 + rng.random() * 9 for _ in range(64)], "looks": {"21": 90.0, "63": 200.0 if s == "c" else 90.0}} for s in "abc"}
    raw = {}
    for s, v in closes.items():
        r = np.diff(v["window64"]) / v["window64"][:-1]
        raw[s] = sum(v["window64"][-1] > x for x in v["looks"].values()) / 2 / (r.std(ddof=1) * 252**0.5)
    w = {s: float(x / sum(raw.values())) for s, x in raw.items()}
    row = lambda name, picks, snap: (name, DAY, picks, (DAY, closes) if snap else None)
    off = dict(w, a=w["a"] + 1e-4)
    schema = "strategy string, lock_date date, picks map<string,double>, signal_snapshot struct<asof: date, closes: map<string, struct<window64: array<double>, looks: map<string,double>>>>"
    locks = spark.createDataFrame([row("good", w, True), row("off", off, True), row("plain", {"a": 0.5, "b": 0.5}, False), row("short", {"a": 1.5, "b": -0.5}, False)], schema)
    got = {r["book"]: (r["ok"], r["names"]) for r in ob.verify_lock(locks, ("21", "63")).collect()}
    assert got == {"good": (True, 3), "off": (False, 3), "plain": (True, 2), "short": (False, 2)}
