"""Daily schedule curves, stops and bands against a plain loop over bars."""

import datetime as dtm
import random

import pytest

from asofspark.operators import panel as pn
from asofspark.operators import schedules
from asofspark.sources import sinks

DAY = dtm.date(2021, 1, 4)


def market(seed, names=6, days=70, gaps=0.12):
    """{(symbol, row): (open, close)}: random walks with missing bars, a name that ends and one that begins late."""
    rng = random.Random(seed)
    out = {}
    for n in range(names):
        price, begin, end = 50.0 + 10 * n, 20 if n == 1 else 0, 45 if n == 2 else days
        for t in range(begin, end):
            o = price * (1 + rng.gauss(0, 0.01))
            price = o * (1 + rng.gauss(0, 0.03))
            if n == 0 or rng.random() > gaps:
                out[f"s{n}", t] = (o, price)
    return out


def schedule(seed, names=6, days=70, short=False):
    rng = random.Random(seed)
    out = {}
    for mark in sorted(rng.sample(range(days), 9)) + [days - 1]:
        chosen = rng.sample(range(names), rng.randrange(0, names))
        raw = {f"s{n}": rng.random() * (rng.choice([1, -1]) if short else 1) for n in chosen}
        size = sum(map(abs, raw.values())) / rng.choice([0.6, 1.0, 1.4])
        out[mark] = {s: w / size for s, w in raw.items()}
    return out


def loop(bars, targets, days, fee, step, cash_rate, financing, borrow, stop, initial=10_000.0, band=None, cap=1.0, year=252):
    """Equity by row, and the weights that were traded to at each mark, one bar after the other."""
    cash, shares, entry, seen = initial, {}, {}, {}
    curve, executed, traded = [], {}, 0.0
    worth = lambda: cash + sum(n * seen[s] for s, n in shares.items())
    for t in range(days):
        side = 0 if step else 1
        target = targets.get(t - step)
        if target is not None:
            price = {s: bars[s, t][side] for s in set(shares) | set(target) if (s, t) in bars}
            seen |= {s: p for s, p in price.items() if s in shares}
            want = dict(target)
            gross = sum(map(abs, target.values()))
            now = {s: shares[s] * price[s] for s in shares if s in price}
            if band is not None and shares and now and gross > 0:
                whole = sum(map(abs, now.values()))
                want = {s: sorted((target.get(s, 0.0) - band * abs(target.get(s, 0.0)), now.get(s, 0.0) / whole * gross, target.get(s, 0.0) + band * abs(target.get(s, 0.0))))[1] for s in {*target, *now}}
                size = sum(map(abs, want.values()))
                if cap is not None and size > cap:
                    want = {s: w * cap / size for s, w in want.items()}
            equity = worth()
            executed[t - step] = {s: w for s, w in want.items() if s in price and w != 0}
            for s in set(shares) | {s for s, w in want.items() if w}:
                if s not in price:
                    continue
                after = want.get(s, 0.0) * equity / price[s]
                move = (after - shares.get(s, 0.0)) * price[s]
                cash -= move + fee(abs(move))
                traded += abs(move)
                shares[s], entry[s], seen[s] = after, price[s], price[s]
                if not want.get(s, 0.0):
                    del shares[s]
        if stop is not None:
            for s in [s for s, n in shares.items() if n > 0 and (s, t) in bars and bars[s, t][1] <= entry[s] * (1 - stop)]:
                got = shares.pop(s) * bars[s, t][1]
                cash += got - fee(got)
                traded += got
        seen |= {s: bars[s, t][1] for s in shares if (s, t) in bars}
        cash -= sum(-n * seen[s] for s, n in shares.items() if n < 0) * borrow / 1e4 / year
        cash *= 1 + (financing[t] if cash < 0 else cash_rate[t]) / year
        curve.append(worth())
    return curve, executed, traded


def tables(spark, bars, targets, days):
    rows = [(s, DAY + dtm.timedelta(days=t), float(o), float(max(o, c)), float(min(o, c)), float(c), 1.0) for (s, t), (o, c) in bars.items()]
    prices = pn.panel(spark.createDataFrame(rows, sinks.BAR_SCHEMA))
    weights = [(run, m, s, w) for run, marks in targets.items() for m, ws in marks.items() for s, w in (ws.items() or [(None, 0.0)])]
    weights += [(run, m, None, 0.0) for run, marks in targets.items() for m, ws in marks.items() if not ws]
    return prices, spark.createDataFrame(weights, "run_id string, mark long, symbol string, w double")


@pytest.mark.parametrize(("fill", "stop", "short"), [("next_open", None, False), ("next_open", 0.06, True), ("close", 0.05, False), ("close", None, True)])
def test_daily_curve_is_the_bar_loop(spark, fill, stop, short):
    days, bars = 70, market(1)
    targets = {f"r{k}": schedule(k, short=short) for k in range(4)}
    prices, weights = tables(spark, bars, targets, days)
    rng = random.Random(9)
    rf, fin = ({t: rng.random() * 0.1 for t in sorted(rng.sample(range(3, days), 12))} for _ in range(2))
    carried = lambda known: [known[max(u for u in known if u <= t)] if any(u <= t for u in known) else 0.0 for t in range(days)]
    rate = lambda known: spark.createDataFrame(list(known.items()), "idx long, rate double")
    cost = schedules.two_tier(8.0, 900.0, 25.0)
    got = schedules.daily_curve(weights, prices, cost, fill, rate(rf), rate(fin), borrow_bps=120.0, stop=stop).collect()
    by = {(r["run_id"], r["idx"]): r["equity"] for r in got}
    assert len(by) == len(got) == 4 * days
    fee = lambda x: min(x, 900.0) * 8e-4 + max(x - 900.0, 0) * 25e-4
    for run, marks in targets.items():
        want, _, traded = loop(bars, marks, days, fee, 1 if fill == "next_open" else 0, carried(rf), carried(fin), 120.0, stop)
        assert [by[run, t] for t in range(days)] == pytest.approx(want, rel=1e-9)
        assert sum(r["traded"] for r in got if r["run_id"] == run) == pytest.approx(traded, rel=1e-9)


def test_known_curves(spark):
    """Identical names follow the closed form, equal long and short cancel, a stop stays out until the next fill."""
    flat = {(f"s{n}", t): (100 * 1.0005**t,) * 2 for n in range(5) for t in range(60)}
    prices, weights = tables(spark, flat, {"even": {0: {f"s{n}": 0.2 for n in range(5)}}, "neutral": {0: {"s0": 0.5, "s1": 0.5, "s2": -0.5, "s3": -0.5}}}, 60)
    got = {(r["run_id"], r["idx"]): r["equity"] for r in schedules.daily_curve(weights, prices).collect()}
    assert got["even", 59] == pytest.approx(10_000 * 1.0005**58)
    assert all(got["neutral", t] == pytest.approx(10_000) for t in range(60))
    opens, closes = [100, 100, 90, 78, 82, 100], [100, 100, 90, 75, 85, 120]
    stopped, weights = tables(spark, {("s0", t): (o, c) for t, (o, c) in enumerate(zip(opens, closes, strict=True))}, {"r": {0: {"s0": 1.0}}}, 6)
    curve = [r["equity"] for r in schedules.daily_curve(weights, stopped, stop=0.2).orderBy("idx").collect()]
    assert curve == pytest.approx([10_000, 10_000, 9_000, 7_500, 7_500, 7_500])
    with pytest.raises(ValueError):
        schedules.daily_curve(weights, stopped, fill="open")


@pytest.mark.parametrize("short", [False, True])
def test_bands_are_the_bar_loop(spark, short):
    days, bars = 70, market(4, gaps=0.0)
    targets = {f"r{k}": schedule(k + 20, short=short) for k in range(3)}
    prices, weights = tables(spark, bars, targets, days)
    cap = None if short else 1.0
    bands = [0.0, 0.05, 0.1, 0.2]
    found = schedules.banded_weights(weights, prices, bands, cap).collect()
    keyed = {(r["run_id"], r["band"], r["mark"], r["symbol"]): r["w"] for r in found if r["symbol"] is not None}
    for run, marks in targets.items():
        for band in bands:
            _, executed, _ = loop(bars, marks, days, lambda x: 0.0, 1, [0.0] * days, [0.0] * days, 0.0, None, band=band, cap=cap)
            mine = {(m, s): w for (r, b, m, s), w in keyed.items() if (r, b) == (run, band)}
            want = {(m, s): w for m, ws in executed.items() for s, w in ws.items()}
            assert mine.keys() == want.keys()
            assert all(mine[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_future_bars_change_nothing_before(spark):
    days, bars = 70, market(3)
    targets = {"r": schedule(5)}
    prices, weights = tables(spark, bars, targets, days)
    other, _ = tables(spark, {k: v if k[1] <= 40 else (v[0] * 3, v[1] * 5) for k, v in bars.items()}, targets, days)
    before = lambda p: [r["equity"] for r in schedules.daily_curve(weights, p, 10.0, stop=0.1).where("idx <= 40").orderBy("idx").collect()]
    assert before(prices) == before(other)
