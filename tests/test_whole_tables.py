"""Queries without SQL read every customer and every symbol."""

import datetime
import random

import pytest

from asofspark.operators import scoring
from asofspark.plans import books, checks, portfolio


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("lots")), random.Random(4)
    lines = [(k, n, rng.randint(1, 3), float(rng.randint(1, 9) * 2), float(rng.randint(50, 900)), datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rng.randint(0, 900))) for k in range(60) for n in range(1, rng.randint(2, 7))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 6) for k in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, f"T{k % 2}") for k in (1, 2, 3)], "p_partkey long, p_type string").write.parquet(f"{path}/part.parquet")
    return path, lines


def plain_lots(lines):
    """Open lots and sums of realized gains by account and ticker, fill after fill."""
    books, gains = {}, {}
    for k, n, part, q, x, day in sorted(lines, key=lambda r: (r[5], r[0] * 10 + r[1])):
        key = (str(k % 6), f"T{part % 2}")
        book = books.setdefault(key, [])
        if n < 4:
            book.append([day.date(), q, x / q])
            continue
        left = q / 2
        while left > 1e-9 and any(lot[1] > 1e-9 for lot in book):
            best = max((lot for lot in book if lot[1] > 1e-9), key=lambda lot: lot[2])
            take = min(left, best[1])
            gains[key] = gains.get(key, 0) + take * (x / q - best[2])
            best[1] -= take
            left -= take
    return {(*key, d, round(n, 4)) for key, book in books.items() for d, n, _ in book if n > 1e-9}, gains


def test_lots_of_every_account(spark, orders):
    path, lines = orders
    open_lots, gains = plain_lots(lines)
    got = checks.q_lots(spark, path).collect()
    assert {(r["account"], r["ticker"], r["bought"], r["shares"]) for r in got if r["kind"] == "open"} == open_lots
    assert {r["account"] for r in got} == {str(k) for k in range(6)}
    for key, want in gains.items():
        assert sum(r["gain"] for r in got if r["kind"] == "realized" and (r["account"], r["ticker"]) == key) == pytest.approx(want, abs=0.01)
    report = checks.q_lots_report(spark, path).collect()
    assert {(r["account"], r["ticker"], r["bought"]) for r in report} == {x[:3] for x in open_lots}


SYMBOLS = [f"Brand#{k}" for k in range(11, 18)]


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    """Weekly prices of seven symbols, two of them beyond Brand#15."""
    path, rng = str(tmp_path_factory.mktemp("prices")), random.Random(6)
    px, lines = dict.fromkeys(range(7), 100.0), []
    for week in range(140):
        for k in range(7):
            px[k] *= 1 + rng.uniform(-0.05, 0.06)
            lines.append((week, k + 1, k, 1.0, px[k], datetime.datetime(1995, 1, 2) + datetime.timedelta(days=7 * week)))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(SYMBOLS)), "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    return path


def test_weights_of_every_symbol(spark, prices, monkeypatch):
    rows = portfolio.q_hrp(spark, prices).collect()
    marks = {r["mark"] for r in rows}
    assert marks and {(r["mark"], r["symbol"]) for r in rows} == {(m, s) for m in marks for s in SYMBOLS}
    assert all(abs(sum(r["w"] for r in rows if r["mark"] == m) - 1) < 1e-4 for m in marks)
    taken = []
    curve = scoring.schedule_curve
    monkeypatch.setattr(scoring, "schedule_curve", lambda w, *rest, **more: taken.append(w) or curve(w, *rest, **more))
    for query in (portfolio.q_schedule_curve, portfolio.q_turnover, books.q_offsets):
        assert query(spark, prices).count() > 0
        assert {r["symbol"] for r in taken[-1].collect()} == set(SYMBOLS)
