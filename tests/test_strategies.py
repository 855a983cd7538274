"""Strategies and their registry, the look-ahead check, SQL views and variants."""

import datetime as dtm
import random

import pytest
from pyspark.sql import functions as F

from asofspark.operators import panel as pn
from asofspark.operators import schedules, strategies
from asofspark.sources import sinks

DAY = dtm.date(2019, 1, 7)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(8)
    rows = []
    for s in range(7):
        price = 20.0 + s
        for t in range(150):
            o = price
            price *= 1 + rng.gauss(0.001 * (s - 3), 0.02)
            if rng.random() > 0.05:
                rows.append((f"s{s}", DAY + dtm.timedelta(days=t), o, max(o, price), min(o, price), price, 1.0))
    return pn.panel(spark.createDataFrame(rows, sinks.BAR_SCHEMA)).withColumn("idx", F.col("idx").cast("long")).cache()


@pytest.fixture(scope="module")
def params(spark):
    return spark.createDataFrame([("a", 10, 0, 1.0, 3), ("b", 10, 4, 1.5, 2)], "run_id string, every long, offset long, gross double, n int")


def test_registry(panel, params):
    with pytest.raises(ValueError, match="registered"):
        strategies.picker("trend")(lambda p, q: p)
    with pytest.raises(ValueError, match="unknown strategy 'none'"):
        strategies.pick("none", panel, params)
    best = strategies.pick("top_momentum", panel, params).collect()
    assert {r["mark"] % 10 for r in best if r["run_id"] == "b"} == {4} and min(r["mark"] for r in best) >= 56
    for run, n in (("a", 3), ("b", 2)):
        marks = {r["mark"] for r in best if r["run_id"] == run}
        assert all(sum(r["w"] for r in best if (r["run_id"], r["mark"]) == (run, m)) == pytest.approx(1) for m in marks)
        assert max(sum((r["run_id"], r["mark"]) == (run, m) for r in best) for m in marks) == n
    gross = strategies.pick("trend", panel, params).groupBy("run_id", "mark").agg(F.sum(F.abs("w")).alias("g")).collect()
    assert gross and all(r["g"] == pytest.approx(1.0 if r["run_id"] == "a" else 1.5) for r in gross)


def test_look_ahead_is_seen(panel, params):
    for name in strategies.PICKERS:
        assert strategies.looks_ahead(name, panel, params, 120).count() == 0
    best_tomorrow = lambda p, q: strategies.equal_weight(p, q).join(p.select("symbol", (F.col("idx") - 1).alias("mark"), F.col("px").alias("n")), ["symbol", "mark"]).withColumn("w", F.col("n") * F.col("w"))
    found = strategies.looks_ahead(best_tomorrow, panel, params, 120).collect()
    assert found and {r["mark"] for r in found} == {120}


def test_views(spark, panel, params):
    panel.createOrReplaceTempView("t_panel")
    params.createOrReplaceTempView("t_params")
    strategies.create_view(spark, "t_weights", "pick", ["t_panel", "t_params"], "equal_weight")
    strategies.create_view(spark, "t_curve", "daily_curve", ["t_weights", "t_panel"], cost=schedules.two_tier(5, 100, 50))
    got = spark.sql("SELECT run_id, max_by(equity, idx) AS e, sum(fees) AS f FROM t_curve GROUP BY run_id").collect()
    want = strategies.backtest("equal_weight", panel, params, cost=schedules.two_tier(5, 100, 50)).groupBy("run_id").agg(F.max_by("equity", "idx"), F.sum("fees")).collect()
    assert {r[0]: pytest.approx(tuple(r)[1:]) for r in want} == {r[0]: tuple(r)[1:] for r in got}
    strategies.create_view(spark, "t_own", lambda t: t.groupBy("run_id").count(), ["t_weights"])
    assert spark.sql("SELECT sum(count) AS n FROM t_own").first()["n"] == spark.table("t_weights").count()
    with pytest.raises(ValueError, match="unknown operator"):
        strategies.create_view(spark, "t_x", "nothing", [])


def test_ladder_and_references(spark):
    days = [DAY + dtm.timedelta(days=k) for k in range(5)]
    rows = spark.createDataFrame([("c", d, 0.01 * (k - 2), 0.02 if k else None) for k, d in enumerate(days)], "core string, dt date, ret double, rf double")
    got = {(r["leverage"], r["dt"]): r["equity"] for r in strategies.leverage_ladder(rows, [1.0, 2.0], by=("core",)).collect()}
    for level in (1.0, 2.0):
        value = 10_000.0
        for k, d in enumerate(days):
            value *= 1 + level * 0.01 * (k - 2) - (level - 1) * ((0.02 if k else 0.0) + 0.004) / 252
            assert got[level, d] == pytest.approx(value)
    cal = spark.createDataFrame([(d, k) for k, d in enumerate(days) if k != 2], "dt date, idx int")
    dates = spark.createDataFrame([("x", days[2]), ("y", days[4]), ("z", DAY - dtm.timedelta(days=1))], "label string, date date")
    assert {(r["label"], r["mark"]) for r in strategies.last_rows(cal, dates).collect()} == {("x", 1), ("y", 4)}


def test_stitched_signals(spark):
    grid = spark.createDataFrame([("s", r, i, float(i * 10 + k)) for k, r in enumerate(("p", "q")) for i in range(12)], "symbol string, run_id string, idx long, signal double")
    winners = spark.createDataFrame([("s", 4, "p"), ("s", 8, "q")], "symbol string, fold long, run_id string")
    best = spark.createDataFrame([("s", "q")], "symbol string, run_id string")
    got = {(r["scheme"], r["idx"]): r["signal"] for r in strategies.stitched_signals(grid, winners, best, 4, "p").collect()}
    want = {("walk forward", i): i * 10.0 + (i >= 8) for i in range(4, 12)} | {("best of all", i): i * 10.0 + 1 for i in range(4, 12)}
    assert got == want | {("untuned", i): i * 10.0 for i in range(4, 12)} | {("hold", i): 1.0 for i in range(4, 12)}
