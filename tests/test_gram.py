"""Block Gram statistics against the row-by-row operators, and the running median against sorting."""

import datetime as dtm
import random
import statistics

import pytest
from pyspark.sql import functions as F

from asofspark.operators import gram, research, timeseries
from asofspark.operators import panel as pn
from asofspark.operators import weights as wt
from asofspark.sources import sinks

DAY = dtm.date(2020, 1, 6)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(6)
    rows = []
    for n in range(14):
        price, drift = 50.0 + n, 0.0
        for t in range(3 * n if n % 3 == 0 else 0, 120):
            drift = 0.8 * drift + rng.gauss(0, 1)
            price = max(1.0, price + rng.gauss(0, 0.5))
            close = 100 + t * 0.1 * (n % 4) + drift if n < 8 else price
            if rng.random() > 0.1 or t % 40 == 0:
                rows.append((f"s{n:02d}", DAY + dtm.timedelta(days=t), close, close, close, close, 1.0))
    rows += [("flat", DAY + dtm.timedelta(days=t), 5.0, 5.0, 5.0, 5.0, 1.0) for t in range(120)]
    return pn.panel(spark.createDataFrame(rows, sinks.BAR_SCHEMA)).cache()


@pytest.mark.parametrize("block", [64, 3])
def test_pair_statistics(spark, panel, block):
    groups = panel.select("symbol").distinct().withColumn("grp", F.when(F.col("symbol") > "s05", "y").otherwise("x"))
    got = {(r["a"], r["b"]): r for r in gram.pair_statistics(panel, groups, block=block).collect()}
    pairs = wt.candidate_pairs(groups)
    fit, resid = research.hedge_ratios(pairs, panel)
    adf = research.adf_tstat(resid, "pair", "resid", "dt").drop("n")
    want = fit.join(adf, "pair").join(research.half_life(resid, "pair", "resid", "dt"), "pair").where("beta is not null").collect()
    assert len(want) > 40 and got.keys() == {(r["a"], r["b"]) for r in want}
    for r in want:
        mine = got[r["a"], r["b"]]
        assert mine["n"] == r["n"]
        for c in ("beta", "alpha", "adf_t", "half_life"):
            if r["a"] != "flat" or c in ("beta", "alpha"):  # the residual of a flat series is no more than rounding
                assert mine[c] == pytest.approx(r[c], rel=1e-6, abs=1e-9), (r["pair"], c)
    few = gram.cointegrated(gram.pair_statistics(panel, groups, block=block), shortest=0.1).select("a", "b").where("a <> 'flat'").collect()
    assert 0 < len(few) and {tuple(r) for r in few} == {(r["a"], r["b"]) for r in research.find_pairs(pairs, panel, shortest=0.1).collect() if r["a"] != "flat"}


@pytest.mark.parametrize("block", [64, 4])
def test_block_covariances(spark, panel, block):
    marks = spark.createDataFrame([(20,), (33,), (119,)], "idx long")
    want = {(r["mark"], r["a"], r["b"]): r["cov"] for r in timeseries.rolling_cov(panel, marks, 15).collect()}
    got = {(r["mark"], r["a"], r["b"]): r["cov"] for r in gram.block_covariances(panel, [20, 33, 119, 500], 15, block=block).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-14) for k in want)


def test_running_median(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice([None, 1.0, rng.gauss(0, 1)])) for s in ("a", "b", "c") for i in range(200)]
    got = timeseries.running_median(spark.createDataFrame(rows, "symbol string, idx long, v double").repartition(5), "v", "m").collect()
    for s in ("a", "b", "c"):
        seen = []
        for r in sorted((r for r in got if r["symbol"] == s), key=lambda r: r["idx"]):
            seen += [r["v"]] if r["v"] is not None else []
            assert r["m"] == (pytest.approx(statistics.median(seen)) if seen else None)


def test_classes_lose_no_pair(spark):
    """Statistics of classes, in each order that their members have, are those of every pair of members."""
    rng, rows = random.Random(8), []
    names = {"a1": 1, "c2": 1, "b1": 2, "d9": 2, "b5": 3, "e0": 4, "a0": 4}
    series = {k: [rng.gauss(50, 5) for _ in range(90)] for k in set(names.values())}
    for name, k in names.items():
        rows += [(name, DAY + dtm.timedelta(days=t), v, v, v, v, 1.0) for t, v in enumerate(series[k])]
    bars = spark.createDataFrame(rows, sinks.BAR_SCHEMA)
    groups = spark.createDataFrame([(n, "g") for n in names], "symbol string, grp string")
    cls = {r["symbol"]: r["first"] for r in gram.copies(bars, groups).collect()}
    assert cls == {"a1": "a1", "c2": "a1", "b1": "b1", "d9": "b1", "b5": "b5", "e0": "a0", "a0": "a0"}
    one = gram.copies(bars, groups).where("symbol = first").select("symbol", "grp", "last")
    for block in (64, 2):
        got = {(r["a"], r["b"]): r for r in gram.pair_statistics(pn.panel(bars.join(one, "symbol", "left_semi")), one, block=block).collect()}
        every = [r for r in gram.pair_statistics(pn.panel(bars), groups, block=block).collect() if cls[r["a"]] != cls[r["b"]]]
        assert {(cls[r["a"]], cls[r["b"]]) for r in every} == got.keys() and len(every) == 18
        for r in every:
            mine = got[cls[r["a"]], cls[r["b"]]]
            assert (mine["n"], mine["beta"], mine["adf_t"]) == (r["n"], pytest.approx(r["beta"], rel=1e-9), pytest.approx(r["adf_t"], rel=1e-9))
