"""Block summaries against resampled rows, and the exact overfitting curve against all subsets."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.operators import resampling as rp


def start(boot, blk, seed, n, block):
    return (boot * 2654435761 + blk * 40503 + seed * 97) % 2147483647 % (n - block + 1)


def drawn(n, block, boot, seed):
    return [i for blk in range(-(-n // block)) for i in range(start(boot, blk, seed, n, block), start(boot, blk, seed, n, block) + block)][:n]


def streams(seed, sizes):
    rng = random.Random(seed)
    return {name: [(rng.gauss(0.01, 0.1), rng.gauss(0.0, 0.2)) for _ in range(n)] for name, n in sizes.items()}


@pytest.mark.parametrize("block", [1, 4, 7, 13])
def test_pieces_are_the_rows(spark, block):
    sizes = spark.createDataFrame([("a", 65), ("b", 52), ("c", block)], "run string, n long")
    got = rp.resample_pieces(sizes, ("run",), block, 5, 3).orderBy("run", "boot", "pos").collect()
    for run, n in (("a", 65), ("b", 52), ("c", block)):
        for boot in range(5):
            mine = [r for r in got if (r["run"], r["boot"]) == (run, boot)]
            assert [i for r in mine for i in range(r["idx"], r["idx"] + r["len"])] == drawn(n, block, boot, 3)


@pytest.mark.parametrize("block", [4, 13])
def test_sharpe_difference(spark, block):
    data = streams(1, {"p": 90, "q": 131})
    rows = spark.createDataFrame([(k, i, a, b) for k, x in data.items() for i, (a, b) in enumerate(x)], "pair string, idx long, ra double, rb double")
    got = {r["pair"]: r for r in rp.sharpe_difference(rows, block, 200, 5).collect()}
    for k, x in data.items():
        x = np.array(x)
        sharpe = lambda v: v.mean() / v.std(ddof=1) * 252**0.5
        d = np.array([sharpe(x[i, 0]) - sharpe(x[i, 1]) for i in (drawn(len(x), block, b, 5) for b in range(200))])
        assert got[k]["observed"] == pytest.approx(sharpe(x[:, 0]) - sharpe(x[:, 1]))
        assert (got[k]["low"], got[k]["high"]) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])))
        assert got[k]["p"] == pytest.approx((d <= 0).mean())
    with pytest.raises(Exception, match="fewer than"):
        rp.sharpe_difference(rows.where("idx < 12"), block, 5).collect()


def test_deepest_falls(spark):
    data = streams(2, {"p": 61, "q": 40})
    data["ruin"] = [(-1.5 if i == 20 else 0.1, 0.0) for i in range(45)]
    rows = spark.createDataFrame([(k, i, a * 2) for k, x in data.items() for i, (a, _) in enumerate(x)], "run_id string, idx long, r double")
    got = {(r["run_id"], r["boot"]): r["drawdown"] for r in rp.deepest_falls(rows, 7, 40, 1).collect()}
    for k, x in data.items():
        for boot in range(40):
            v = np.cumprod([1 + max(2 * x[i][0], -1.0) for i in drawn(len(x), 7, boot, 1)])
            assert got[k, boot] == pytest.approx((v / np.maximum(np.maximum.accumulate(v), 1)).min() - 1)


def test_joint_rows(spark):
    rng = random.Random(3)
    panel = {("a", i): rng.random() for i in range(50)} | {("b", i): None if i % 9 == 0 else rng.random() for i in range(12, 50)}
    rows = spark.createDataFrame([(s, i, v) for (s, i), v in panel.items()], "symbol string, idx long, ret double")
    got = {(r["symbol"], r["boot"]): (r["n"], r["mean"]) for r in rp.resampled_means(rows, 50, 6, 30, 2).collect()}
    for boot in range(30):
        for s in "ab":
            v = [panel[s, i] for i in drawn(50, 6, boot, 2) if panel.get((s, i)) is not None]
            assert got[s, boot] == (len(v), pytest.approx(np.mean(v)))


def test_overfit_curve_is_all_subsets(spark):
    rng = random.Random(4)
    runs = [(g, f"r{k:02d}", rng.choice([1.0, 2.0, rng.random()]), rng.random()) for g, n in (("x", 9), ("y", 5), ("z", 1)) for k in range(n)] + [("x", "none", None, 1.0)]
    table = spark.createDataFrame(runs, "g string, run_id string, in_sample double, out_sample double")
    got = {(r["g"], r["k"]): (r["best_in"], r["then_out"]) for r in rp.overfit_curve(table, [1, 2, 4, 7], ("g",)).collect()}
    want = {}
    for g in "xyz":
        mine = [r for r in runs if r[0] == g and r[2] is not None]
        for k in (1, 2, 4, 7):
            best = [min(s, key=lambda r: (-r[2], r[1])) for s in itertools.combinations(mine, k)]
            if best:
                want[g, k] = (pytest.approx(np.mean([b[2] for b in best])), pytest.approx(np.mean([b[3] for b in best])))
    assert got == want
    assert rp.overfit_curve(table.where(F.lit(False)), [1]).count() == 0
