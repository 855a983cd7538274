"""Locks are written once a month, whole, whoever writes at the same time."""

import datetime as dtm
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from asofspark.operators import asof, observations
from asofspark.sources import sinks

SCHEMA = "book string, lock_date date, symbol string, w double, price double"


def lock(spark, writer, months=(1, 2, 3)):
    return spark.createDataFrame([("b o/k", dtm.date(2026, m, 2 + writer), f"s{writer}", 1.0, 10.0 + writer) for m in months], SCHEMA)


def test_one_writer_wins(spark, tmp_path):
    path = f"{tmp_path}/locks"

    def write(writer):
        try:
            sinks.write_lock(lock(spark, writer, (1, 2, 3) if writer % 2 else (3, 2, 1)), path)
            return writer
        except ValueError as e:
            assert "is locked for 2026-" in str(e)
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [w for w in pool.map(write, range(4)) if w is not None]
    written = [tuple(r) for r in spark.read.parquet(path).select("month", "symbol").collect()] if won else []
    by_month = {}
    for month, symbol in written:
        by_month.setdefault(str(month), set()).add(symbol)
    assert len(won) == 1 and len(by_month) == 3 and all(len(s) == 1 for s in by_month.values())
    assert {s for x in by_month.values() for s in x} == {f"s{w}" for w in won}
    assert not [n for n in os.listdir(path) if n.startswith("_staged")] and not [n for n in os.listdir(f"{path}/_claims") if not n.startswith("b%20o%2Fk-2026-") or len(n) > 20]


def test_a_month_is_refused_later(spark, tmp_path):
    path = f"{tmp_path}/locks"
    sinks.write_lock(lock(spark, 0, (1,)), path)
    with pytest.raises(ValueError, match="2026-01"):
        sinks.write_lock(lock(spark, 1, (2, 1)), path)
    assert {str(r["month"]) for r in spark.read.parquet(path).collect()} == {"2026-01"}
    sinks.write_lock(lock(spark, 1, (2,)), path)  # the refused call's claims were given back
    assert spark.read.parquet(path).count() == 2


def test_a_failed_write_gives_its_claims_back(spark, tmp_path):
    path = f"{tmp_path}/locks"
    broken = lock(spark, 0, (1,)).withColumn("w", F.raise_error(F.lit("no weight")).cast("double"))
    with pytest.raises(Exception, match="no weight"):
        sinks.write_lock(broken, path)
    sinks.write_lock(lock(spark, 1, (1,)), path)
    assert spark.read.parquet(path).first()["symbol"] == "s1"


def test_last_within(spark):
    day = lambda k: dtm.date(2020, 1, 1) + dtm.timedelta(days=k)
    prices = spark.createDataFrame([("a", day(k), float(k) if k != 6 else None) for k in (1, 3, 6, 9)] + [("b", day(2), 7.0)], "symbol string, dt date, px double")
    spans = spark.createDataFrame([("a", day(1), day(3)), ("a", day(3), day(8)), ("a", day(0), day(30)), ("b", day(2), day(9)), ("c", day(0), day(9))], "symbol string, x date, y date")
    got = {(r["symbol"], r["x"]): r["_last"] for r in asof.last_within(prices, spans, "x", "y").collect()}
    assert got == {("a", day(1)): 3.0, ("a", day(3)): None, ("a", day(0)): 9.0, ("b", day(2)): None, ("c", day(0)): None}


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    assert observations.scratch(spark, "x") != observations.scratch(spark, "x")

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Cluster(), spark.conf

    monkeypatch.setattr(Session, "conf", type("C", (), {"get": staticmethod(lambda key, default=None: default)})())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        observations.scratch(Session(), "x")
