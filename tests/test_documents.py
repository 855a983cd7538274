"""Members of JSON documents against a whole parse, and streams that can be replayed."""

import datetime as dtm
import json
import random

import pytest

from asofspark.operators import filings, quality
from asofspark.sources import documents, sinks
from asofspark.streaming import fills as streaming


def plain(doc, pattern):
    """(keys, value) of all members that match."""
    found = [((), doc)]
    for p in pattern:
        found = [((*keys, str(k)), v) for keys, x in found for k, v in (x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()) if p in ("*", str(k))]
    return found


def document(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["a}b", "{", 'q"uote\\', "é\n\t", "", "[1,2]", "x:y,z", "\U0001f600"])
    value = lambda d: rng.choice([text(), rng.randrange(-5, 9**9), 1.5e-7, None, True, False]) if d == 0 or rng.random() < 0.3 else ({text() + str(k): value(d - 1) for k in range(rng.randrange(4))} if rng.random() < 0.6 else [value(d - 1) for _ in range(rng.randrange(4))])
    return {"cik": 7, "facts": {f"t{k}": {"units": {u: [value(2) for _ in range(rng.randrange(5))] for u in ("USD", 'sh"}')}} for k in range(6)}, "more": value(3), "last": [{}, [], {"a": {}}]}


PATTERNS = [("cik",), ("facts", "*", "units", "*", "*"), ("more",), ("last", "*")]


@pytest.mark.parametrize("size", [1, 3, 17, 10**6])
def test_member_reader(size):
    for seed in range(20):
        doc = document(seed)
        for style in ({}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}):
            text = json.dumps(doc, **style)
            reader, got = documents.MemberReader(PATTERNS), []
            for a in range(0, len(text), size):
                got += reader.feed(text[a : a + size])
            got += reader.feed("", last=True)
            want = [(n, list(keys), v) for n, p in enumerate(PATTERNS) for keys, v in plain(doc, p)]
            key = lambda x: (x[0], json.dumps(x[1]))
            assert sorted(((n, k, json.loads(v)) for n, k, v in got), key=key) == sorted(want, key=key)


def test_documents_in_small_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for seed in range(3):
        (tmp_path / f"in/{seed}.json").write_text(json.dumps(document(seed)), encoding="utf-8")
    (tmp_path / "in/empty.json").write_text("")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = documents.json_members(spark, f"{tmp_path}/in", PATTERNS).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    key = lambda x: json.dumps(x[:3])
    got = sorted(((r["file"].rpartition("/")[2], r["pattern"], list(r["keys"]), json.loads(r["value"])) for r in rows), key=key)
    assert got == sorted(((f"{s}.json", n, list(keys), v) for s in range(3) for n, p in enumerate(PATTERNS) for keys, v in plain(document(s), p)), key=key)
    (tmp_path / "cut.json").write_text('{"cik": 1, "facts": {"a": "b')
    with pytest.raises(Exception, match="ends within"):
        documents.json_members(spark, f"{tmp_path}/cut.json", PATTERNS).collect()


def test_readers_agree_with_the_line_form(spark, tmp_path):
    fact = lambda k: {"end": f"20{10 + k}-12-31", "filed": f"20{11 + k}-02-01", "val": 1.5 * k, "form": "10-K", "fp": "FY"} | ({"start": f"20{10 + k}-01-01"} if k % 2 else {})
    docs = [{"cik": cik, "facts": {"us-gaap": {t: {"label": "a } b", "units": {"USD": [fact(k) for k in range(5)], "shares": [fact(7)]}} for t in ("Assets", "Revenues")}}} for cik in ("1", "22")]
    (tmp_path / "whole").mkdir()
    for d in docs:
        (tmp_path / f"whole/{d['cik']}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(d) for d in docs))
    cols = ["cik", "tag", "unit", "arr_pos", "start", "end", "filed", "val", "form", "fp"]
    assert sorted(map(str, documents.read_facts(spark, f"{tmp_path}/whole").select(*cols).collect())) == sorted(map(str, filings.read_facts(spark, f"{tmp_path}/lines.json", lines=True).select(*cols).collect()))
    (tmp_path / "map.json").write_text(json.dumps({str(k): {"ticker": f"t{k}", "cik_str": k} for k in range(50)}))
    assert sorted(documents.read_ticker_map(spark, f"{tmp_path}/map.json").collect()) == sorted(sinks.read_ticker_map(spark, f"{tmp_path}/map.json").collect())
    (tmp_path / "sic.json").write_text(json.dumps({"1": "35", "2": "", "3": None, "4": "7372"}))
    assert sorted(map(tuple, documents.read_sic_map(spark, f"{tmp_path}/sic.json").collect())) == [("0000000001", "0035"), ("0000000002", ""), ("0000000003", ""), ("0000000004", "7372")]


def test_replayed_batches_add_nothing(spark, tmp_path):
    path, out, cp = (f"{tmp_path}/{n}" for n in ("fills", "out", "cp"))
    for k in range(3):
        rows = [("a", dtm.date(2026, 1, 1 + k), "BUY" if k else "HOLD", f"t{i}", 1.0, 10.0, "") for i in range(4)]
        spark.createDataFrame(rows, sinks.FILL_SCHEMA).coalesce(1).write.mode("append").json(path)
        streaming.land_batches(streaming.stream_fills(spark, path), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 8
    last = max(int(f.name) for f in (tmp_path / "cp/commits").iterdir() if f.name.isdigit())
    (tmp_path / f"cp/commits/{last}").unlink()  # the batch was written, its commit was lost
    (tmp_path / f"cp/commits/.{last}.crc").unlink(missing_ok=True)
    streaming.land_batches(streaming.stream_fills(spark, path), out, cp).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).drop("batch").collect())) == sorted(map(str, sinks.read_fills(spark, path).where("side = 'BUY'").collect()))


def test_quotes_are_guarded_as_they_arrive(spark, tmp_path):
    closes = spark.createDataFrame([("a", 100.0, None), ("b", 100.0, 120.5), ("c", 50.0, 51.0)], "symbol string, close double, intraday double")
    rows = [("a", 103.0), ("a", 120.0), ("b", 120.0), ("c", 80.0), ("new", 7.0)]
    for k in range(2):
        spark.createDataFrame(rows[k * 3 : k * 3 + 3], "symbol string, quote double").coalesce(1).write.mode("append").json(f"{tmp_path}/quotes")
        streaming.land_batches(streaming.guarded_quotes(streaming.stream_quotes(spark, f"{tmp_path}/quotes"), closes), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["symbol"], r["quote"]): r["price"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = quality.quote_guard(spark.createDataFrame(rows, "symbol string, quote double").join(closes, "symbol", "left"))
    assert got == {(r["symbol"], r["quote"]): r["price"] for r in batch.collect()} == {("a", 103.0): 103.0, ("a", 120.0): 100.0, ("b", 120.0): 120.0, ("c", 80.0): 50.0, ("new", 7.0): 7.0}
