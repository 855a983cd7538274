"""The pipeline's stages against plain versions of their decisions, on edge rows and on an empty table."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asofspark.llm import decontaminate, pii
from asofspark.llm.simhash import simhash_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "a passage of the test set that nobody should ever train on because it gives the answer away"


def rows():
    rng = random.Random(12)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(k, text(rng.randint(30, 200)) + (" ### $$$ %%%" * 40 if k % 10 == 0 else ""), "en", "ab"[k % 2]) for k in range(200)]
    out += [(300 + k, out[3][1], "en", "a") for k in range(4)]  # exact copies
    out += [(400, text(40) + " " + ITEM.upper() + " " + text(40), "en", "b"), (401, text(50) + " reach me at bob@site.org or +1 (017) 555-7713", "en", "a")]
    out += [out[5], out[5]]  # repeated rows
    out += [(500, None, None, None), (None, text(60), "en", None), (501, "", "en", "a")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 != 0), 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit(1)).withColumn("_text", F.lit("x"))
    kinds = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        a, b = before.collect(), docs.collect()
        seen.append(name)
        if name == "mixing":
            break
        assert {c: dict(docs.dtypes)[c] for c in corpus_pipeline.COLUMNS} == kinds and docs.columns == corpus_pipeline.COLUMNS
        ids = Counter(r["doc_id"] for r in b)
        if name == "quality classifier":
            gone = {r["doc_id"] for r in a} - set(ids)
            assert {k for k in range(0, 200, 10)} <= gone | {0} and len(gone & {k for k in range(200) if k % 10}) <= 2
        elif name == "near duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in simhash_groups(before).collect()}
            assert max(ids.values()) == 1 and set(ids) == {i for i, g in groups.items() if i == g}
            assert 3 in ids and not {300, 301, 302, 303} & set(ids)
        elif name == "decontamination":
            asked = decontaminate.shingles(decontaminate.words_of(ITEM))
            assert set(ids) == {r["doc_id"] for r in a if 5 * len(asked & decontaminate.shingles(decontaminate.words_of(r["text"]))) < 4 * len(asked)} and 400 not in ids
        elif name == "personal data":
            assert set(ids) == {r["doc_id"] for r in a} and all(not pii.base_spans(r["text"] or "") for r in b)
            assert {r["doc_id"]: r["text"] for r in b}[401].endswith("reach me at <EMAIL> or <PHONE>")
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in b)
    assert seen == ["quality classifier", "near duplicates", "decontamination", "personal data", "mixing"]
    assert all(0 < r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] for r in b)
    taken = Counter()
    for r in b:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= max(0.05 * r["target"], 200) for r in b)


def test_run_and_empty(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 50 and got.where("doc_id in (400, 300)").count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
