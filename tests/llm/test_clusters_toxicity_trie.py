"""Operators 11 to 13 against plain versions, samples at large counts, and blocks under other file splits."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofspark.llm import context_tree, conversation_trie, radix_tree, storage, toxicity, url_rules, vector_clusters

VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(x * 1024) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(q) for _, q in first]
    distance = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    nearest = lambda q: min((distance(q, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(q)[1] for _, q in kept]
        for c in range(len(centroids)):
            mine = [q for (_, q), n in zip(kept, of, strict=True) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, nearest(q)[1], nearest(q)[0]) for i, q in kept), key=str), centroids


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "none"])
def test_clusters(spark, kind):
    rng = random.Random(3)
    vector = lambda at: [float(np.float32(rng.gauss(at, 0.3))) for _ in range(64)]
    rows = [(k, vector(k % 5), 0, "x") for k in range(300)]
    if kind == "ties":  # equal vectors, repeated rows, null ids, a very common vector
        rows = [(k % 40, [float(k % 3)] * 64, 0, None) for k in range(120)] + [(None, [1.0] * 64, 0, None)] * 2 + [(900 + k, [0.5] * 64, 0, None) for k in range(200)]
    if kind == "few":
        rows = rows[:3]
    if kind == "none":
        rows = []
    bad = [(1000, None, 1, None), (1001, [], 1, None), (1002, [1.0] * 63, 1, None), (1003, [None] + [1.0] * 63, 1, None), (1004, [math.nan] + [1.0] * 63, 1, None), (1005, [math.inf] + [1.0] * 63, 1, None)]
    want, centroids = plain_clusters(rows + bad)
    got, found = vector_clusters.vector_clusters(spark.createDataFrame(rows + bad, VECTORS))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert found.tolist() == centroids
    whole = vector_clusters.with_inertia(got, found).collect()
    assert len(whole) == len(want) and len({r["inertia"] for r in whole}) <= 1
    for r in whole:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_cells():
    """An approximation decides only what the exact distances decide; packing is exact."""
    rng = np.random.default_rng(0)
    q = rng.integers(-500, 500, (400, 64)) + 3000 * (np.arange(400) % 3)[:, None]
    for bits, n in ((1, 7), (4, 7), (7, 7), (7, 3)):
        centroids = q[:n]
        cells = vector_clusters.Cells(q[:50], q.min(axis=0), q.max(axis=0), bits)
        coded = cells.of(q)
        assert (vector_clusters.unpacked(vector_clusters.packed(coded, bits), 64, bits) == coded).all()
        decided, exact = cells.decided(coded, cells.tables(centroids)), vector_clusters.nearest(q, centroids)[0]
        assert (exact[decided >= 0] == decided[decided >= 0]).all()
    assert (decided >= 0).mean() > 0.9  # three groups far apart


def test_radix_tree():
    """All aligned prefixes with their counts and least numbers, through every node layout."""
    rng = random.Random(1)
    keys = [bytes(rng.randrange(256 if k % 3 else 3) for _ in range(2 * rng.randrange(0, 6))) for k in range(3000)]
    keys += [bytes([1, 200, k % 40, 7]) for k in range(80)]
    tree, want = radix_tree.RadixTree(), defaultdict(list)
    for number, key in enumerate(keys):
        tree.insert(key, number)
        for end in range(0, len(key) + 1, 2):
            want[key[:end]].append(number)
    assert sorted(tree.prefixes(2)) == sorted((k, len(v), min(v)) for k, v in want.items())
    sizes, stack = set(), [tree.root]
    while stack:
        node = stack.pop()
        sizes.add(node.size)
        stack += [kid for _, kid in node.children()]
    assert sizes == {4, 16, 48, 256}


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            tid = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()[:16]
            own[c].append(((t is not None, t or 0), tid, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *own[c][h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = sum(saved[k] for k in kids[s]) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(s)))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("tree_bytes", [16 << 20, 500])
def test_trie(spark, monkeypatch, tree_bytes):
    monkeypatch.setattr(conversation_trie, "TREE_BYTES", tree_bytes)
    monkeypatch.setattr(conversation_trie, "SEGMENT", 4)
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    rng = random.Random(2)
    says = lambda: (rng.choice(["user", "bot"]), rng.choice(["hi", "", "é" * 5, "long " * 2000]))
    rows = [(c, t, *says(), "x") for c in [*range(0, 60), *range(100, 140), -5, 305] for t in range(rng.randrange(1, 9))]
    rows += [(200, t, "user", f"turn {t}", None) for t in range(70)] + [(c, t, "user", f"turn {t}", None) for c in (207, 208) for t in range(c - 150)]
    rows += [(401, None, None, None, None), (402, 1, None, "a", None), (402, 1, None, "a", None), (402, None, "z", None, None), (402, 1, "b", "a", None), (None, 1, "a", "b", None)]
    rows += [(c, t, "user", "same", None) for c in range(500, 600) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(7)
    got = conversation_trie.conversation_trie(table)
    assert sorted(map(tuple, got.drop("node", "parent").collect()), key=str) == plain_trie(rows)
    if tree_bytes > 500:
        assert conversation_trie.conversation_trie(table.where("false")).count() == 0


def test_numbered(spark):
    """Places of a key that lies in all tasks."""
    rows = [(7, k // 2) for k in range(500)] + [(k % 5, k) for k in range(100)]
    got = conversation_trie.numbered(spark.createDataFrame(rows, "key long, v long").repartition(9), "key", "v").collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r["at"], r["v"]) for r in got if r["key"] == key)
        assert [a for a, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    inputs, index = rng.normal(size=(20, toxicity.STATISTICS + toxicity.BYTE_DIMENSIONS)), rng.integers(0, 20, (6, 8))
    valid = (rng.random((6, 8)) < 0.8).astype(float)
    valid[:, 3] = 1
    y = rng.integers(0, 2, 6).astype(float)
    loss = lambda: toxicity.gradients(p, inputs, index, valid, y)[0]
    _, g, d_inputs = toxicity.gradients(p, inputs, index, valid, y)
    for name, d in [*g.items(), ("inputs", d_inputs)]:
        values = inputs if name == "inputs" else p[name]
        at = tuple(rng.integers(0, n) for n in values.shape)
        kept = values[at]
        values[at] = kept + 1e-3
        up = loss()
        values[at] = kept - 1e-3
        down = loss()
        values[at] = kept
        assert d[at] == pytest.approx((up - down) / 2e-3, rel=1e-2, abs=1e-5), name


def test_windows():
    text, first = toxicity.window_starts(np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 10 * toxicity.WINDOW]))
    for k, n in enumerate([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 10 * toxicity.WINDOW]):
        mine = first[text == k]
        assert set(range(n)) == {w for f in mine for w in range(f, min(n, f + toxicity.WINDOW))}


def test_toxicity(spark):
    """A known word, and a known stem with new endings, are caught wherever they stand in a text; clean texts are left alone."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ke", "mi", "to", "lu", "ra"]) for _ in range(rng.randrange(1, 5)))
    bad = lambda: rng.choice(["filth", "ugh" + "xyzq" + word()])
    docs, labels = [], []
    for k in range(900):
        words = [word() for _ in range(rng.choice([10, 80, 400]))]
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), bad())
        docs.append((k, " ".join(words), "zz", 0.5))
        labels.append((k, int(k % 3 == 0)))
    docs += [(2000, None, None, None), (2001, "", None, None), (2002, "12 34", None, None), (None, "filth ba filth", None, None), (1, docs[1][1], None, None), (2003, "ba ke " * 40_000 + "filth filth filth", None, None)]
    labels += [(1, 0), (1, None), (5000, 1), (3, 7), (None, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(table, known).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    toxic, clean = ([r["predicted"] for r in held if (r["doc_id"] % 3 == 0) == t] for t in (True, False))
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.05
    assert next(r["predicted"] for r in got if r["doc_id"] == 2003) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (2000, 2001, 2002)}) == 1
    assert toxicity.toxicity_scores(table.where("false"), known).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(table, known.where("false")).collect()} == {0.5}


def test_toxicity_held_out_accuracy(spark):
    got = toxicity.toxicity_scores(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rates = dict(map(tuple, got.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted")).collect()))
    assert rates[1] > 0.85 and rates[0] < 0.02


def test_samples_never_empty(spark):
    """The share of n hashes stays near its bound at any n; no URL sample leaves one task."""
    for n in (10**3, 10**9, 10**12, 10**15):
        bound = int(20_000 / n * 2**64) - 2**63 if n > 20_000 else 2**63
        assert n * (bound + 2**63) / 2**64 == pytest.approx(min(n, 20_000), rel=1e-3)
    hashes = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    assert abs(hashes.where(storage.share_of(F.col("h"), 0.01)).count() - 1000) < 150
    assert hashes.where(storage.share_of(F.col("h"), 1.0)).count() == 100_000
    empty = spark.createDataFrame([], "page_id long, key string")
    assert url_rules._limits(empty, 3 * 10**10, 5000) == ([], [5000])


def test_blocks_stay(spark, tmp_path):
    """Scores are the same if files are split otherwise between the scans, and for rows that come from no file."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(2, "doc_id").write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        context_tree.BLOCK_BYTES, kept = 40_000, context_tree.BLOCK_BYTES
        scored = context_tree.context_tree_scores(read)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        first = sorted(map(tuple, scored.collect()))
        second = sorted(map(tuple, context_tree.context_tree_scores(read.join(spark.range(1)).drop("id")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        context_tree.BLOCK_BYTES = kept
    assert len(first) == read.count()
    for a, b in zip(first, second, strict=True):
        assert a == pytest.approx(b, rel=1e-9)
