"""The near-duplicate stage against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from asofspark.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Families of copies with 0 to 8 words of 60 to 300 replaced, so that similarities lie around 0.8."""
    rng = random.Random(5)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    out = []
    for size in (60, 3, 3, 2, 2, 2, 2, 1, 1):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    out += [out[0].upper().replace(" ", "\n"), out[1], "", None, " ", "one two three", "one two  three", "one two four", "a a a a a", "a a a a a a a"]
    rng.shuffle(out)
    return [*enumerate(out), (None, out[0]), (4, out[4]), (5, "only " + out[0])]


def plain(docs):
    """component_id of each row, from all pairs."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    sets, part = [shingles(t) for _, t in docs], list(range(len(docs)))
    for k in range(len(docs)):
        for m in range(k):
            both = len(sets[k] & sets[m])
            if sets[k] == sets[m] or 5 * both >= 4 * len(sets[k] | sets[m]):
                old, new = part[k], part[m]
                part = [new if p == old else p for p in part]
    ids = [[d for (d, _), q in zip(docs, part, strict=True) if q == p and d is not None] for p in part]
    return sorted(((d, min(i, default=None)) for (d, _), i in zip(docs, ids, strict=True)), key=str)


def test_groups(spark, monkeypatch):
    docs = rows()
    want = plain(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (400, 7):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert sorted(map(tuple, near_copies.near_copy_groups(table).collect()), key=str) == want
    assert near_copies.near_copy_groups(table.where("false")).count() == 0
    narrow = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(table).collect()}
    assert sum(narrow[d] != c for d, c in want) > 20  # 2 bits of 64 don't reach these copies


def test_blocks(spark):
    """Every two nodes of a group with several roots meet in a pair of blocks."""
    met = spark.createDataFrame([(1, k, 100, k % 3) for k in range(1000)] + [(2, k, 100, 0) for k in range(50)] + [(3, k, near_copies.BLOCK_BYTES, k) for k in range(4)], "h long, node long, size long, root long")
    seen = {}
    for r in near_copies._apart(met).collect():
        seen.setdefault((r["h"], r["i"], r["j"]), set()).add(r["node"])
    assert {h for h, _, _ in seen} == {1, 3} and max(map(len, seen.values())) < 1000
    for h, n in ((1, 1000), (3, 4)):
        assert len({(a, b) for (g, _, _), nodes in seen.items() if g == h for a in nodes for b in nodes if a < b}) == n * (n - 1) // 2


def test_connecting():
    rng = random.Random(3)
    sets = [near_copies.np.unique(near_copies.np.array([k % 4 * 1000 + rng.randrange(40) for _ in range(200)], dtype="uint64")) for k in range(12)]
    links = near_copies.connecting(near_copies.np.arange(12) + 50, near_copies.np.arange(12), sets)
    assert len(links) == 8 and all(a % 4 == b % 4 for a, b in links)


def test_stage(spark):
    rng = random.Random(9)
    text = [rng.choice("abcdefgh") * 3 + rng.choice("ijklmnop") for _ in range(200)]
    near, far = [*text[:100], "changed", *text[101:]], [w if k % 12 else "other" for k, w in enumerate(text)]
    docs = [(k, " ".join(t), "en", "a", len(" ".join(t))) for k, t in ((1, text), (2, near), (3, far), (4, text))]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}


def test_texts_lie_at_the_highest_common_level():
    """The stored texts come back whole, null as empty, and are smaller than at the library's usual level."""
    import pyarrow as pa
    import zstandard

    rng = random.Random(1)
    words = ["".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (300, 900, 3000)]
    column = pa.array([*texts, None, ""], pa.string())
    made = near_copies.packed(column)
    assert near_copies.unpacked(made).to_pylist() == [*texts, "", ""]
    usual = zstandard.ZstdCompressor(level=3).compress
    assert sum(len(x) for x in made.to_pylist()[:-2]) < 0.99 * sum(len(usual(t.encode())) for t in texts)


def hash_sets(families, rng):
    """Hashes and offsets of sets; those of a family share their first 36 of 40 hashes, so that their similarity is 0.82."""
    np, out = near_copies.np, []
    for n in families:
        base = rng.integers(0, 1 << 64, 36, dtype=np.uint64)
        out += [np.concatenate([base, rng.integers(0, 1 << 64, 4, dtype=np.uint64)]) for _ in range(n)]
    return np.concatenate(out), np.arange(len(out) + 1) * 40


def test_balls_meet_at_the_least_similarity():
    """SimHash blocks find pairs at 0.8, of large and of the smallest sets, and few others; single bits' balls don't."""
    np = near_copies.np
    rng = np.random.default_rng(2)
    for same, one, two in ((40, 5, 5), (4, 1, 0), (80, 20, 0)):
        pool = [rng.integers(0, 1 << 64, same + one + two, dtype=np.uint64) for _ in range(300)]
        sides = [[x[: same + one] for x in pool], [np.concatenate([x[:same], x[same + one :]]) for x in pool]]
        a, b = (near_copies.simhashes(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])]), 24) for s in sides)
        met, chance = np.zeros(300, bool), np.zeros(300, bool)
        for t in range(near_copies.BLOCKS[24]):
            x, y = (near_copies.ball(e["code"][:, t], e["weak"][:, t]) for e in (a, b))
            for k in range(near_copies.FLIPS):
                met |= (x == y[:, k : k + 1]).any(axis=1)
                chance |= (x == np.roll(y, 1, axis=0)[:, k : k + 1]).any(axis=1)
        assert met.all() and chance.sum() < 10
        assert np.bitwise_count(a["print"] ^ b["print"]).sum(axis=1).max() <= near_copies.RADIUS
        assert (np.bitwise_count(a["code"] ^ b["code"]) > simhash.RADIUS).mean() > 0.5


def test_candidates_meet_in_every_range(monkeypatch):
    """Over all ranges, and in turns, the candidates are the pairs whose balls meet; larger groups with several roots stay the last time."""
    np, limits = near_copies.np, (near_copies.SMALL, near_copies.MIDDLE)
    hashes, off = hash_sets([3, 2, 5, 2, 4, 1, 1], np.random.default_rng(4))
    made = near_copies.simhashes(hashes, off, 20)
    entry = np.dtype([("node", "<i8"), ("root", "<i8"), ("n", "<i4"), ("print", "<u8", 2), ("code", "<u4"), ("weak", "u1", near_copies.WEAK)])
    found = np.zeros(len(made), dtype=entry)
    found["node"] = found["root"] = np.arange(len(made)) + 100
    found["n"], found["print"], found["code"], found["weak"] = 40, made["print"], made["code"][:, 0], made["weak"][:, 0]
    balls = [set(x.tolist()) for x in near_copies.ball(found["code"], found["weak"])]
    near = np.bitwise_count(found["print"][:, None] ^ found["print"]).sum(axis=2) <= near_copies.RADIUS
    want = {(a, b) for a in range(len(balls)) for b in range(a + 1, len(balls)) if balls[a] & balls[b] and near[a, b]}
    assert len(want) > 15
    for codes in (1 << 22, 300):
        monkeypatch.setattr(near_copies, "CODES", codes)
        got = [near_copies.candidates(found, 20, 2, part, False, *limits) for part in range(4)]
        assert {(int(c) // len(found), int(c) % len(found)) for pairs, _, _ in got for p in pairs for c in p} == want
        assert not any(groups or partly for _, groups, partly in got)
    many = np.repeat(found[:1], near_copies.MIDDLE + 8)
    many["node"] = many["root"] = np.arange(len(many))
    for last in (False, True):
        got = [near_copies.candidates(many, 20, 2, part, last, *limits) for part in range(4)]
        assert any(partly for _, _, partly in got) and len({h for _, groups, _ in got for h, _ in groups}) == last
        assert {int(c) // len(many) + 1 - int(c) % len(many) for pairs, _, _ in got for p in pairs for c in p} == {0}
    many["root"] = 0
    assert not any(len(p) for part in range(4) for p in near_copies.candidates(many, 20, 2, part, True, *limits)[0])


def test_large_groups(spark, monkeypatch):
    """Groups whose neighbours only are tried first give the same components as all pairs."""
    docs = rows()
    want = plain(docs)
    monkeypatch.setattr(near_copies, "SMALL", 2)
    for middle in (2, 6):
        monkeypatch.setattr(near_copies, "MIDDLE", middle)
        got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_each_text_is_compared_in_one_class(spark, monkeypatch):
    """A family that meets in hundreds of codes is dealt over pairs of blocks once, not once for each code."""
    docs = rows()
    linked, seen = near_copies._linked, []

    def counted(groups, texts):
        seen.append([groups.groupBy("node").count().agg({"count": "max"}).first()[0], groups.select("h", "node").distinct().count(), groups.select("node").distinct().count()])
        return linked(groups, texts)

    monkeypatch.setattr(near_copies, "_linked", counted)
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "MIDDLE", 4)
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)
    assert [most for most, _, _ in seen] == [1] and all(a == b for _, a, b in seen)


def test_trees(monkeypatch):
    """The links join what all pairs would join, for families, strays between them and rows of other sizes; firsts() names the trees."""
    np = near_copies.np
    hashes, off = hash_sets([30, 20, 1, 1], np.random.default_rng(6))
    made = near_copies.simhashes(hashes, off, 20)
    found = np.zeros(len(made), dtype=[("n", "<i4"), ("print", "<u8", 2)])
    found["n"], found["print"] = 40, made["print"]
    found["n"][25:30] = 60
    rows_ = np.random.default_rng(7).permutation(len(found))
    near = np.bitwise_count(found["print"][:, None] ^ found["print"]).sum(axis=2) <= near_copies.RADIUS
    near &= 5 * np.minimum.outer(found["n"], found["n"]) >= 4 * np.maximum.outer(found["n"], found["n"])
    want = near_copies.firsts(*np.nonzero(near), len(found))
    assert len(np.unique(want)) == 5 and (want[:25] == 0).all() and (want[25:30] == 25).all()
    for read in (1 << 20, 7):
        monkeypatch.setattr(near_copies, "READ", read)
        a, b = near_copies.tree(found, rows_)
        assert len(a) == len(found) - 5 and near[a, b].all()
        assert (near_copies.firsts(a, b, len(found)) == want).all()


def test_texts_that_stay_are_not_shuffled(spark):
    """The ids that go are stored, so that they are broadcast although the table of all groups is beyond the threshold."""
    text = lambda k: " ".join(str(x) for x in range(9 * k, 9 * k + 9))
    docs = spark.createDataFrame([(k, text(max(k, 1)), "en", "a", 9) for k in range(3000)], SCHEMA)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "9000")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert kept.count() == 2999
        assert "Join" in (made := kept._jdf.queryExecution().sparkPlan().toString()) and "SortMergeJoin" not in made
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
