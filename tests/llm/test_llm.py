"""Each operator against a plain version, and on rows that are null, empty, long, repeated or clash in name."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofspark.llm import context_tree, crf, decontaminate, grid, language_id, mixing, near_copies, pii, pretokens, quality_classifier, simhash, stats, token_counts, url_rules
from asofspark.llm.components import connected_components
from asofspark.llm import quality_rules as quality_rules_module
from asofspark.llm.quality_rules import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, key string, hits int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away from here to there"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def edge_rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "house", "river", "éclair", "Straße", "stone", "bridge", "window", "paper", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (5, "one two", None, "b"), (6, text(6000), "de", "a"),
        (7, text(80), "en", "a"), (8, PASSAGE + " and more text after it", "en", "b"), (9, "日本語 テキスト", "ja", "b"), (10, "12345 !!! ###", "en", "b"),
        (11, "mail bob@site.org or +1 (017) 555-7713, 10.0.0.1 and 4111 1111 1111 1111", "en", "a"), (12, "spam spam " * 40, "en", "a"), (None, text(50), "en", "a"), (None, None, None, None),
    ]
    rows += [(100 + k, text(40) + ".\n" + text(20), "en" if k % 2 else "de", "a" if k % 3 else "c") for k in range(40)]
    rows += [(200 + k, rows[6][1], "en", "a") for k in range(5)]  # copies
    rows += [rows[6], rows[6]]  # repeated rows
    return [(*r, 1, 0.5, "own", "k", 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_counts(s):
    s = s or ""
    words = WORD.findall(s)
    lines = [x for x in s.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(runs)
    cover = {j for i, r in enumerate(runs) if many[r] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(cover)


def test_counts_of_texts():
    texts = [r[1] for r in edge_rows()] + ["a\na\n a\na\n\n", "x " * 30, "a b c d e f g h " * 2, "tail\n"]
    got = stats.count_texts(pa.array(texts, pa.string()))
    for k, s in enumerate(texts):
        assert tuple(int(got[c][k]) for c in stats.COUNTS[:5]) == plain_counts(s)


def test_repeated_keys_with_chance_collisions():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 6, 400, dtype=np.uint64)  # the upper 52 bits of all are equal
    off = np.array([0, 0, 150, 151, 400])
    marked, distinct = stats._repeated(keys, off)
    for k in range(4):
        part = keys[off[k] : off[k + 1]].tolist()
        assert distinct[k] == len(set(part)) and list(marked[off[k] : off[k + 1]]) == [part.count(x) > 1 for x in part]


def test_long_texts_hash_as_short_ones(monkeypatch):
    words = ["ab", "x" * 700, "", "é" * 90, "ab"]
    text = " ".join(words)
    whole = grid.Texts(pa.array([text], pa.large_string()))
    want = whole.hash_spans(*whole.words()[:2])
    monkeypatch.setattr(grid, "SLICE_BYTES", 64)
    grid._powers.cache_clear()
    cut = grid.Texts(pa.array(["", text, None]))
    assert list(cut.hash_spans(*cut.words()[:2])) == list(want) and want[0] == want[-1]
    monkeypatch.undo()
    grid._powers.cache_clear()


def test_large_strings_from_spark(spark, docs):
    """Arrow strings with 64-bit offsets give the same results."""
    jobs = [token_counts.token_counts, pii.pii_spans, simhash.simhash_groups, language_id.language_id, context_tree.context_tree_scores, quality_rules, lambda d: near_copies.near_copy_groups(d), lambda d: pii.scrubbed(d, columns=("doc_id",))]
    plain = [by_id(job(docs)) for job in jobs]
    one = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    found = by_id(decontaminate.contaminated(docs, one))
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert [by_id(job(docs)) for job in jobs] == plain and by_id(decontaminate.contaminated(docs, one)) == found
        assert url_rules.judge_urls(spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string"), url_rules.rule_table(spark)).count() == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "false")


def test_op1_rules_and_outliers(spark, docs, none):
    out = quality_rules(docs)
    want = sorted(((r[0], *plain_counts(r[1])) for r in edge_rows()), key=repr)
    assert sorted((tuple(r[:6]) for r in out.collect()), key=repr) == want
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules(none).count() == 0


def test_op1_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(1)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    prose = [(k, " ".join(rng.choice(words) + rng.choice(["", "", "", ","]) for _ in range(rng.randint(60, 300))), "en", "s") for k in range(400)]
    junk = [(1000 + k, " ".join(rng.choice(words) + "###" for _ in range(150)), "en", "s") for k in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[k] for k in range(400)) >= 396 and not any(kept[1000 + k] for k in range(20))


def test_op1_is_the_mcd(spark, monkeypatch):
    """Against FAST-MCD from many random subsets, in numpy, on groups of several sizes with planted outliers."""
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(7, 7)) * 0.3
    groups = {"=a": 900, "=b": 260}
    data, rows = {}, []
    for s, n in groups.items():
        x = rng.normal(size=(n, 7)) @ mix + 2 + ord(s[1]) % 2
        x[: n // 12] += rng.choice([-1, 1], size=(n // 12, 7)) * 6  # outliers
        data[s] = x
        rows += [("=en", s, k % 32, *map(float, v)) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "_l string, _s string, salt int, " + ", ".join(f"{z} double" for z in quality_rules_module.NAMES))
    for small in (20_000, 0):
        monkeypatch.setattr(quality_rules_module, "SMALL_TABLE", small)
        got = {r["grp"]: r for r in quality_rules_module.estimates(table, 1e-9)[0].collect()}  # the groups' own estimates alone
        for s, x in data.items():
            h, best = int(0.75 * len(x)), (np.inf, None)
            for _ in range(100):
                core = x[rng.choice(len(x), 8, replace=False)]
                for _ in range(20):
                    d = x - core.mean(axis=0)
                    core = x[np.argsort(np.einsum("ki,ij,kj->k", d, np.linalg.pinv(np.cov(core.T, bias=True)), d))[:h]]
                det = np.linalg.slogdet(np.cov(core.T, bias=True))[1]
                best = min(best, (det, core.mean(axis=0), np.cov(core.T, bias=True)), key=lambda v: v[0])
            d = x - best[1]
            ratio = np.median(np.einsum("ki,ij,kj->k", d, np.linalg.inv(best[2]), d)) / 6.346  # median of chi-squared with 7 degrees
            inner = x[np.einsum("ki,ij,kj->k", d, np.linalg.inv(best[2] * ratio), d) <= quality_rules_module.WITHIN]
            want = np.cov(inner.T, bias=True) * quality_rules_module.CONSISTENT_WITHIN
            r = got[f'["=en","{s}"]']
            mean = np.array([r[f"m{i}"] for i in range(7)])
            inv = np.zeros((7, 7))
            for i, j in quality_rules_module._PAIRS:
                inv[i, j] = inv[j, i] = r[f"v{i}_{j}"]
            assert np.abs(mean - inner.mean(axis=0)).max() < 0.05
            assert abs(-np.linalg.slogdet(inv)[1] - np.linalg.slogdet(want + np.eye(7) * quality_rules_module.FLOOR**2)[1]) < 0.35
            d2 = np.einsum("ki,ij,kj->k", x - mean, inv, x - mean)
            assert (d2[: len(x) // 12] > 40).all() and (d2[len(x) // 12 :] < 40).all()


def test_op1_every_group_has_its_estimate(spark):
    """Small groups lean on their language, and their own rows count."""
    rng = np.random.default_rng(8)
    rows = [("=en", f"=s{k % 40}", k % 32, *map(float, rng.normal(size=7) * 0.1 + (k % 40) / 40)) for k in range(400)] + [("=xx", "=lone", 0, *[9.0] * 7), ("null", "null", 1, *[0.5] * 7)]
    table = spark.createDataFrame(rows, "_l string, _s string, salt int, " + ", ".join(f"{z} double" for z in quality_rules_module.NAMES))
    got = {r["grp"]: r for r in quality_rules_module.estimates(table)[0].collect()}
    assert len(got) == 42
    low, high = got['["=en","=s0"]'], got['["=en","=s39"]']
    assert 0.1 < low["m0"] < 0.5 < high["m0"] < 0.9
    # Quartiles by bins against plain ones.
    q = {r["grp"]: r for r in quality_rules_module._quartiles(table).collect()}["[]"]
    values = np.array([r[3:] for r in rows])
    assert np.allclose([q[f"a{i}_{k}"] for i in range(7) for k in range(3)], np.quantile(values, [0.25, 0.5, 0.75], axis=0).T.ravel(), atol=0.02)


def test_op2_is_the_context_tree(spark, docs, none):
    depth = context_tree.DEPTH
    rows = edge_rows()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    nodes = {}
    for i, text, *_ in rows:
        if held(i):
            continue
        s = b"\0" * depth + lower(text).encode() + b"\0"
        for p in range(depth, len(s)):
            node = 1
            for j in range(8):
                bit = s[p] >> (7 - j) & 1
                for d in range(depth + 1):
                    nodes.setdefault((s[p - d : p], node), [0, 0])[bit] += 1
                node = node * 2 + bit
    kids = {}
    for ctx, node in nodes:
        if ctx:
            kids.setdefault((ctx[1:], node), []).append((ctx, node))
    log_e = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    log_w, own = {}, {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        e = log_e(*nodes[key])
        if len(key[0]) == depth:
            log_w[key] = e
            continue
        below = sum(log_w[k] for k in kids[key])
        log_w[key] = np.logaddexp(e, below) - math.log(2)
        own[key] = 1 / (1 + math.exp(min(700, max(-700, below - e))))
    learned = Counter()
    for i, text, *_ in rows:
        if not held(i):
            learned.update([*lower(text).encode().split(), None])
    n, v = sum(learned.values()), len(learned)
    got = context_tree.context_tree_scores(docs).collect()
    want = []
    for i, text, *_ in rows:
        s, total = b"\0" * depth + lower(text).encode() + b"\0", 0.0
        for p in range(depth, len(s)):
            node = 1
            for j in range(8):
                bit, m = s[p] >> (7 - j) & 1, None
                for d in range(depth, -1, -1):
                    key = (s[p - d : p], node)
                    seen = nodes.get(key, [0, 0])
                    kt = (seen[bit] + 0.5) / (sum(seen) + 1)
                    m = kt if m is None or (s[p - d - 1 : p], node) not in nodes else own[key] * kt + (1 - own[key]) * m
                total += math.log10(m)
                node = node * 2 + bit
        words = [*lower(text).encode().split(), None]
        size = len(lower(text).encode())
        want.append((i, held(i), len(words), sum(learned[w] > 0 for w in words), n, sum(math.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), total, size, -total * math.log2(10) / (size + 1)))
    for a, b in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-7)
    assert context_tree.context_tree_scores(none).count() == 0


def test_op2_blocks_and_lists_of_any_size(spark, docs, tmp_path):
    """Shares of file splits, lists in several rows and groups over many batches change nothing."""
    want = by_id(context_tree.context_tree_scores(docs))
    docs.write.parquet(f"{tmp_path}/d")
    run = lambda: by_id(context_tree.context_tree_scores(spark.read.parquet(f"{tmp_path}/d")))
    assert [r[:5] for r in run()] == [r[:5] for r in want]
    old = context_tree.BLOCK_BYTES
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        context_tree.BLOCK_BYTES = 2000
        got = run()
    finally:
        context_tree.BLOCK_BYTES = old
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-7)


def test_op3_longest_rule_wins(spark, monkeypatch):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "b", "c-d", "e"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), rng.choice([path(), ""])) for _ in range(60))}.values())
    urls = [None, "nourl", "", "x://", "://a.b/x"] + [rng.choice(["http://" + host().upper() + path() + rng.choice(["", "?q", "#f"]), "x://" + host()]) for _ in range(1500)] + ["http://a.b/x"] * 400
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    monkeypatch.setattr(url_rules, "TASK_ROWS", 100)
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        h = p = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            h = re.match(r"[^/?#]*", rest)[0]
            h, p = lower(h), re.match(r"[^?#]*", rest[len(h) :])[0]
        fits = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        assert got[k] == (h, p, *(max(fits)[2:] if fits else (None, "allow")))
    large = [(2**53 + 1, "http://a.b/x"), (-(2**62) - 1, None), (None, "x://e/y"), (2**53 + 1, "http://a.b/x")]
    back = url_rules.judge_urls(spark.createDataFrame(large, "page_id long, url string"), url_rules.rule_table(spark, rules)).collect()
    assert sorted((r["page_id"] for r in back), key=repr) == sorted((i for i, _ in large), key=repr)
    empty = pages.limit(0)
    assert url_rules.judge_urls(empty, url_rules.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, [("", "/", "block"), (None, "/", "block"), ("a", None, "block")])).collect()} == {"allow"}


def test_op4_learns_rules(spark, docs, none):
    rng = random.Random(3)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    rows = [(k, " ".join(rng.choice(words) + ("%%%" if k % 4 == 0 else "") for _ in range(rng.randint(5, 120)))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(600)] + [(3, None), (9999, 1)], "doc_id long, quality int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_classifier.quality_scores(table, labels).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out]) > 0.97
    assert len(quality_classifier.quality_scores(docs, labels.limit(0)).collect()) == docs.count()
    assert quality_classifier.quality_scores(none, labels).count() == 0


def test_op4_fit_against_plain_versions(spark):
    """The lasso's optimum by plain steps, the first split by trying all."""
    rng = np.random.default_rng(2)
    x = rng.random((300, len(quality_classifier.FEATURES)))
    y = ((x[:, 1] > 0.6) | (rng.random(300) < 0.1)).astype(float)
    rules = quality_classifier.grow_rules(x, y)
    cuts = quality_classifier._splits(x)
    g, h = y - 0.5, np.full(300, 0.25)
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1) + g[~s].sum() ** 2 / (h[~s].sum() + 1)
    tried = {(f, float(c)): gain(x[:, f] <= c) for f in range(x.shape[1]) for c in cuts[f] if 8 <= (x[:, f] <= c).sum() <= 292}
    f, c = max(tried, key=tried.get)
    assert rules[:2] == [((f, False, c),), ((f, True, c),)]
    a = quality_classifier.apply_rules(rules[:30], x)
    loss = lambda b, w: (np.logaddexp(0, b + a @ w) - y * (b + a @ w)).mean() + quality_classifier.LASSO * np.abs(w).sum()
    b, w = quality_classifier.lasso_logistic(a, y)
    b0, w0 = 0.0, np.zeros(30)
    for _ in range(30_000):  # plain proximal steps
        r = 1 / (1 + np.exp(-(b0 + a @ w0))) - y
        b0, w0 = b0 - 0.2 * r.mean(), w0 - 0.2 * (a.T @ r) / 300
        w0 = np.sign(w0) * np.maximum(np.abs(w0) - 0.2 * quality_classifier.LASSO, 0)
    assert loss(b, w) <= loss(b0, w0) * 1.002 and (w == 0).sum() > 5
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f")] * 40 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.fit_quality(docs, labels).intercept == pytest.approx(math.log((1 + 1) / (0 + 1)))


def test_op4_expression_equals_rules(spark):
    x = np.random.default_rng(0).random((500, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    model = quality_classifier.RuleModel.fit(x, y)
    df = spark.createDataFrame(x.tolist(), [*quality_classifier.FEATURES]).select(model.score().alias("s"))
    want = 1 / (1 + np.exp(-(model.intercept + quality_classifier.apply_rules(model.rules, x) @ np.array(model.weights))))
    assert np.allclose([r["s"] for r in df.collect()], want) and ((want >= 0.5) == y).mean() > 0.97


def test_op5_equals_the_library(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    pieces = ["'", "s", "t", "re", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "_", "\u00a0", "\u3000", "日", "😀", "ll", "\r", "\x1c", "'ve", "٣", "\u0301", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    table = token_counts.PieceTable("byte_bpe_50k.json")
    size, got = token_counts.count_tokens(pa.array(texts), table) if len(texts) <= grid.SLICE_TEXTS else (
        np.concatenate([token_counts.count_tokens(pa.array(texts[a : a + 2500]), table)[k] for a in (0, 2500)]) for k in (0, 1)
    )
    assert list(got) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(size) == [len(t.encode()) for t in texts]
    want = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in edge_rows()), key=repr)
    out = token_counts.token_counts(docs).collect()
    assert sorted((tuple(r[:3]) for r in out), key=repr) == want and all(r["over_limit"] == (r["n_tokens"] > 512) for r in out)
    assert token_counts.token_counts(none).count() == 0


def test_op6_groups_within_two_bits(spark, docs, none):
    import xxhash

    def print_of(s):
        w = WORD.findall(lower(s))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    rows = [(r[0], print_of(r[1])) for r in edge_rows()]
    least = {}
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    want = sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in rows), key=repr)
    assert by_id(simhash.simhash_groups(docs)) == want
    assert simhash.simhash_groups(none).count() == 0


def test_op6_finds_all_near_fingerprints(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)} | set(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = connected_components(simhash.near_pairs(spark.createDataFrame(signed, "fp long"))).collect()
    root = dict(got)
    for a in signed:
        for b in signed:
            if a != b and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2:
                assert root[a[0]] == root[b[0]]
    chain = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(900, 900), (500, 501), (501, 500)], "a long, b long")
    assert Counter(r["root"] for r in connected_components(chain).collect()) == {0: 301, 500: 2}


def test_op7_meets_targets(spark, docs, none):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "c", None])) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(table).collect()
    assert by_id(mixing.mixed(table.repartition(5))) == sorted(map(tuple, got), key=repr)
    taken, target = Counter(), {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(none).count() == 0


def test_op7_quotas_and_flow():
    assert mixing.quotas([("a", 10), ("b", 10), ("c", 100)]) == {"a": 30.0, "b": 30.0, "c": 60.0}
    flow = mixing.min_cost_flow([(100, {"a": 100}), (50, {"a": 50, "b": 50}), (10, {"b": 10})], {"a": 120.0, "b": 90.0})
    assert sum(f.get("a", 0) for f in flow) == pytest.approx(120) and sum(f.get("b", 0) for f in flow) == pytest.approx(90)
    assert flow[2]["b"] <= 30 and sum(flow[1].values()) <= 300
    assert flow[0]["a"] >= 100  # the first copy of everything is used before any second one


def plain_flow_cost(patterns, quota, epochs):
    """Cheapest cost by augmenting one word at a time along a cheapest path (Bellman and Ford)."""
    names = list(quota)
    ends = ["start", *range(len(patterns)), *names, "end"]
    arcs = []  # from, to, capacity, cost
    for p, (words, copies) in enumerate(patterns):
        for cost, n in enumerate(mixing._layers(words, epochs * sum(copies.values()))):
            arcs.append(["start", p, round(n), cost])
        arcs += [[p, s, epochs * n, 0] for s, n in copies.items()]
    arcs += [[s, "end", round(q), 0] for s, q in quota.items()]
    arcs += [[b, a, 0, -c] for a, b, _, c in arcs]
    half, total = len(arcs) // 2, 0
    while True:
        best, via = {e: math.inf for e in ends}, {}
        best["start"] = 0
        for _ in ends:
            for k, (a, b, n, c) in enumerate(arcs):
                if n and best[a] + c < best[b]:
                    best[b], via[b] = best[a] + c, k
        if best["end"] == math.inf:
            return total
        at = "end"
        while at != "start":
            k = via[at]
            arcs[k][2] -= 1
            arcs[(k + half) % (2 * half)][2] += 1
            at = arcs[k][0]
        total += best["end"]


def test_op7_flow_is_cheapest():
    rng = random.Random(12)
    for _ in range(25):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = []
        for _ in range(rng.randint(1, 6)):
            held = {s: rng.randint(1, 6) for s in rng.sample(names, rng.randint(1, len(names)))}
            patterns.append((rng.randint(1, min(held.values())) if len(held) > 1 else sum(held.values()), held))
        size = {s: sum(c.get(s, 0) for _, c in patterns) for s in names}
        quota = {s: rng.randint(0, 3 * n) for s, n in size.items()}
        flow = mixing.min_cost_flow(patterns, quota, 3)
        cost = 0.0
        for (words, copies), f in zip(patterns, flow, strict=True):
            assert all(-1e-6 <= v <= 3 * copies[s] + 1e-6 for s, v in f.items())
            left = sum(f.values())
            for c, n in enumerate(mixing._layers(words, 3 * sum(copies.values()))):
                cost += c * min(left, n)
                left -= min(left, n)
        for s in names:
            assert sum(f.get(s, 0) for f in flow) == pytest.approx(quota[s], abs=1e-4)
        assert cost == pytest.approx(plain_flow_cost(patterns, quota, 3), abs=1e-3)


def test_op7_flow_is_fast():
    rng = random.Random(13)
    names = [f"s{k}" for k in range(40)]
    patterns = [(100, {s: 100 for s in rng.sample(names, rng.randint(1, 4))}) for _ in range(20_000)]
    size = {s: sum(c.get(s, 0) for _, c in patterns) for s in names}
    quota = mixing.quotas(list(size.items()))
    began = time.time()
    flow = mixing.min_cost_flow(patterns, quota)
    assert time.time() - began < 60
    for s in names:
        assert sum(f.get(s, 0) for f in flow) == pytest.approx(quota[s], rel=1e-6)


def test_op7_sources_share_texts(spark, monkeypatch):
    """What both sources hold is left to the one that needs it; every source still meets its target."""
    rng = random.Random(14)
    both = [" ".join(f"b{k}x{j}" for j in range(rng.randint(5, 40))) for k in range(300)]
    rows = [(k, t, s) for k, (t, s) in enumerate([(t, s) for t in both for s in "ab"])]
    rows += [(1000 + k, " ".join(f"a{k}x{j}" for j in range(rng.randint(5, 40))), "a") for k in range(600)]
    rows += [(2000, None, "a"), (2001, "", None), (None, both[0], "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_tag", F.lit("clash"))
    for patterns, cells in ((20_000, 50_000), (0, 0)):  # with all patterns, and with each source by itself and tables that aren't broadcast
        monkeypatch.setattr(mixing, "MAX_PATTERNS", patterns)
        monkeypatch.setattr(mixing, "SMALL_TABLE", cells)
        got = mixing.mixed_rows(table, keep=("doc_id", "text", "source")).collect()
        assert len(got) == len(rows)
        for s in "ab":
            mine = [r for r in got if r["source"] == s]
            assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.01)
            assert all(r["taken"] <= 3 * r["size"] for r in mine)
        own = sum(r["epochs"] * r["size"] for r in got if r["source"] == "a" and r["text"] and r["text"].startswith("a")) / sum(r["size"] for r in got if r["source"] == "a" and r["text"] and r["text"].startswith("a"))
        common = sum(r["epochs"] * r["size"] for r in got if r["source"] == "a" and r["text"] and r["text"].startswith("b")) / sum(r["size"] for r in got if r["source"] == "a" and r["text"] and r["text"].startswith("b"))
        assert (own > common + 0.1) == bool(patterns)


def test_op8_finds_contained_items(spark, docs, none):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(5, 80)))) for k in range(40)] + [(90, None), (91, " ".join(text(2)).title() + "!"), (92, ""), (94, "never there"), (95, words[7])]
    stock = " ".join(text(30))  # a phrase that many items share
    items += [(200 + k, stock + " " + " ".join(text(6))) for k in range(30)] + [(300, stock)]
    items.append((93, items[0][1]))
    rows = []
    for k in range(150):
        body = text(rng.randint(0, 2000))
        if k % 2:
            item = (items[rng.randrange(40)][1] if k % 3 else items[-1 - rng.randrange(20)][1] or '').split() or ['x']
            for _ in range(rng.choice([0, 0, 1, 3])):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + rng.choice(["", ","]) for w in item]
        rows.append((k, " ".join(body)))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(0)).withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, body in rows:
        whole = (body or "").lower().replace(",", "").split()
        for j, item in items:
            own = re.findall("[a-z]+", (item or "").lower())
            width = min(5, len(own))
            cut = lambda w: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if width else set()  # noqa: B023, E731
            held, asked = cut(whole), cut(own)
            if asked and 5 * len(asked & held) >= 4 * len(asked):
                want.add((i, j, len(asked), len(asked & held)))
    got = [tuple(r)[:4] for r in decontaminate.contaminated(table, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    one = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, one).collect()] == [8]


def test_op9_separates_languages(spark, docs, none):
    rng = random.Random(9)
    syllables = {"en": ["th", "ing", "ou", "wh"], "de": ["sch", "ung", "ei", "cht"], "fr": ["eau", "oi", "que", "é"], "es": ["ción", "ar", "ñ", "ue"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(syllables))
        rows.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang))
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.97
    with pytest.raises(ValueError):
        language_id.fit_languages(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), "id").alias("lang")))
    assert language_id.family_of("pt-BR") == language_id.family_of("es_MX") == "romance"
    edge = language_id.language_id(docs).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["lang_pred"] for r in edge if r["doc_id"] in (1, 2, 3, 10)} == {"und"}
    assert {r["lang_pred"] for r in edge} <= {"en", "de", "ja", "und"}
    assert language_id.language_id(none).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op9_machines_against_plain_versions():
    """Margins by sums over bytes, the solver by its optimum, the votes by loops."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdé "), size=rng.integers(1, 80))) for _ in range(60)]
    langs = np.array([["en", "de", "es", "fr", "xx"][k % 5] for k in range(60)])
    column = pa.array(texts)
    x = language_id.frequencies(column)
    for row, text in zip(x, texts, strict=True):
        b = text.encode()
        assert row[:256] == pytest.approx(np.bincount(list(b), minlength=256) / len(b), abs=1e-6)
    y = np.where(rng.random(60) < 0.3, 1.0, -1.0)
    w, offset = language_id.support_vector_machine(x.astype(float), y)
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2
    loss = lambda w, b: 0.5 * (w @ w + b * b) + language_id.COST * (share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    best, full, b = np.zeros(x.shape[1]), 0.0, 0.0
    for _ in range(20_000):  # plain gradient steps
        r = np.maximum(0, 1 - y * (x @ best + b)) * share * y
        best, b = best - 2e-3 * (best - 2 * language_id.COST * r @ x), b - 2e-3 * (b - 2 * language_id.COST * r.sum())
    full = loss(best, b)
    assert loss(w, offset) <= full * 1.01
    model = language_id.LanguageModel.fit(x, langs)
    dense = x @ model.weights + model.offsets
    assert np.allclose(model.margins(column), dense, atol=1e-3)
    names, _ = model.predict(column)
    for k, name in enumerate(names):
        def winner(group):
            votes, sure = Counter({g: 0 for g in group}), Counter()
            for i, a in enumerate(group):
                for c in group[i + 1 :]:
                    m = dense[k, model.pairs[a, c]]
                    votes[a if m >= 0 else c] += 1
                    p = 1 / (1 + math.exp(-language_id.SLOPE * m))
                    sure[a] += p
                    sure[c] += 1 - p
            return max(group, key=lambda g: (votes[g], sure[g]))
        assert name == winner(model.families[winner(sorted(model.families))])


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_op10_base_spans_are_the_patterns():
    rng = random.Random(10)
    pieces = [*"ab.@%+-_ ()0123456789é\n", "1.2.3.4", "a@b.c", "4111 1111 1111 1111", "+1 (017) 555-7713", "@"]
    for _ in range(8000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t)


def test_op10_random_field(spark, docs, none):
    model = crf.train()
    finder = pii.Finder(model)
    rng = random.Random(11)
    pieces = ["the", "house", "at", "dot", "555", "(017)", "tel", "a@b", "(at)", "mail", "1.2.3.4", "big", "cat", "of"]
    texts = [" ".join(rng.choice(pieces if rng.random() < 0.3 else pieces[-3:]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    t = grid.Texts(pa.array(texts), fold=True)
    starts, ends, off = t.words()
    codes, special = crf.shape_codes(t, starts, ends, crf._cue_table())
    whole = model.decode(model.scores(codes, np.arange(len(codes)), off), np.diff(off)[np.diff(off) > 0])
    assert (model.label(codes, special, off) == whole).all()  # the pruned search is the full one
    found = finder.spans(pa.array(["please email tom at corp dot net thanks", "é my tel is (415) 555 9876 call me", "nothing to see here", None]))
    assert [[(crf.KINDS[k], base) for k, _, _, base in s] for s in found] == [[("email", False)], [("phone", False)], [], []]
    rows = pii.pii_spans(docs).collect()
    assert len(rows) == docs.count()
    texts = {r[0]: r[1] for r in edge_rows()}
    for r in rows:
        if r["doc_id"] is not None:
            base = [(crf.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if s["base"]]
            assert base == plain_spans(texts[r["doc_id"]] or "")
    clean = {r["doc_id"]: r["text"] for r in pii.scrubbed(docs, columns=("doc_id", "score")).collect()}
    assert clean[11] == "mail <EMAIL> or <PHONE>, <IP> and <CARD>" and clean[1] is None and clean[9] == texts[9]
    assert pii.pii_spans(none).count() == 0


def test_op10_long_runs_are_fast():
    assert pii.base_spans("1" * 50_000 + " " + "a" * 50_000 + "@" + "+" * 50_000) == []


def test_pretokens_cover_the_text():
    t = grid.Texts(pa.array(["a  b\n\nc's", "", None, "x"]))
    starts, ends, off = pretokens.pretoken_spans(t)
    assert [t.buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", " ", " b", "\n", "\n", "c", "'s", "x"] and list(off) == [0, 7, 7, 7, 8]


def test_queries_have_the_named_columns(spark, tmp_path):
    from asofspark.llm import queries

    rows = spark.createDataFrame(edge_rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_pii(spark, str(tmp_path)).where("doc_id = 11").first()
    spans = ",".join(f"{crf.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(edge_rows()[10][1]))
    assert got["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and got["spans"] == spans
    assert (got["n_email"], got["n_ip"], got["n_card"], got["n_phone"]) == (1, 1, 1, 1)
