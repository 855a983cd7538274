"""Operator 1: rules on text statistics, and robust multivariate outliers.

Texts that pass two plain rules are judged by a minimum-covariance-determinant (MCD)
estimate of their language and source: the mean and covariance of the share CORE of the
group's statistic vectors that lies most closely together.  A text whose Mahalanobis
distance from it is too large is rejected.

The estimate is a deterministic FAST-MCD.  Three starts (quartile ranges alone; with
the correlations of hyperbolic tangents; with those of spatial signs) each take two concentration
steps, the one with the least determinant goes on, and the rows within a normal quantile
of it give the final, reweighted estimate.  Every language and source has an estimate of
its own.  As in the regularized form of MCD, its covariance is a sum of the group's and a
target's, the target being the robust scatter of its language (and a language's that of
all rows); the group's part is n / (n + STEADY), so it goes to 1 with n rows and no size is
a switch.  A step is two grouped aggregates over all rows (counts of distances in bins of
equal ratio, then the moments of the rows below their quantile), so any group, however
large, is reduced by partial aggregation and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm.stats import text_counts
from asofspark.llm.storage import stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a group's rows that an estimate is made of.
CORE = 0.75
#: Concentration steps of each start, and of the best one after them.
STEPS = (2, 2)
STARTS = 3
#: Rows at which a group's own estimate and its target's have equal parts.
STEADY = 50.0
#: Groups up to which their estimates are broadcast; beyond it a group's rows are dealt over SALTS keys.
SMALL_TABLE, SALTS = 20_000, 32
#: Bins of distances for each factor e, and of a coordinate for each unit.
BINS_A_UNIT, BINS_A_STEP = 64, 256
#: Spread that a coordinate has at least (coordinates that are 0 for nearly all texts have no spread of their own).
FLOOR = 0.03
#: A text is rejected beyond this squared distance: twice the chi-squared quantile of 1 - 1e-9 with 7 degrees of
#: freedom (statistics of texts have heavier tails than normal vectors).
CUT = 120.0
#: Ratios that make the covariance of the inner CORE, and of the rows within WITHIN, consistent for normal vectors of 7 dimensions.
CONSISTENT, CONSISTENT_WITHIN = 1.33, 1.04
#: Chi-squared quantile of 0.975 with 7 degrees of freedom: rows within it give the final estimate.
WITHIN = 16.01
#: Words or characters of a typical text added to each ratio, which steadies short texts.
PRIOR = 30.0

NAMES = ["z0", "z1", "z2", "z3", "z4", "z5", "z6"]
P = len(NAMES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in _PAIRS]
_CENTRE, _COV = [f"c{i}" for i in range(P)], [f"t{i}_{j}" for i, j in _PAIRS]
_PARAMS = [f"m{i}" for i in range(P)] + [f"v{i}_{j}" for i, j in _PAIRS]


def vectors() -> list[Column]:
    """The transformed statistics: logarithms of sizes, arcsines of roots of shares."""
    n = F.col("n_words")

    def share(k: Column, total: Column, usual: float) -> Column:
        return F.asin(F.sqrt(F.least((k + PRIOR * usual) / (total + PRIOR), F.lit(1.0))))

    letters = F.col("n_upper") + F.col("n_lower") + F.col("n_high")
    return [
        F.log((F.col("word_chars") + PRIOR * 5.0) / (n + PRIOR)),
        share(F.col("n_symbols"), n, 0.0),
        share(F.col("n_upper"), letters, 0.03),
        share(F.col("n_short"), n, 0.35),
        share(F.col("n_punct"), n, 0.12),
        share(F.col("n_same_next"), n, 0.01),
        share(F.col("n_dup_lines"), F.col("n_lines"), 0.0),
    ]


def _symmetric(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """(rows, P, P) from the columns of the pairs."""
    out = np.zeros((b.num_rows, P, P))
    for (i, j), c in zip(_PAIRS, names, strict=True):
        out[:, i, j] = out[:, j, i] = b.column(c).to_numpy(zero_copy_only=False)
    return out


def _stacked(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def _levels() -> Column:
    """A row's three groups: all rows, its language, its language and source."""
    return F.array(F.lit("[]"), F.to_json(F.array("_l")), F.to_json(F.array("_l", "_s")))


def _quartiles(x: DataFrame) -> DataFrame:
    """grp, n, and the quartiles of each coordinate: a0_0, a0_1, a0_2, a1_0, ...

    They are read from counts in bins of equal width, linear within a bin.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(z) * BINS_A_STEP).alias("bin")) for i, z in enumerate(NAMES)])).alias("e")
    # Bins are counted for languages and sources first; the wider groups are sums of these counts.
    bins = x.select("_l", "_s", each).groupBy("_l", "_s", "e.i", "e.bin").agg(F.count(F.lit(1)).alias("k"))
    bins = bins.select(F.explode(_levels()).alias("grp"), "i", "bin", "k").groupBy("grp", "i", "bin").agg(F.sum("k").alias("k"))
    w = Window.partitionBy("grp", "i")
    upto = bins.withColumns({"upto": F.sum("k").over(w.orderBy("bin")), "n": F.sum("k").over(w)})
    at = [(F.min(F.when(F.col("upto") >= q * F.col("n"), F.struct("bin", ((F.col("bin") + 1 - (F.col("upto") - q * F.col("n")) / F.col("k")) / BINS_A_STEP).alias("v")))))["v"].alias(f"a{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    rows = upto.groupBy("grp", "i").agg(F.max("n").alias("n"), *at)
    return rows.groupBy("grp").agg(F.max("n").alias("n"), *[F.expr(f"max(CASE WHEN i = {i} THEN a{k} END) AS a{i}_{k}") for i in range(P) for k in range(3)])


def _scatter(x: DataFrame, quartiles: DataFrame, small: bool) -> DataFrame:
    """grp, n, quartiles, and sums of products of tanh (h*) and of spatial signs (g*) of the standardized coordinates."""
    rows = _with(x.select(F.explode(_levels()).alias("grp"), "salt", *NAMES), quartiles, small)
    rows = rows.selectExpr("grp", "salt", *[f"({z} - a{i}_1) / sqrt(pow((a{i}_2 - a{i}_0) / 1.349, 2) + {FLOOR**2}) AS u{i}" for i, z in enumerate(NAMES)])
    rows = rows.selectExpr("*", " + ".join(f"u{i} * u{i}" for i in range(P)) + " + 1e-12 AS norm", *[f"tanh(u{i}) AS w{i}" for i in range(P)])
    sums = [f"sum(w{i} * w{j}) AS h{i}_{j}" for i, j in _PAIRS] + [f"sum(u{i} * u{j} / norm) AS g{i}_{j}" for i, j in _PAIRS]
    return quartiles.join(_summed(rows, ["grp"], [*map(F.expr, sums)]), "grp")


def _summed(rows: DataFrame, by: list[str], sums: list[Column]) -> DataFrame:
    """Sums of each group, first within its salts."""
    parts = rows.groupBy(*by, "salt").agg(*sums)
    return parts.groupBy(*by).agg(*[F.expr(f"sum({c}) AS {c}") for c in parts.columns[len(by) + 1 :]])


def _with(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """Rows with their group's parameters; a group's rows are dealt over SALTS keys where these aren't broadcast."""
    if small:
        return rows.join(F.broadcast(params), "grp")
    return rows.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "salt"])


def _correlation(sums: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.einsum("kii->ki", sums), 1e-12))
    return sums / (d[:, :, None] * d[:, None, :])


def _steadied(own: np.ndarray, other: np.ndarray, n: np.ndarray, steady: float) -> np.ndarray:
    part = n / (n + steady)
    part = part.reshape(-1, *[1] * (own.ndim - 1))
    return part * own + (1 - part) * other


def _starts(scatter: DataFrame, steady: float) -> DataFrame:
    """grp, start, n, the target (c*, t*) and the first estimate (m*, v*) of each language and source.

    The parameters of a language and of all rows are joined by name; a language's
    target is steadied by that of all rows, a source's start by its language's target.
    """
    parts = F.from_json("grp", "array<string>")
    one = scatter.withColumn("_part", parts)
    wide = lambda size, prefix: one.where(F.size("_part") == size).select(*([F.col("_part")[0].alias("_l")] if size else []), *[F.col(c).alias(prefix + c) for c in scatter.columns if c != "grp"])
    own = one.where(F.size("_part") == 2).withColumn("_l", F.col("_part")[0]).drop("_part")
    known = own.join(wide(1, "l_"), "_l").crossJoin(F.broadcast(wide(0, "r_"))).drop("_l")  # one row at the root
    kinds = f"grp string, start int, n long, {', '.join(f'{c} double' for c in [*_CENTRE, *_COV, *_PARAMS])}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for prefix in ("r_", "l_", ""):
                q = _stacked(b, [f"{prefix}a{i}_{k}" for i in range(P) for k in range(3)]).reshape(-1, P, 3)
                n = b.column(f"{prefix}n").to_numpy().astype(float)
                scale = np.sqrt(((q[:, :, 2] - q[:, :, 0]) / 1.349) ** 2 + FLOOR**2)
                spread = scale[:, :, None] * scale[:, None, :]
                tanh, sign = (_correlation(_symmetric(b, [f"{prefix}{c}{i}_{j}" for i, j in _PAIRS])) for c in "hg")
                centre, covs = q[:, :, 1], [np.eye(P) * spread, tanh * spread, sign * spread]
                if prefix != "r_":
                    centre = _steadied(centre, found["centre"], n, steady)
                    covs = [_steadied(c, found["cov"], n, steady) for c in covs]
                if prefix:
                    found = {"centre": centre, "cov": covs[1]}
            for k, cov in enumerate(covs):
                inv = np.linalg.inv(cov + np.eye(P) * FLOOR**2)
                cols = [pa.array(v) for v in (*found["centre"].T, *(found["cov"][:, i, j] for i, j in _PAIRS), *centre.T, *(inv[:, i, j] for i, j in _PAIRS))]
                yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(np.full(len(inv), k, np.int32)), b.column("n"), *cols], names=["grp", "start", "n", *_CENTRE, *_COV, *_PARAMS])

    return known.mapInArrow(run, kinds)


def _distance() -> Column:
    """Squared Mahalanobis distance, written as SQL: so many terms take long to build one by one."""
    return F.expr(" + ".join(f"{1 if i == j else 2} * v{i}_{j} * (z{i} - m{i}) * (z{j} - m{j})" for i, j in _PAIRS))


def _edges(near: DataFrame) -> DataFrame:
    """Squared distance below which CORE of a group lies for each start, from counts in bins of equal ratio (a fixed number of them)."""
    bins = near.select("grp", "start", F.floor(F.log(F.greatest(F.least("d2", F.lit(1e9)), F.lit(1e-6))) * BINS_A_UNIT).alias("bin")).groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("grp", "start")
    passed = bins.withColumns({"upto": F.sum("k").over(w.orderBy("bin")), "all": F.sum("k").over(w)}).where(F.col("upto") >= CORE * F.col("all"))
    return passed.groupBy("grp", "start").agg(F.exp((F.min("bin") + 1) / BINS_A_UNIT).alias("edge"))


def _refined(moments: DataFrame, params: DataFrame, ratio: float, steady: float) -> DataFrame:
    """The estimates of ``params`` renewed from sums of their rows, with the logarithm of each determinant."""
    rows = params.select("grp", "start", "n", *_CENTRE, *_COV).join(moments, ["grp", "start"])
    kinds = f"grp string, start int, n long, {', '.join(f'{c} double' for c in [*_CENTRE, *_COV, *_PARAMS])}, det double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = b.column("n").to_numpy().astype(float), np.maximum(b.column("k").to_numpy().astype(float), 1)
            mean = _stacked(b, _SUMS[:P]) / k[:, None]
            cov = (_symmetric(b, _SUMS[P:]) / k[:, None, None] - mean[:, :, None] * mean[:, None, :]) * ratio
            mean = _steadied(mean, _stacked(b, _CENTRE), n, steady)
            cov = _steadied(cov, _symmetric(b, _COV), n, steady) + np.eye(P) * FLOOR**2
            inv = np.linalg.inv(cov)
            cols = [pa.array(v) for v in (*mean.T, *(inv[:, i, j] for i, j in _PAIRS), np.linalg.slogdet(cov)[1])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["grp", "start", "n", *_CENTRE, *_COV]), *cols], names=["grp", "start", "n", *_CENTRE, *_COV, *_PARAMS, "det"])

    return rows.mapInArrow(run, kinds)


def _moments(inside: DataFrame) -> DataFrame:
    sums = [f"sum({z}) AS s{i}" for i, z in enumerate(NAMES)] + [f"sum({NAMES[i]} * {NAMES[j]}) AS q{i}_{j}" for i, j in _PAIRS]
    return _summed(inside, ["grp", "start"], [F.count(F.lit(1)).alias("k"), *map(F.expr, sums)])


def estimates(x: DataFrame, steady: float = STEADY) -> tuple[DataFrame, bool]:
    """Robust mean and inverse covariance (m*, v*) of each group, from rows of _l, _s, salt and z*; and whether they are few."""
    quartiles = stored(_quartiles(x))
    small = quartiles.count() <= SMALL_TABLE
    params = stored(_starts(stored(_scatter(x, quartiles, small)), steady))
    rows = x.select(F.to_json(F.array("_l", "_s")).alias("grp"), "salt", *NAMES)
    for k in range(sum(STEPS)):
        if k == STEPS[0]:
            best = F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))
            params = stored(params.withColumn("_best", best).where("_best = 1").drop("_best"))
        edge = _edges(_with(rows, params, small).withColumn("d2", _distance()))
        inside = _with(rows, params.join(edge, ["grp", "start"]), small).where(_distance() <= F.col("edge"))
        params = stored(_refined(_moments(inside), params, CONSISTENT, steady))
    inside = _with(rows, params, small).where(_distance() <= WITHIN)
    last = _refined(_moments(inside), params, CONSISTENT_WITHIN, steady).select("grp", *_PARAMS)
    # A group none of whose rows lies within the quantile keeps its last estimate.
    return stored(last.unionByName(params.join(last.select("grp"), "grp", "left_anti").select("grp", *_PARAMS))), small


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, distance (squared; null where the base rules fail).

    A null text counts as empty, and fails the base rules.  A null language or source is
    a group of its own.  A document alone in its group is judged by its language, or by
    all rows.  Texts of any length are read whole.  Repeated rows give repeated results, a null
    doc_id stays null, an empty table gives an empty result; extra columns are ignored.
    """
    counts = text_counts(docs, text, keep=("doc_id", lang, source))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", "n_chars"), F.lit(SALTS)).cast("int")
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    marked = counts.withColumns({"base_failed": failed, "salt": salt, "_l": tag(lang), "_s": tag(source)}).withColumns(dict(zip(NAMES, vectors(), strict=True)))
    x = stored(marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_l", "_s", "salt", *NAMES))
    params, small = estimates(x.where("not base_failed"))
    rows = x.withColumn("grp", F.to_json(F.array("_l", "_s")))
    keys = ["grp"] if small else ["grp", "salt"]
    known = F.broadcast(params) if small else params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = rows.join(known, keys, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"),
        F.round("distance", 6).alias("distance"),
    )
