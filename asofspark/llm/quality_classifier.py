"""Operator 4: sparse rule ensemble for document quality.

Shallow boosted trees over text statistics give many paths; each path is a conjunctive
rule.  A lasso-penalized logistic regression keeps few of them, and what is kept is
compiled into one Spark column expression, so scoring runs in generated JVM code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm.stats import text_counts
from asofspark.llm.storage import share_of

#: Labelled rows that a model is fitted on at most (about; chosen by a hash of doc_id).
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, SHRINK = 24, 3, 32, 0.3
MIN_LEAF = 8
LASSO, ITERATIONS = 0.002, 400

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), ...


def features() -> dict[str, Column]:
    """Statistics as columns over COUNTS; every one is defined for empty texts."""
    c = F.col
    words, letters = c("n_words") + F.lit(1.0), c("n_upper") + c("n_lower") + c("n_high") + F.lit(1.0)
    return {
        "log_words": F.log(words),
        "mean_word": c("word_chars") / words,
        "symbols": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines") / (c("n_lines") + F.lit(1.0)),
        "repeat_words": c("n_repeat_words") / words,
        "words_a_line": F.log(words / (c("n_lines") + F.lit(1.0))),
        "upper": c("n_upper") / letters,
        "high": c("n_high") / letters,
        "digits": c("n_digits") / (c("n_chars") + F.lit(1.0)),
        "punct": c("n_punct") / words,
        "short": c("n_short") / words,
        "long": c("n_long") / words,
        "distinct": F.log(c("n_distinct") + F.lit(1.0)) / F.log(words + 1.0),
        "same_next": c("n_same_next") / words,
    }


FEATURES = [
    "log_words", "mean_word", "symbols", "dup_lines", "repeat_words", "words_a_line", "upper", "high",
    "digits", "punct", "short", "long", "distinct", "same_next",
]


def _splits(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between neighbouring quantiles."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _best_split(binned: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    best = (1e-6, -1, -1)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        b = binned[rows, f]
        n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
        left_g = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
        left_h = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
        gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    return best


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """All paths (to inner nodes and leaves) of a short sequence of boosted trees."""
    cuts = _splits(x)
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    margin, rules = np.zeros(len(y)), dict.fromkeys([])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            below = []
            for path, rows in level:
                _, f, k = _best_split(binned, cuts, rows, g, h) if depth < DEPTH else (0, -1, -1)
                if f < 0:
                    margin[rows] += SHRINK * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                above = binned[rows, f] > k
                for side in (False, True):
                    rule = tuple(sorted({*path, (f, side, float(cuts[f][k]))}))
                    rules[rule] = None
                    below.append((rule, rows[above == side]))
            level = below
    return list(rules)


def apply_rules(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float64)
    for k, rule in enumerate(rules):
        for f, above, at in rule:
            out[:, k] *= (x[:, f] > at) if above else (x[:, f] <= at)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps."""
    full = np.column_stack([np.ones(len(y)), a])
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = ahead = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(ITERATIONS):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ ahead, -40, 40))) - y) / len(y)
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


class RuleModel:
    """A sparse sum of rules; ``score()`` is its column expression over FEATURES."""

    def __init__(self, intercept: float, rules: list[Rule], weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        """With one class only, or no row at all, the model is the smoothed share of label 1."""
        if len(y) < 2 * MIN_LEAF or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(float(np.log(p / (1 - p))), [], [])
        rules = grow_rules(x, y)
        b, w = lasso_logistic(apply_rules(rules, x), y)
        kept = [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4]
        return cls(b, [r for r, _ in kept], [v for _, v in kept])

    def score(self) -> Column:
        names, total = FEATURES, F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for f, above, at in rule:
                met = met & ((F.col(names[f]) > at) if above else (F.col(names[f]) <= at))
            total = total + F.when(met, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def featured(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and FEATURES of every row; kept columns may have names of statistics."""
    own = [f"_kept{i}" for i in range(len(keep))]
    named = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, own, strict=True)], *([] if text in keep else [F.col(text).alias("_whole")]))
    counted = text_counts(named, own[keep.index(text)] if text in keep else "_whole", tuple(own))
    return counted.select(*[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)], *[v.alias(k) for k, v in features().items()])


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality") -> RuleModel:
    """Fits on about MAX_LABELLED documents that carry a label and are not held out.

    The chosen ids, whose number that parameter bounds, are broadcast; so only the sample's
    statistics are computed and sent to the driver, once for each id.  Labels that repeat an
    id count by their majority (1 if even).
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    chosen = known.where(share_of(F.xxhash64(F.lit("fit"), "doc_id"), MAX_LABELLED / max(1, known.count())))
    sample = featured(docs.select("doc_id", docs[text].alias("text")).join(F.broadcast(chosen), "doc_id"), "text", ("doc_id", "_y"))
    one = sample.groupBy("doc_id").agg(F.min(F.struct("_y", *FEATURES)).alias("_row"))  # so many rows as ids, however often one stands
    rows = one.select("doc_id", "_row.*").toPandas().sort_values("doc_id")
    return RuleModel.fit(rows[FEATURES].to_numpy(dtype=float), rows["_y"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: RuleModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted of every row."""
    rows = featured(docs, text, keep).select(*keep, model.score().alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Only statistics of the whole text enter a score.  A null text counts as empty and gets
    a score too; labels of unknown documents, other than 0 and 1, or null are ignored;
    texts of any length are read whole, repeated rows give repeated results, a null doc_id
    is scored and never learned from, an empty table gives an empty result; extra columns are ignored.
    """
    model = fit_quality(docs, labels, text)
    return scored(docs, model, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
