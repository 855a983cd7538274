"""Operator 9: hierarchical language identification.

A text's byte 1-, 2- and 3-gram frequencies (hashed) first decide its language family;
one-versus-one linear support vector machines then separate the languages of that family.
All machines are linear in the frequencies, so a text's margins are the means of their
weights over its bytes: one pass over the whole text, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid
from asofspark.llm.storage import share_of

#: Language families by code (fixed values); a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga"],
    "finnic": ["et", "fi"],
    "indic": ["bn", "hi", "mr", "ne", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


def family_of(code: str) -> str:
    """Family of a code, by its part before a region or script (``pt-BR`` as ``pt``)."""
    plain = code.replace("_", "-").split("-")[0].lower()
    return _FAMILY.get(plain, f"={plain}")


#: Training texts a language, and of all languages together, at most (about; chosen by a hash of doc_id).
PER_LANGUAGE, IN_ALL = 400, 4000
#: Languages at most (an error beyond it): every two families, and every two languages of a family, have a machine.
MAX_LANGUAGES = 200
BITS_2, BITS_3 = 11, 12
DIMENSIONS = 256 + (1 << BITS_2) + (1 << BITS_3)
COST, EPOCHS, SLOPE = 10.0, 30, 3.0
_K2, _K3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def ngram_slots(t: grid.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 1-, 2- and 3-gram that end at each byte; grams don't reach before a text's start."""
    b = t.buf.astype(np.uint32)
    begins = t.off[:-1][np.diff(t.off) > 0]
    one = np.zeros_like(b)
    one[1:] = b[:-1]
    one[begins] = 0
    two = np.zeros_like(b)
    two[1:] = one[:-1]
    two[begins] = 0
    pair = (one << np.uint32(8)) | b
    second = ((pair * _K2) >> np.uint32(32 - BITS_2)) + np.uint32(256)
    third = ((((two << np.uint32(16)) | pair) * _K3) >> np.uint32(32 - BITS_3)) + np.uint32(256 + (1 << BITS_2))
    return b, second, third


def frequencies(column: pa.Array) -> np.ndarray:
    """(texts, DIMENSIONS) float32; a text without bytes is a row of zeros."""
    t = grid.Texts(column, fold=True)
    out = np.zeros((t.n, DIMENSIONS), dtype=np.float32)
    for slots in ngram_slots(t):
        for k in range(t.n):
            part = slots[t.off[k] : t.off[k + 1]]
            if len(part):
                out[k] += np.bincount(part, minlength=DIMENSIONS).astype(np.float32) / len(part)
    return out


def support_vector_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine (squared hinge loss) by dual coordinate descent; y is -1 or 1."""
    gram = x @ x.T + 1.0
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    balance = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2
    ridge = 1 / (2 * COST * np.maximum(balance, 1e-3))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            g = y[i] * f[i] - 1 + ridge[i] * alpha[i]
            new = max(0.0, alpha[i] - g / (gram[i, i] + ridge[i]))
            if new != alpha[i]:
                f += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    w = (alpha * y) @ x
    return w, float((alpha * y).sum())


class LanguageModel:
    """Machines between pairs of families and between pairs of languages of a family."""

    def __init__(self, families: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, offsets: np.ndarray):
        self.families, self.pairs = families, {p: k for k, p in enumerate(pairs)}
        self.weights, self.offsets = weights, offsets

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> LanguageModel:
        families: dict[str, list[str]] = {}
        for code in sorted(set(langs)):
            families.setdefault(family_of(code), []).append(code)
        scale = 1 / (np.sqrt(x.mean(axis=0)) + 0.02) if len(x) else np.ones(DIMENSIONS)
        x = x * scale
        family = np.array([family_of(c) for c in langs])
        jobs = [(a, b, family) for a, b in combinations(sorted(families), 2)]
        jobs += [(a, b, langs) for codes in families.values() for a, b in combinations(codes, 2)]
        weights, offsets = np.zeros((DIMENSIONS, len(jobs)), dtype=np.float32), np.zeros(len(jobs))
        for k, (a, b, names) in enumerate(jobs):
            rows = np.flatnonzero((names == a) | (names == b))
            w, offsets[k] = support_vector_machine(x[rows].astype(np.float64), np.where(names[rows] == a, 1.0, -1.0))
            weights[:, k] = w * scale
        return cls(families, [(a, b) for a, b, _ in jobs], weights, offsets)

    def margins(self, column: pa.Array) -> np.ndarray:
        """(texts, machines): mean weight of each text's grams, plus the offsets."""
        t = grid.Texts(column, fold=True)
        out = np.zeros((t.n, len(self.pairs))) + self.offsets
        full = np.flatnonzero(np.diff(t.off))
        if len(full) and self.pairs:
            one, two, three = ngram_slots(t)
            for k in range(len(self.pairs)):
                w = np.ascontiguousarray(self.weights[:, k])
                sums = np.add.reduceat((w[one] + w[two] + w[three]).astype(np.float64), t.off[full])
                out[full, k] += sums / np.diff(t.off)[full]
        return out

    def _vote(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes (then the largest sum of confidences), and its mean confidence."""
        sure = np.zeros((len(margins), len(names)))
        votes = np.zeros_like(sure)
        for i, j in combinations(range(len(names)), 2):
            p = 1 / (1 + np.exp(-SLOPE * np.clip(margins[:, self.pairs[names[i], names[j]]], -20, 20)))
            sure[:, i] += p
            sure[:, j] += 1 - p
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
        best = (votes * len(names) + sure / max(1, len(names))).argmax(axis=1)
        return best, sure[np.arange(len(margins)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(margins))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        n = len(column)
        if not names:
            return [UNKNOWN] * n, np.zeros(n)
        margins = self.margins(column)
        family, score = self._vote(margins, names)
        out = np.empty(n, dtype=object)
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            which, sure = self._vote(margins[rows], self.families[name])
            out[rows] = np.array(self.families[name], dtype=object)[which]
            score[rows] *= sure
        return out.tolist(), score


def lettered(column: pa.Array) -> np.ndarray:
    """Texts with a letter; null texts have none."""
    t = grid.Texts(column)
    out = t.sums((grid.LOWER | grid.UPPER)[t.buf]) > 0
    for k in np.flatnonzero(~out & (np.diff(t.off) > 0)):
        out[k] = any(c.isalpha() for c in column[k].as_py())
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on about PER_LANGUAGE texts a language, IN_ALL at most, of rows with a language that aren't held out.

    Texts are chosen by a hash of the text, copies once, so that their number has no other
    bound to meet.  More than MAX_LANGUAGES different languages raise ValueError.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.xxhash64(F.lit("lang"), F.col(text)).alias("_h"))
    found = known.groupBy("_lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).orderBy("_lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    most = min(PER_LANGUAGE, IN_ALL // max(1, len(found)))
    chosen = F.lit(False)
    for r in found:
        chosen = chosen | ((F.col("_lang") == r["_lang"]) & share_of(F.col("_h"), most / max(1, r["n"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_text"):
            texts = piece.column(0)
            rows = [v.tobytes() for v in frequencies(texts)]
            yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array(rows, pa.binary())], names=["_lang", "_h", "x"]).filter(pa.array(lettered(texts)))

    once = known.where(chosen).dropDuplicates(["_lang", "_h"])
    sample = once.mapInArrow(run, "_lang string, _h long, x binary").toPandas().sort_values(["_lang", "_h"])
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in sample["x"]]) if len(sample) else np.zeros((0, DIMENSIONS), np.float32)
    return LanguageModel.fit(x, sample["_lang"].to_numpy(dtype=object).astype(str))


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no
    language can be learned.  Of names with equal votes and equal confidence, the first in
    code-point order wins.  Texts of any length are read whole.  Repeated rows give repeated
    results; a null doc_id stays null; an empty table gives an empty result; extra columns
    are ignored.  More than MAX_LANGUAGES languages raise ValueError.
    """
    model = fit_languages(docs, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_text"):
            texts = piece.column(2)
            names, score = model.predict(texts)
            some = lettered(texts)
            names = [n if s else UNKNOWN for n, s in zip(names, some, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), docs[text].alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
