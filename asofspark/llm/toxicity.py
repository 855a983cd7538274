"""Operator 12: toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words (runs of letters) enter the network one after the other.  Word inputs say how
much more often toxic documents hold the word; character inputs say so for its beginnings and
its end, beside learned vectors of its bytes, so that new words with a known stem count, too.
Every overlapping window of a text is read in both directions, attention weighs its words, and
the text's score is that of its worst window.  Network and training are numpy; windows of a
slice of texts go through in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm import grid

#: Words in a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 64, 32
#: Labelled documents that a model is fitted on at most, in the order of a hash of doc_id, and their characters in all.
MAX_LABELLED, MAX_CHARS = 6_000, 12_000_000
#: Bytes of a word's beginnings and of its end that are character inputs.
PREFIXES, SUFFIX = (4, 5, 6, 7, 8, 9), 4
#: Words and word parts that a model keeps at most, those with the strongest statistic.
MAX_PARTS = 60_000
HIDDEN, ATTENTION, BYTE_DIMENSIONS = 8, 8, 4
STATISTICS = 5
EPOCHS, BATCH, RATE, REFRESH = 12, 128, 0.01, 3
#: Windows that are scored at once.
WINDOWS_AT_ONCE = 8192
FLAGGED = 0.7

_LETTER = grid.byte_set(range(65, 91), range(97, 123), range(128, 256))
_KINDS = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in range(len(PREFIXES) + 2)]

Arrays = dict[str, np.ndarray]


def word_spans(t: grid.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.spans(_LETTER[t.buf])


def distinct_words(t: grid.Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each span's word number, and one span (start, end) of every word."""
    _, first, word = np.unique(t.hash_spans(starts, ends), return_index=True, return_inverse=True)
    return word, starts[first], ends[first]


def part_hashes(t: grid.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, parts) hashes of a word, of its beginnings and of its end; 0 where the word isn't longer than the part."""
    size = ends - starts
    order = np.argsort(starts)
    out = np.zeros((len(starts), len(_KINDS)), dtype=np.uint64)

    def put(k: int, begin: np.ndarray, end: np.ndarray, rows: np.ndarray) -> None:
        out[rows, k] = grid.mixed(t.hash_spans(begin[rows], end[rows]) + _KINDS[k])

    put(0, starts, ends, order)
    for k, n in enumerate(PREFIXES, 1):
        put(k, starts, starts + n, order[size[order] > n])
    put(len(PREFIXES) + 1, ends - SUFFIX, ends, order[size[order] > SUFFIX])
    return out


def byte_sums(t: grid.Texts, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of the byte vectors of each word."""
    if not len(starts):
        return np.zeros((0, table.shape[1]), np.float32)
    size = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.add.reduceat(table[t.buf[at]], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None].astype(np.float32)


def statistics(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """STATISTICS inputs of each word from the values of its parts (words, parts)."""
    parts = values[:, 1:-1]
    return np.stack([values[:, 0], parts.max(axis=1), parts.mean(axis=1), values[:, -1], np.log(size)], 1).astype(np.float32) / 2


def strength(toxic: np.ndarray, held: np.ndarray, rate: float) -> np.ndarray:
    """How far the toxic share of the documents that hold a part is from the common share, in standard errors (at most 5)."""
    return np.clip((toxic - held * rate) / np.sqrt(held * rate * (1 - rate) + 2), -5, 5).astype(np.float32)


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word (within the text) of every window; the windows cover all words, a text without words has none."""
    n = np.where(counts > 0, 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0), 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return text, first * STRIDE


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(seed: int = 7) -> Arrays:
    rng = np.random.default_rng(seed)
    d, h = STATISTICS + BYTE_DIMENSIONS, HIDDEN
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {"bytes": draw(256, BYTE_DIMENSIONS), "attend": draw(2 * h, ATTENTION), "attend_b": np.zeros(ATTENTION, np.float32), "query": draw(ATTENTION),
           "out": draw(2 * h), "out_b": np.array([-2.0], np.float32)}
    for way in ("f", "b"):
        out |= {f"w{way}": draw(d, 3 * h), f"u{way}": draw(h, 3 * h), f"bx{way}": np.zeros(3 * h, np.float32), f"bh{way}": np.zeros(3 * h, np.float32)}
    return out


def recur(p: Arrays, way: str, projected: np.ndarray, index: np.ndarray, valid: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (windows, words, HIDDEN) of one direction; ``index`` points to rows of projected word inputs.

    Where ``valid`` is 0 the state stays.  With ``keep`` the gates of every step are returned for the way back.
    """
    n, t = index.shape
    h, steps = np.zeros((n, HIDDEN), np.float32), []
    states = np.empty((n, t, HIDDEN), np.float32)
    for k in range(t) if way == "f" else range(t - 1, -1, -1):
        x, a = projected[index[:, k]], h @ p[f"u{way}"] + p[f"bh{way}"]
        gates = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r, inner = gates[:, :HIDDEN], gates[:, HIDDEN:], a[:, 2 * HIDDEN :]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
        m = valid[:, k : k + 1]
        after = h + m * (1 - z) * (new - h)
        if keep:
            steps.append((k, h, z, r, inner, new, m))
        states[:, k] = h = after
    return states, steps


def pooled(p: Arrays, states: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logit of each window by attention over its words; also what the way back needs."""
    hidden = np.tanh(states @ p["attend"] + p["attend_b"])
    weight = np.where(valid > 0, hidden @ p["query"], -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    centre = np.einsum("nt,nth->nh", weight, states)
    return centre @ p["out"] + p["out_b"][0], hidden, weight, centre


def logits(p: Arrays, inputs: np.ndarray, index: np.ndarray, valid: np.ndarray) -> np.ndarray:
    both = [recur(p, way, inputs @ p[f"w{way}"] + p[f"bx{way}"], index, valid)[0] for way in ("f", "b")]
    return pooled(p, np.concatenate(both, axis=2), valid)[0]


def gradients(p: Arrays, inputs: np.ndarray, index: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, Arrays, np.ndarray]:
    """Mean logistic loss, its gradients, and its gradient by the word inputs."""
    runs = {way: recur(p, way, inputs @ p[f"w{way}"] + p[f"bx{way}"], index, valid, keep=True) for way in ("f", "b")}
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    logit, hidden, weight, centre = pooled(p, states, valid)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g: Arrays = {"out": centre.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
    d_centre = d_logit[:, None] * p["out"]
    d_weight = np.einsum("nh,nth->nt", d_centre, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    d_hidden = d_score[:, :, None] * p["query"] * (1 - hidden**2)
    g["query"] = np.einsum("nt,nta->a", d_score, hidden)
    g["attend"], g["attend_b"] = np.einsum("nth,nta->ha", states, d_hidden), d_hidden.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_centre[:, None, :] + d_hidden @ p["attend"].T
    d_inputs = np.zeros_like(inputs)
    for way, (_, steps) in runs.items():
        mine = d_states[:, :, :HIDDEN] if way == "f" else d_states[:, :, HIDDEN:]
        u = p[f"u{way}"]
        d_h, d_u, d_bh = np.zeros((len(index), HIDDEN), np.float32), np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
        d_projected = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
        for k, h, z, r, inner, new, m in reversed(steps):
            total = d_h + mine[:, k]
            step = total * m
            d_new = step * (1 - z) * (1 - new**2)
            d_z = step * (h - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            by_h = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_u += h.T @ by_h
            d_bh += by_h.sum(axis=0)
            np.add.at(d_projected, index[:, k], np.concatenate([d_z, d_r, d_new], axis=1))
            d_h = total * (1 - m) + step * z + by_h @ u.T
        g |= {f"u{way}": d_u, f"bh{way}": d_bh, f"w{way}": inputs.T @ d_projected, f"bx{way}": d_projected.sum(axis=0)}
        d_inputs += d_projected @ p[f"w{way}"].T
    return loss, g, d_inputs


class ToxicityModel:
    """Network weights ``p`` and the strengths of words and word parts (sorted hashes); ``prior`` is the score without words."""

    def __init__(self, p: Arrays, parts: np.ndarray, values: np.ndarray, prior: float):
        self.p, self.parts, self.values, self.prior = p, parts, values, prior

    @classmethod
    def fit(cls, texts: list[str | None], y: np.ndarray) -> ToxicityModel:
        """Without both labels, or without words, every text gets the smoothed share of label 1.

        What a training document says about its own words is left out of their strengths while the network is
        trained.  A document teaches by its worst two windows, chosen anew every REFRESH epochs, and a drawn one.
        """
        prior = float((y.sum() + 1) / (len(y) + 2))
        t = grid.Texts(pa.array(texts, pa.large_string()), fold=True)
        starts, ends, off = word_spans(t)
        if not len(starts) or y.min() == y.max():
            return cls({}, np.zeros(0, np.uint64), np.zeros(0, np.float32), prior)
        word, w_start, w_end = distinct_words(t, starts, ends)
        hashes = part_hashes(t, w_start, w_end)
        parts, part_of = np.unique(hashes, return_inverse=True)
        part_of = part_of.reshape(hashes.shape)
        held, toxic = np.zeros(len(parts)), np.zeros(len(parts))
        for k in range(len(texts)):
            mine = np.unique(part_of[np.unique(word[off[k] : off[k + 1]])])
            held[mine] += 1
            toxic[mine] += y[k]
        none = parts == 0
        rate, size = float(y.mean()), w_end - w_start

        def inputs_of(label: int | None) -> np.ndarray:
            own, one = (0, 0) if label is None else (label, 1)
            value = strength(toxic - own, held - one, rate)
            value[none] = 0
            return statistics(value[part_of], size)

        fixed = np.concatenate([inputs_of(0), inputs_of(1)])  # a word of a document of label 1 is word + len(size)
        text, first = window_starts(np.diff(off))
        slots = first[:, None] + np.arange(WINDOW)
        valid = (slots < np.diff(off)[text][:, None]).astype(np.float32)
        index = word[np.minimum(off[text][:, None] + slots, off[text + 1][:, None] - 1)] + (y[text] * len(size)).astype(np.int64)[:, None]
        p = cls._train(t, (w_start, w_end), fixed, text, index, valid, y)
        value = strength(toxic, held, rate)
        value[none] = 0
        best = np.sort(np.lexsort((parts, -np.abs(value)))[:MAX_PARTS])
        return cls(p, parts[best], value[best], prior)

    @staticmethod
    def _train(t: grid.Texts, spans: tuple[np.ndarray, np.ndarray], fixed: np.ndarray, text: np.ndarray, index: np.ndarray, valid: np.ndarray, y: np.ndarray) -> Arrays:
        p, rng, n_words = initial(), np.random.default_rng(11), len(spans[0])
        first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        window_of = np.searchsorted(text, np.arange(len(y) + 1))
        docs, step = np.flatnonzero(np.diff(window_of)), 0
        for epoch in range(EPOCHS):
            if epoch % REFRESH == 0:
                if epoch:
                    means = np.tile(byte_sums(t, *spans, p["bytes"]), (2, 1))
                    inputs = np.concatenate([fixed, means], axis=1)
                    level = np.concatenate([logits(p, inputs, index[a : a + WINDOWS_AT_ONCE], valid[a : a + WINDOWS_AT_ONCE]) for a in range(0, len(text), WINDOWS_AT_ONCE)])
                else:
                    level = ((fixed[:, 0] + fixed[:, 1])[index] * valid).sum(axis=1)
                order = np.lexsort((-level, text))
                top = order[window_of[docs]]
                next_top = order[np.minimum(window_of[docs] + 1, window_of[docs + 1] - 1)]
            drawn = window_of[docs] + (rng.random(len(docs)) * np.diff(window_of)[docs]).astype(np.int64)
            clean = y[docs] == 0  # a drawn window of a toxic document may be clean
            batch_of = rng.permutation(np.concatenate([top, next_top[clean], drawn[clean]]))
            for a in range(0, len(batch_of), BATCH):
                rows = batch_of[a : a + BATCH]
                used, local = np.unique(index[rows], return_inverse=True)
                own = used % n_words
                means = byte_sums(t, spans[0][own], spans[1][own], p["bytes"])
                _, g, d_inputs = gradients(p, np.concatenate([fixed[used], means], axis=1), local.reshape(len(rows), WINDOW), valid[rows], y[text[rows]])
                size = (spans[1] - spans[0])[own]
                at = np.repeat(spans[0][own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                spread = np.repeat(d_inputs[:, STATISTICS:] / size[:, None], size, axis=0)
                g["bytes"] = np.stack([np.bincount(t.buf[at], spread[:, k], 256) for k in range(BYTE_DIMENSIONS)], 1).astype(np.float32)
                step += 1
                for k, d in g.items():
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.001 * (d * d - second[k])
                    p[k] = (p[k] - RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return p

    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each text of an Arrow string array: the largest over all its windows."""
        t = grid.Texts(column, fold=True)
        out = np.full(t.n, -np.inf)
        starts, ends, off = word_spans(t)
        if self.p and len(starts):
            text, first = window_starts(np.diff(off))
            begin = off[text] + first
            until = np.minimum(begin + WINDOW, off[text + 1])
            for a in range(0, len(text), WINDOWS_AT_ONCE):
                rows = slice(a, a + WINDOWS_AT_ONCE)
                lo, hi = int(begin[rows][0]), int(until[rows].max())
                word, w_start, w_end = distinct_words(t, starts[lo:hi], ends[lo:hi])
                slots = begin[rows][:, None] + np.arange(WINDOW)
                valid = (slots < until[rows][:, None]).astype(np.float32)
                index = word[np.minimum(slots, until[rows][:, None] - 1) - lo]
                np.maximum.at(out, text[rows], logits(self.p, self._inputs(t, w_start, w_end), index, valid))
        return np.where(np.isneginf(out), self.prior, sigmoid(np.clip(out, -40, 40)))

    def _inputs(self, t: grid.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = part_hashes(t, starts, ends)
        place = np.minimum(np.searchsorted(self.parts, hashes), max(len(self.parts) - 1, 0))
        values = np.where(self.parts[place] == hashes, self.values[place], np.float32(0))
        return np.concatenate([statistics(values, ends - starts), byte_sums(t, starts, ends, self.p["bytes"])], axis=1)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fits on the first MAX_LABELLED documents, in the order of a hash, that carry a label and aren't held out.

    Labels that repeat an id count by their majority (1 if even), texts that repeat it by the least.  The sample's ids
    are broadcast, their number is bounded; its documents are taken whole until they hold MAX_CHARS characters (the first one always).
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = known.withColumn("_o", order).orderBy("_o", "doc_id").limit(MAX_LABELLED)
    sized = docs.select("doc_id", F.length(text).alias("_n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_o").agg(F.max("_n").alias("_n"))
    room, ids = MAX_CHARS, []
    for row in sized.orderBy("_o", "doc_id").collect():  # MAX_LABELLED rows at most
        room -= row["_n"] or 0
        if room < 0 and ids:
            break
        ids.append(row["doc_id"])
    mine = chosen.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")
    rows = docs.select("doc_id", F.col(text).alias("_t")).join(F.broadcast(mine), "doc_id").groupBy("doc_id", "_o", "_y").agg(F.min("_t").alias("_t")).orderBy("_o", "doc_id").collect()
    return ToxicityModel.fit([r["_t"] for r in rows], np.array([r["_y"] for r in rows], dtype=np.float64)) if rows else ToxicityModel({}, np.zeros(0, np.uint64), np.zeros(0, np.float32), 0.5)


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select("doc_id", F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_PARTS entries and some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grid.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shared.value.scores(piece.column(1)), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from FLAGGED on).

    Only the whole text enters a score.  A null text, or one without letters, gets the share of label 1; labels of
    unknown documents, other than 0 and 1, or null are ignored; texts of any length are read whole, window by window;
    repeated rows give repeated results, ties among windows don't matter; a null doc_id is scored and never learned
    from; an empty table gives an empty result; extra columns are ignored.
    """
    found = scored(docs, fit_toxicity(docs, labels, text), text)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= FLAGGED, 1).otherwise(0).alias("predicted"))
