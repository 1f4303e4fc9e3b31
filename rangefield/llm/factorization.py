"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A text's features are its distinct words, hashed into BUCKETS and weighted by
log(1 + count) over the norm of these weights, and statistics of its structure
(shares of marks, capitals, repeats, letters and so on) and of its size, each
as one of BINS indicator features.  The model

    b + <w, x> + 1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

has all pairwise interactions in time linear in the number of features.  It is
trained with AdaGrad on the driver, on the features of at most SAMPLE labelled
rows of each class; scoring streams over all texts.

Defined cases: a null or empty text has the indicator features of an empty
text only and gets the score that follows from them; texts of any length are
read whole; repeated rows score alike; without labelled rows of both classes
the score is the label's mean (0.5 without any); an empty table gives no rows;
extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import measure
from .textkit import Words, id_part, labelled, map_text, span_sums

BUCKETS = 1 << 14
BINS = 10
FACTORS = 8
#: Labelled rows of each class that training takes at most.
SAMPLE = 2500
EPOCHS = 12
BATCH = 64
PREDICT_AT = 0.7
#: Statistic -> its upper bin edges.
STATS = {
    "symbols": (0.001, 0.01, 0.05, 0.1, 0.2, 0.5, 1, 2),
    "capitals": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
    "bangs": (0.001, 0.01, 0.05, 0.1, 0.3, 0.5, 1, 1.5),
    "same_lines": (0.001, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "repeats": (0.001, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "stutter": (0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8),
    "letters": (0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98),
    "digits": (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "word_size": (2, 3, 3.5, 4, 4.5, 5, 6, 8, 12),
    "words": (1, 5, 10, 20, 50, 100, 300, 1000, 5000),
    "lines": (1, 2, 3, 5, 10, 30, 100, 300),
    "longest": (3, 8, 12, 16, 20, 30, 50, 100),
}
FEATURES = BUCKETS + BINS * len(STATS)
#: Weight of an indicator beside a unit vector of words.
STAT_WEIGHT = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, bounds) of the features of each text."""
    words = Words(texts, lower=True)
    m = measure(pa.RecordBatch.from_arrays([texts], ["t"]), "t")
    n, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    stats = {
        "symbols": m["n_symbols"] / n, "capitals": m["n_upper"] / np.maximum(m["n_alpha"], 1), "bangs": m["n_bangs"] / n,
        "same_lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1), "repeats": m["n_repeat_words"] / n, "stutter": m["n_stutter"] / n,
        "letters": m["n_alpha"] / chars, "digits": m["n_digits"] / chars, "word_size": m["word_chars"] / n,
        "words": m["n_words"], "lines": m["n_lines"], "longest": m["max_word"],
    }
    d = words.n_docs
    bins = np.stack([np.searchsorted(STATS[k], v, "left") + BUCKETS + BINS * i for i, (k, v) in enumerate(stats.items())], 1)
    key = np.sort(words.doc * BUCKETS + (words.hashes() >> np.uint64(50)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.log1p(np.diff(np.append(first, len(key))))
    doc, bucket = key[first] // BUCKETS, key[first] % BUCKETS
    inside = np.searchsorted(doc, np.arange(d + 1))
    weight = weight / np.sqrt(np.maximum(span_sums(weight * weight, inside), 1e-12))[doc]
    # words, then statistics, document by document
    k = bins.shape[1]
    bounds = inside + np.arange(d + 1) * k
    index, value = np.empty(bounds[-1], np.int64), np.full(bounds[-1], STAT_WEIGHT)
    at = np.arange(len(doc)) + doc * k
    index[at], value[at] = bucket, weight
    index[(bounds[1:, None] - k + np.arange(k)).ravel()] = bins.ravel()
    return index, value, bounds


class Machine:
    """A factorisation machine with a logistic output."""

    def __init__(self, seed: int = 1):
        self.bias = 0.0
        self.w = np.zeros(FEATURES)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (FEATURES, FACTORS))

    def margin(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The model's output before the logistic function, by the sum-of-squares identity."""
        out = self.bias + span_sums(self.w[index] * value, bounds)
        for f in range(FACTORS):
            part = self.v[index, f] * value
            out += 0.5 * (span_sums(part, bounds) ** 2 - span_sums(part * part, bounds))
        return out

    def probability(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(index, value, bounds), -50, 50)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4) -> None:
        """AdaGrad over shuffled batches; both classes weigh the same."""
        rng = np.random.default_rng(2)
        share = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, len(label) - label.sum())) * len(label)
        gw, gv, gb = np.full(FEATURES, 1e-8), np.full((FEATURES, FACTORS), 1e-8), 1e-8
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                index = np.concatenate([rows[i][0] for i in pick])
                value = np.concatenate([rows[i][1] for i in pick])
                bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
                size = np.diff(bounds)
                error = (self.probability(index, value, bounds) - label[pick]) * share[pick] / len(pick)
                each = np.repeat(error, size) * value
                unique, back = np.unique(index, return_inverse=True)
                step = np.bincount(back, weights=each) + decay * self.w[unique]
                gw[unique] += step * step
                self.w[unique] -= rate * step / np.sqrt(gw[unique])
                for f in range(FACTORS):
                    own = self.v[index, f]
                    total = np.repeat(span_sums(own * value, bounds), size)
                    step = np.bincount(back, weights=each * (total - own * value)) + decay * self.v[unique, f]
                    gv[unique, f] += step * step
                    self.v[unique, f] -= 0.5 * rate * step / np.sqrt(gv[unique, f])
                step = error.sum()
                gb += step * step
                self.bias -= rate * step / np.sqrt(gb)


def _feature_rows(batch: pa.RecordBatch) -> dict:
    index, value, bounds = features(batch.column("text"))
    pairs = list(zip(bounds[:-1], bounds[1:], strict=True))
    return {
        "label": batch.column("quality"),
        "index": pa.array([index[a:b].astype(np.int32).tobytes() for a, b in pairs], pa.binary()),
        "value": pa.array([value[a:b].astype(np.float32).tobytes() for a, b in pairs], pa.binary()),
    }


def train(docs: DataFrame, labels: DataFrame, where) -> Machine | float:
    """A machine from labelled rows for which `where` holds, or the label's mean where a class is missing."""
    sample = labelled(docs, labels, "quality", where, SAMPLE)
    found = map_text(sample.select("text", "quality"), _feature_rows, "label int, index binary, value binary").collect()
    label = np.array([r["label"] > 0 for r in found], float)
    if not len(label) or label.all() or not label.any():
        return float(label.mean()) if len(label) else 0.5
    rows = [(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float)) for r in found]
    order = sorted(range(len(rows)), key=lambda i: found[i]["index"] + found[i]["value"])  # as rows arrive in any order
    machine = Machine()
    machine.fit([rows[i] for i in order], label[order])
    return machine


def score(docs: DataFrame, machine: Machine | float, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of docs with `score`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in columns}

    def kernel(batch: pa.RecordBatch) -> dict:
        own = shared.value
        value = np.full(batch.num_rows, own) if isinstance(own, float) else own.probability(*features(batch.column("text")))
        return {c: batch.column(c) for c in columns} | {"score": value}

    fields = "".join(f"{c} {t}, " for c, t in kinds.items()) + "score double"
    return map_text(docs.select(*dict.fromkeys([*columns, "text"])), kernel, fields)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    machine = train(docs, labels, id_part(4) != 2)
    out = score(docs.select("doc_id", "text", (id_part(4) == 2).alias("held_out")), machine, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
