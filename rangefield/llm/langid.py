"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up, over all labelled documents, how often each hashed n-gram
occurs per language, BLOCK languages at a time; every task sends one count
matrix (languages x BUCKETS), so what is shuffled does not grow with its texts.
The log-probability matrix of all languages is broadcast: 256 KB a language.  Scoring sums
its rows over the n-grams of a text in numpy.

Defined cases: a text that is null or has no letter is `und` with score 0;
whole texts are used, whatever their length; training rows without a language
are not learned from; with no training rows at all every text is `und`; equal
rows get equal predictions; ties between languages go to the one first in
alphabetical order; extra columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import array_rows, id_part, map_text, span_sums, sum_arrays, text_slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.1
#: Languages counted in one pass over the training texts; more take further passes.
BLOCK = 128
_SEEDS = [np.uint32(x) for x in (0, 2654435761, 2246822519, 3266489917)]


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case form where that is one code point, and whether it is a letter."""
    codes = [chr(c) for c in range(0x110000)]
    lower = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in codes], np.uint32)
    return lower, np.array([x.isalpha() for x in codes])


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of a column, the bounds of each text, and which are letters."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=bounds[1:])
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = memoryview(data)[off[0] : off[-1]] if data is not None else b""
    codes = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lower, letter = _characters()
    return lower[codes], bounds, letter[codes]


def grams(codes: np.ndarray, letters: np.ndarray, bounds: np.ndarray):
    """For each order: the bucket of the n-gram that ends at each character, and where it lies in one text.

    Characters other than letters count as one separator.
    """
    codes = np.where(letters, codes, np.uint32(32))
    since = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    run = codes.copy()
    for k in ORDERS:
        if k > 1:
            run[k - 1 :] = run[k - 2 : -1] * np.uint32(0x01000193) + codes[k - 1 :] if len(run) >= k else run[:0]
        mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + _SEEDS[k - 1]
        yield (mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1), since >= k - 1


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the float32 matrix of log-probabilities (BUCKETS x languages) of docs(text, lang)."""
    named = docs.filter(F.col("lang").isNotNull()).select("text", "lang")
    found = [r[0] for r in named.groupBy("lang").count().select("lang").collect()]
    names = sorted(found)
    logs = np.zeros((BUCKETS, len(names)), np.float32)
    for lo in range(0, len(names), BLOCK):
        own = names[lo : lo + BLOCK]
        counts = _counts(named if len(names) <= BLOCK else named.filter(F.col("lang").isin(own)), own)
        smooth = counts + SMOOTHING
        logs[:, lo : lo + BLOCK] = np.log(smooth / smooth.sum(1, keepdims=True)).T
    return names, logs


def _counts(named: DataFrame, names: list[str]) -> np.ndarray:
    """The n-gram counts (languages x BUCKETS) of named(text, lang), all of whose languages are in `names`."""
    place = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for part in text_slices(batch):
                codes, bounds, letters = characters(part.column("text"))
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                size = np.diff(bounds)
                for bucket, inside in grams(codes, letters, bounds):
                    key = bucket + (np.repeat(lang, size).astype(np.uint32) * np.uint32(BUCKETS))
                    total += np.bincount(key[inside], minlength=total.size).reshape(total.shape)
        yield array_rows({int(r): total[r] for r in np.flatnonzero(total.any(1))})

    counts = np.zeros((len(names), BUCKETS))
    for lang, found in sum_arrays(named.mapInArrow(count, "part int, counts binary")).items():
        counts[lang] = found
    return counts


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of docs with lang_pred and score, the posterior probability of that language."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in columns)

    def kernel(batch: pa.RecordBatch) -> dict:
        names, logs = shared.value
        codes, bounds, letters = characters(batch.column("text"))
        known = (span_sums(letters, bounds) > 0) & bool(names)
        n = batch.num_rows
        if not names:
            return {c: batch.column(c) for c in columns} | {"lang_pred": ["und"] * n, "score": np.zeros(n)}
        totals = np.zeros((n, len(names)))
        for bucket, inside in grams(codes, letters, bounds):
            for j in range(len(names)):
                value = logs[:, j][bucket]
                value[~inside] = 0
                totals[:, j] += span_sums(value, bounds)
        best = totals.argmax(1)
        odds = np.exp(totals - totals.max(1, keepdims=True))
        score = np.where(known, odds.max(1) / odds.sum(1), 0.0)
        lang = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return {c: batch.column(c) for c in columns} | {"lang_pred": lang, "score": score}

    return map_text(docs.select(*columns, "text"), kernel, fields + "lang_pred string, score double")


def op7(docs: DataFrame) -> DataFrame:
    """Predictions for every document; those whose crc32 modulo 4 is 2 are held out of training."""
    held = docs.select("doc_id", "text", "lang", (id_part(4) == 2).alias("held_out"))
    return predict(held, train(held.filter(~F.col("held_out"))), ("doc_id", "held_out"))
