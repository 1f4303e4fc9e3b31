"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the failures as the
bits of one long beside the measurements.  A policy is a versioned set of rule
bits; `apply_policy` is one bitwise test, and `ablation` tells from counts per
distinct mask what each rule of a policy removes alone, so neither reads the
texts again.

Defined cases: a null or empty text has no words and fails `few_words`; texts
of any length are measured whole; repeated rows are measured row by row; extra
columns pass through (a column named like a measurement is replaced); an empty
table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .textkit import Words, map_text, span_sums

WINDOW = 8
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
STARTS = (np.arange(256) & 0xC0) != 0x80
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
ALPHA = UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC2)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_alpha long, n_digits long, n_bangs long, max_word long, n_stutter long"
)

#: Rule name -> condition under which a document fails; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "shouting": "n_alpha >= 50 AND 10 * n_upper > 6 * n_alpha",
    "bangs": "10 * n_bangs > 5 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "100 * n_alpha < 50 * word_chars",
    "digit_heavy": "100 * n_digits > 30 * word_chars",
    "stutter": "100 * n_stutter > 30 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbol_heavy", "shouting", "bangs", "duplicate_lines", "short_words", "long_words", "few_letters", "digit_heavy", "stutter"),
}
MEASURE_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def repeated_words(words: Words, hashes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Per document, the words inside a window of `size` words that occurs again in the document."""
    n = len(words.start)
    if n < size:
        return np.zeros(words.n_docs, np.int64)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs[: n - k] = runs[: n - k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:]
    doc = words.doc
    at = np.flatnonzero(np.repeat(words.range[1:], words.count) - np.arange(n) >= size)
    key = runs[at] ^ ((doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(words.n_docs, np.int64)
    place = np.minimum(np.searchsorted(again, key), len(again) - 1)
    hit = at[again[place] == key]
    change = np.zeros(n + size + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + size, -1)
    return span_sums(np.cumsum(change)[:n] > 0, words.range)


def measure(batch: pa.RecordBatch, text: str) -> dict:
    """The measurements of a slice of documents."""
    words = Words(batch.column(text))
    data, off = words.raw.tobytes(), words.off
    lines = np.zeros(words.n_docs, np.int64)
    same = np.zeros(words.n_docs, np.int64)
    for i in range(words.n_docs):
        own = [x for x in data[off[i] : off[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i], same[i] = len(own), len(own) - len(set(own))
    sizes = span_sums(STARTS[words.buf] & words.solid, off)
    longest = np.zeros(words.n_docs, np.int64)
    full = np.flatnonzero(words.count)
    if len(full):
        longest[full] = np.maximum.reduceat(words.end - words.start, words.range[:-1][full])
    hashes = words.hashes()
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = hashes[1:] == hashes[:-1]
    stutter[words.range[:-1][full]] = False
    return {
        "n_words": words.count, "word_chars": sizes, "n_symbols": words.per_doc(SYMBOLS[words.buf]), "n_dup_lines": same,
        "n_repeat_words": repeated_words(words, hashes), "n_lines": lines, "n_upper": words.per_doc(UPPER[words.buf]),
        "n_alpha": words.per_doc(ALPHA[words.buf] & STARTS[words.buf]), "n_digits": words.per_doc(DIGIT[words.buf]),
        "n_bangs": words.per_doc(words.buf == 33), "max_word": longest,
        "n_stutter": span_sums(stutter, words.range),
    }


def ledger(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' columns named in `keep` (default: all) with the measurements and `fail_mask`."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in MEASURE_NAMES and c != "fail_mask"]
    read = docs.select(*keep, F.col(text).alias("__text"))
    fields = StructType([docs.schema[c] for c in keep] + _parse_datatype_string(MEASURES).fields)

    def kernel(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in keep} | measure(batch, "__text")

    out = map_text(read, kernel, fields, "__text")
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return out.withColumn("fail_mask", F.expr(f"CAST({bits} AS BIGINT)"))


def mask_of(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    return sum(1 << list(RULES).index(x) for x in rules)


def apply_policy(book: DataFrame, version: str = "v2") -> DataFrame:
    """Adds `kept`: no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_mask").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablation(book: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of the policy: documents failing it, and documents that only it rejects."""
    bits = mask_of(POLICIES[version])
    counts = book.groupBy(F.col("fail_mask").bitwiseAND(F.lit(bits)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(mask_of((x,))).cast("long").alias("bit")) for x in POLICIES[version]]))
    return (
        counts.select("mask", "n", rules.alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
    )


def op10(docs: DataFrame, version: str = "v2") -> DataFrame:
    """doc_id, the contract's measurements, base_failed, kept, and the ledger's mask."""
    book = apply_policy(ledger(docs, ["doc_id"]), version)
    return book.withColumn("base_failed", F.col("fail_mask").bitwiseAND(F.lit(mask_of(BASE))) != 0)


__all__ = ["BASE", "MEASURES", "POLICIES", "RULES", "ablation", "apply_policy", "ledger", "mask_of", "measure", "op10"]
