"""Ranked lexical search of a query set in all documents, by sort-based accumulation.

Terms are runs of ASCII letters and digits and non-ASCII characters, A-Z
lower-cased.  Queries are taken in blocks of at most BLOCK_TERMS terms; for a
block, one pass over the texts counts documents and the block's terms, a second
one scores:

- tokens are looked up in the block's vocabulary (by value, in Arrow), and each
  matched (term, document) has one integer impact;
- impacts are laid out as concatenated (item, document, impact) arrays, one
  entry for each item that has the term, packed into 64-bit keys, which a
  radix sort by 16-bit digits puts in order; `reduceat` adds up equal keys;
- a document is scored whole inside its slice, so a task keeps the best `top`
  documents of each item, and drops sums below an item's worst kept score.

The tasks' best are written, range-partitioned by item, and a heap of `top`
entries an item picks the final ones.

A block's vocabulary is all that is broadcast, so its size is bounded; larger
query sets take more passes.  Scores are 64-bit integers; `div` rounds down.

Defined cases: a null or empty text, or one without terms, matches nothing and
is not counted; texts of any length are read whole; equal scores are ordered
by doc_id, null last; rows are documents and items, so repeated rows are
ranked and answered each by itself; extra columns are not read; empty tables
give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .divergence import tokens
from .textkit import Words, array_rows, release, sum_arrays, text_slices

TOP = 10
#: (item, term) entries of a block of queries.
BLOCK_TERMS = 1 << 18
#: Entries that are accumulated at a time.
ENTRIES = 1 << 21
BYTES = np.arange(256)
TERM = (BYTES >= 128) | ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122))
NO_ID = (1 << 63) - 1


class Block:
    """A block of queries: its vocabulary, and for each term the items that have it and how often."""

    def __init__(self, items: list[tuple[int | None, Counter]]):
        self.ids = [x for x, _ in items]
        self.terms = sorted({t for _, own in items for t in own})
        place = {t: i for i, t in enumerate(self.terms)}
        entries = sorted((place[t], i, n) for i, (_, own) in enumerate(items) for t, n in own.items())
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*entries, strict=True))
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def terms_of(text: str | None) -> Counter:
    """The terms of one text with their counts."""
    words = Words(pa.array([text], pa.string()), lower=True, keep=TERM)
    return Counter(tokens(words).to_pylist())


def blocks(queries: DataFrame, limit: int = BLOCK_TERMS) -> Iterator[Block]:
    """Blocks of the rows of queries(item_id, text), as they come."""
    items, size = [], 0
    for row in queries.toLocalIterator():
        own = terms_of(row.text)
        if items and size + len(own) > limit:
            yield Block(items)
            items, size = [], 0
        if own:
            items.append((row.item_id, own))
            size += len(own)
    if items:
        yield Block(items)


def matched(words: Words, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of occurrences of the vocabulary's terms in a slice, by document."""
    code = pc.fill_null(pc.index_in(tokens(words), value_set=terms), -1).to_numpy().astype(np.int64)
    hit = code >= 0
    key, n = np.unique(words.doc[hit] * len(terms) + code[hit], return_counts=True)
    return key // len(terms), key % len(terms), n.astype(np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys >= 0, by their 16-bit digits from the lowest."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # a radix sort for 16-bit numbers
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of impact by (item, doc), in that order."""
    width = int(doc.max()) + 1
    keys = item * width + doc
    order = radix_order(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at] // width, keys[at] % width, np.add.reduceat(impact[order], at)


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms."""
    if 75 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 25 + 75 * n * n_docs // n_terms
    return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)


class Best:
    """The best documents of each item so far, in a task."""

    def __init__(self, n_items: int, top: int):
        self.top, self.worst = top, np.zeros(n_items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = (score > 0) & (score >= self.worst[item])
        item, doc, score = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        stay = rank < self.top
        self.item, self.doc, self.score = item[stay], doc[stay], score[stay]
        full = rank[stay] == self.top - 1
        self.worst[self.item[full]] = self.score[full]


def search_block(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """item_id, rank, doc_id and score of a block of queries in docs(doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block.terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.large_string())
        total, df = np.zeros(2, np.int64), np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True, keep=TERM)
                total += (np.count_nonzero(words.count), len(words.start))
                df += np.bincount(matched(words, terms)[1], minlength=len(terms))
        yield array_rows({0: total, 1: df})
        release()

    sums = sum_arrays(docs.select("text").mapInArrow(counts, "part int, counts binary"))
    shared.destroy()
    total, df = sums.get(0, np.zeros(2, np.int64)), sums.get(1, np.zeros(len(block.terms), np.int64))
    block.weigh(int(total[0]), max(int(total[1]), 1), df)
    state = spark.sparkContext.broadcast(block)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.value
        terms, best = pa.array(own.terms, pa.large_string()), Best(len(own.ids), top)
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True, keep=TERM)
                ids = pc.fill_null(part.column("doc_id"), NO_ID).to_numpy()
                doc, term, tf = matched(words, terms)
                m = length_part(words.count, own.n_docs, own.n_terms)
                impact = own.weight[term] * (SCALE * tf // (1000 * tf + 8 * m[doc]))
                size = own.first[term + 1] - own.first[term]
                new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                # cut only between documents, so that a document's sums are whole
                block_no = (np.cumsum(size) // ENTRIES)[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
                for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(block_no)) + 1):
                    if not len(at):
                        continue
                    row = np.repeat(at, size[at])
                    entry = own.first[term[row]] + np.arange(len(row)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                    item, place, score = accumulate(own.item[entry], doc[row], impact[row] * own.times[entry])
                    best.add(item, ids[place], score)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], ["item", "doc", "score"])
        release()

    parts = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "item long, doc long, score long"))
    state.destroy()
    names = block.ids

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for item, doc, score in zip(*(batch.column(c).to_pylist() for c in ("item", "doc", "score")), strict=True):
                heap, entry = heaps.setdefault(item, []), (score, -doc)
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
        rows = [(names[i], k, None if -doc == NO_ID else -doc, score) for i, heap in heaps.items() for k, (score, doc) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item_id", "rank", "doc_id", "score"])

    return parts.repartitionByRange("item").mapInArrow(select, "item_id long, rank int, doc_id long, score long")


SCALE = 1_000_000_000


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `top` best documents of each query."""
    out = None
    for block in blocks(queries.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_terms):
        found = search_block(docs.select("doc_id", "text"), block, top)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the ten best documents of every item."""
    return search(docs, items)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT bid, item_id, term, count(*) AS times FROM b GROUP BY ALL),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
size AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
m AS (SELECT rid, 25 + (75 * n * n_docs) // n_terms AS m FROM size, whole),
hit AS (SELECT q.bid, q.item_id, tf.rid, tf.doc_id, q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)) AS s
  FROM q JOIN tf USING (term) JOIN weight w USING (term) JOIN m USING (rid)),
score AS (SELECT bid, item_id, rid, doc_id, sum(s)::BIGINT AS score FROM hit GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 10
"""
