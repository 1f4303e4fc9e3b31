"""Removal of lines that other documents hold too, by two Bloom filters.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with
A-Z lower-cased.  A key of at least `min_chars` code points that occurs in at
least two documents stays only in the document of smallest id among its holders.

1. Each task adds every key, once for each document, to two filters: `once`
   has the bits that were set, `twice` those that were set again.  Filters of
   different tasks merge block by block: once = a | b, twice = a2 | b2 | (a & b),
   so a key of two documents has all its bits in `twice`.
2. Only `twice` is broadcast (at most MAX_BITS / 8 bytes).  Keys that it does
   not hold are unique and go no further.  The others are suspects; their
   128-bit BLAKE2 digests are aggregated to the smallest holder.
3. Digests with two holders go back to the documents that must drop them.
   Only documents with suspects are joined; a digest held by very many of them
   is a skewed join key, which adaptive execution splits.

The filters have about BITS_PER_LINE bits a line until MAX_BITS is reached.
Beyond that more lines become suspects, which costs shuffle but changes no
result: every suspect is confirmed exactly.

Defined cases: a null or empty text is one empty line and comes back empty;
texts of any length are split whole; lines that stay are joined by ``\\n``, so
a text all of whose lines go is empty; rows of equal id are one document, and
rows without an id one document after all others; extra columns pass through
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from . import scratch
from .textkit import Words, fresh, map_text, release, text_slices

MIN_CHARS = 10
BITS_PER_LINE = 12
#: Bound of the broadcast filter: 64 MB.
MAX_BITS = 1 << 29
#: Bits of a block, the unit in which filters are merged.
BLOCK_BITS = 1 << 21
STARTS = (np.arange(256) & 0xC0) != 0x80
WHITE = b" \t\n\v\f\r"


class Lines:
    """Keys of the lines of a slice: for each long enough key its document, byte span and 64-bit hash."""

    def __init__(self, texts: pa.Array, min_chars: int):
        words = Words(texts, lower=True)
        breaks = np.flatnonzero(words.raw == 10)
        starts = np.sort(np.concatenate([words.off[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([breaks, words.off[1:]]))
        self.count = words.per_doc(words.raw == 10) + 1
        doc = np.repeat(np.arange(words.n_docs), self.count)
        first, last = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
        full = np.flatnonzero(last > first)
        start, end = words.start[first[full]], words.end[last[full] - 1]
        chars = np.concatenate([[0], np.cumsum(STARTS[words.buf])])
        long = chars[end] - chars[start] >= min_chars
        words.start, words.end = start[long], end[long]
        self.words, self.doc, self.hash = words, doc[full][long], words.hashes()

    def distinct(self) -> np.ndarray:
        """The hashes, once for each document."""
        order = np.lexsort((self.hash, self.doc))
        doc, key = self.doc[order], self.hash[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[new]


def positions(keys: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bits of each key, one row for each probe; those of a key differ."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([(keys + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(probes)]).astype(np.int64)


class Filters:
    """The bits set once and those set again."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, places: np.ndarray) -> None:
        at, times = np.unique(places, return_counts=True)
        byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
        again = (times > 1) | ((self.once[byte] & bit) > 0)
        _set(self.once, byte, bit)
        _set(self.twice, byte[again], bit[again])

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def _set(target: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> None:
    """Sets bits given in order of their bytes."""
    if len(byte):
        at = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        target[byte[at]] |= np.bitwise_or.reduceat(bit, at)


def holds(twice: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each key, whether all its bits are set."""
    return ((twice[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


BLOCKS = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)


def repeated_bits(docs: DataFrame, text: str, min_chars: int, bits: int, probes: int) -> np.ndarray:
    """The `twice` filter of all keys of the table."""
    size = min(bits, BLOCK_BITS) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for batch in batches:
            for part in text_slices(batch, text):
                own.add(positions(Lines(part.column(text), min_chars).distinct(), bits, probes))
        for i in range(bits // 8 // size):
            once, twice = (x[i * size : (i + 1) * size] for x in (own.once, own.twice))
            if once.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_pack(once)], pa.binary()), pa.array([_pack(twice)], pa.binary())], schema=BLOCKS)
        release()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Filters(size * 8)
        for batch in batches:
            for once, twice in zip(batch.column("once"), batch.column("twice"), strict=True):
                total.merge(_unpack(once.as_py(), size), _unpack(twice.as_py(), size))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_pack(total.once)], pa.binary()), pa.array([_pack(total.twice)], pa.binary())], schema=BLOCKS)

    fields = "block int, once binary, twice binary"
    parts = docs.select(text).mapInArrow(fill, fields).withColumn("salt", F.spark_partition_id() % 32)
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("block", "salt").applyInArrow(merged, fields).groupBy("block").applyInArrow(merged, fields).select("block", "twice").toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = _unpack(bytes(row.twice), size)
    return out


def digest(key: bytes) -> bytes:
    """The 128 bits by which suspected keys are told apart."""
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines taken out of `text`, and n_lines (before) and n_dropped (columns of these names are replaced)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*keep)
    n_lines, digests, holder, mark, one, least, most, gone = fresh(keep, "n_lines", "digests", "holder", "mark", "digest", "least", "most", "gone")
    column = F.col(f"`{text}`")
    lines = docs.agg(F.sum(F.length(column) - F.length(F.replace(column, F.lit("\n"))) + 1)).first()[0] or 1
    bits = 1 << min(max(int(BITS_PER_LINE * lines - 1).bit_length(), 16), MAX_BITS.bit_length() - 1)
    probes = min(max(round(0.35 * bits / lines), 1), 4)
    shared = spark.sparkContext.broadcast(repeated_bits(docs.select(column.alias("text")), "text", min_chars, bits, probes).tobytes())
    fields = StructType([docs.schema[c] for c in keep] + [StructField(n_lines, LongType()), StructField(digests, ArrayType(BinaryType()))])

    def probe(batch: pa.RecordBatch) -> dict:
        found = Lines(batch.column(text), min_chars)
        twice = np.frombuffer(shared.value, np.uint8)
        own: list[set[bytes]] = [set() for _ in range(batch.num_rows)]
        for i in np.flatnonzero(holds(twice, positions(found.hash, bits, probes))):
            own[found.doc[i]].add(digest(found.words.text(i)))
        return {c: batch.column(c) for c in keep} | {n_lines: found.count, digests: pa.array([list(x) for x in own], pa.list_(pa.binary()))}

    book = scratch.save(map_text(docs, probe, fields, text))
    shared.destroy()

    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias(holder)
    marked = book.filter(F.size(digests) > 0).withColumns({holder: key, mark: F.xxhash64(column)})
    suspects = marked.select(holder, mark, F.explode(digests).alias(one))
    # written, so that both sides of the join below are dealt anew and a hot digest can be split
    firsts = scratch.save(suspects.groupBy(one).agg(F.min(holder).alias(least), F.max(holder).alias(most)).filter(F.col(least) < F.col(most)).select(one, least))
    drops = suspects.join(firsts, one).filter(F.col(holder) > F.col(least)).groupBy(holder, mark).agg(F.collect_set(one).alias(gone))
    joined = marked.join(drops, [holder, mark], "left").select(*[F.col(f"`{c}`") for c in keep], n_lines, gone)
    result = StructType([docs.schema[c] if c != text else StructField(c, StringType()) for c in keep] + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def cut(batch: pa.RecordBatch) -> dict:
        texts, dropped = [], np.zeros(batch.num_rows, np.int64)
        for i, (x, out) in enumerate(zip(batch.column(text), batch.column(gone), strict=True)):
            if not out.is_valid:
                texts.append(x.as_py())
                continue
            out = set(out.as_py())
            whole = x.as_py().encode().split(b"\n")
            stay = [line for line in whole if len(line) < min_chars or digest(line.strip(WHITE).lower()) not in out]
            dropped[i] = len(whole) - len(stay)
            texts.append(b"\n".join(stay).decode())
        return {c: batch.column(c) for c in keep} | {text: pa.array(texts, pa.string()), "n_lines": batch.column(n_lines), "n_dropped": dropped}

    whole = book.filter(F.size(digests) == 0)
    rest = whole.select(*[F.coalesce(column, F.lit("")).alias(text) if c == text else F.col(f"`{c}`") for c in keep], F.col(n_lines).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return rest.union(map_text(joined, cut, result, text))


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the lines kept."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT rid, doc_id, i, lines[i] AS line,
    translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM rows)),
shared AS (SELECT k, min(doc_id) AS least FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.rid, l.doc_id, l.i, l.line, s.least IS NOT NULL AND l.doc_id > s.least AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
