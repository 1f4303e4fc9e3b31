"""Vectorised text primitives shared by the training-data operators.

Everything here works on Arrow string columns without building a Python
object per word: a record batch is cut into slices of about a megabyte of
text (a longer document is a slice of its own, whole), words are located with
numpy over the raw UTF-8 bytes, and every word gets a 64-bit hash.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A null
text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes per slice: bounds the temporary arrays of the numpy kernels.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_VAL = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """The words of a slice: byte spans, and for each document its range of words.

    `keep` tells which bytes make words, in place of all but white space.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, keep: np.ndarray | None = None):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw = raw[off[0] : off[-1]]
        self.off = off - off[0]
        self.n_docs = len(texts)
        self.buf = LOWER[self.raw] if lower else self.raw
        solid = ~SPACE[self.buf] if keep is None else keep[self.buf]
        n = len(solid)
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, solid
        solid1 = np.empty(n + 1, bool)
        solid1[:n], solid1[n] = solid, False
        self.start = np.flatnonzero(solid1 & (~before | first))
        self.end = np.flatnonzero(before & (~solid1 | first))
        self.solid = solid
        self.range = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.range)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal byte strings."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + SLICE_BYTES, "right")))
            hi = self.end[to - 1]
            up, down = _powers(hi - lo)
            total = np.empty(hi - lo + 1, np.uint64)
            total[0] = 0
            np.cumsum(_VAL[self.buf[lo:hi]] * up, out=total[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def text(self, i: int) -> bytes:
        """The bytes of word i."""
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a value per byte over each document."""
        return span_sums(flags, self.off)


def span_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty spans give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of `size` words; a shorter non-empty document is one run."""
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    left = np.repeat(words.range[1:], words.count) - np.arange(n)
    odd = _U(0xD6E8FEB86659FD93)
    factor = _U(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            runs[: n - k] = runs[: n - k] * odd + hashes[k:]
            factor = factor * odd
    keep = left >= size
    for d in np.flatnonzero((words.count > 0) & (words.count < size)):
        total = _U(0)
        with np.errstate(over="ignore"):
            for i in range(words.range[d], words.range[d + 1]):
                total = total * odd + hashes[i]
        runs[words.range[d]] = total + _U(int(words.count[d]))
        keep[words.range[d]] = True
    at = np.flatnonzero(keep)
    return words.doc[at], mix(runs[at])


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about SLICE_BYTES of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    block = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield batch.slice(int(lo), int(hi - lo))


def release() -> None:
    """Gives the memory that a task has freed back to the machine; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no input column has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def map_text(
    df: DataFrame,
    kernel: Callable[[pa.RecordBatch], dict | Iterable[dict] | None],
    schema: str | StructType,
    column: str = "text",
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Applies `kernel` to every text slice of df; it returns columns by name, in the order of `schema`.  `after` ends a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                out = kernel(part)
                if out is not None:
                    yield to_batch(out, arrow)
        if after is not None:
            after()
        release()

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of numpy or Arrow columns, cast to `schema`."""
    arrays = []
    for field in schema:
        value = columns[field.name]
        if isinstance(value, np.ndarray) and value.dtype == np.uint64:
            value = value.view(np.int64)
        if not isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = pa.array(value, type=field.type)
        arrays.append(value if value.type == field.type else value.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[bounds[i]:bounds[i + 1]]."""
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((bounds.astype(np.int64) * values.dtype.itemsize).tobytes()), pa.py_buffer(np.ascontiguousarray(values))],
    ).cast(pa.binary())


def id_part(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(key: tuple[pa.Scalar, ...], frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for frame in frames:
        for x in frame.column("counts"):
            part = np.frombuffer(x.as_buffer(), np.int64)
            total = part.copy() if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])


def sum_arrays(partial: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the int64 arrays in partial(part int, counts binary) by part.

    They are added in two streaming steps, by part and a salt and then by part;
    the caller bounds the number of parts and the size of an array.
    """
    fields = "part int, counts binary"
    salted = partial.withColumn("salt", F.spark_partition_id() % 16)
    first = salted.groupBy("part", "salt").applyInArrow(_add, fields)
    return {r["part"]: np.frombuffer(r["counts"], np.int64) for r in first.groupBy("part").applyInArrow(_add, fields).collect()}


def array_rows(arrays: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows for `sum_arrays`."""
    return pa.RecordBatch.from_arrays(
        [pa.array(list(arrays), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in arrays.values()], pa.binary())], ["part", "counts"]
    )


def labelled(docs: DataFrame, labels: DataFrame, target: str, train: Column, per_class: int) -> DataFrame:
    """doc_id, text, target of up to `per_class` labelled rows of each class for which `train` holds.

    The rows with the least hashes of their ids are taken; a doc_id with
    several labels counts with the largest, one with several texts with one.
    """
    marks = labels.filter(F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias(target)).filter(train)
    some = None
    for value in (0, 1):
        part = marks.filter(F.col(target) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.union(part)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 2 * per_class ids
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(target).alias(target))
