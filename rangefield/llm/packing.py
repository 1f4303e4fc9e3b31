"""Best-fit packing of tokenised documents with certified bin counts.

Documents become pieces of at most `capacity` tokens.  Pieces are dealt at
random over groups of about GROUP pieces, each packed by best-fit decreasing.
A group's bin count is certified when it equals a lower bound from
dual-feasible functions over its lengths.  Groups with a gap give up their
underfilled bins, certified groups only their emptiest one; the pieces of
those bins are dealt anew over fewer groups and packed again, until one group
holds them all or a round no longer shrinks the rest.  Rows carry lengths and
checksums, never texts, so a round moves a few bytes per piece.

Defined cases: a null or empty text is one piece, the end id alone; a text of
any length is tokenised whole; repeated rows are packed each for itself; an
empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .scratch import save
from .textkit import map_text

CAPACITY = 4096
END_ID = 1
#: Pieces packed together in one task.
GROUP = 8192
#: A bin of an uncertified group is given up when it is filled less than this.
FULL = 0.97
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def word_bpe() -> str:
    """The path of the public tokenizer that the registered query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """The pieces of docs(doc_id, text): place, length and checksum of their ids."""

    def kernel(batch: pa.RecordBatch) -> dict:
        ids, bounds = tokenizer(path).encode(batch.column("text"), end)
        n = np.diff(bounds)
        per = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), per)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = number * capacity
        length = np.minimum(capacity, n[doc] - begin)
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        at = bounds[:-1][doc] + begin
        crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        return {"doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": number, "start": begin, "length": length, "ids_crc32": crc}

    # the cache of a worker's tokenizer ends with the task
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, PIECES, after=lambda: tokenizer(path).clear())


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each length, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0  # bit c: some bin has c free places
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        number[i], offset[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return number, offset, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound from two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    best = -(-int(lengths.sum()) // capacity)
    for cut in {0, *np.unique(np.minimum(lengths, capacity // 2)).tolist()[:: max(1, len(lengths) // 256)]}:
        raised = np.where(x > capacity - cut, capacity, np.where(x < cut, 0, x))  # whole, none, or as it is
        best = max(best, -(-int((raised * counts).sum()) // capacity))
        for k in (1, 2, 3, 4, 5):
            times = (k + 1) * raised
            stepped = np.where(times % capacity == 0, k * raised, (times // capacity) * capacity)  # in units of k * capacity
            best = max(best, -(-int((stepped * counts).sum()) // (k * capacity)))
    return best


PACKED = PIECES + ", sequence_id long, offset long, certified boolean, given_up boolean"


def _packer(turn: int, last: bool, capacity: int):
    """The function that packs one group in round `turn`."""

    def packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sizes = rows.column("length").to_numpy()
        number, offset, fill = best_fit(sizes, capacity)
        sure = len(fill) == lower_bound(sizes, capacity)
        give = np.zeros(len(fill), bool) if sure else fill < FULL * capacity
        give[fill.argmin()] = True
        give &= not last
        base = (turn << 56) | (key[0].as_py() << 20)
        cols = [rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        cols += [pa.array(base + number), pa.array(offset), pa.array(np.full(len(sizes), sure)), pa.array(give[number])]
        return pa.table(cols, names=[x.split()[0] for x in PACKED.split(", ")])

    return packed


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id, offset and `certified` to items as made by `pieces`; reads them from a saved table."""
    rest, done, turn = items, [], 0
    left = rest.count()
    if not left:
        return items.sparkSession.createDataFrame([], PACKED).drop("given_up")
    while True:
        groups = -(-left // group)
        last = groups == 1

        deal = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
        out = save(rest.withColumn("grp", deal).repartition(F.col("grp")).groupBy("grp").applyInArrow(_packer(turn, last, capacity), PACKED))
        done.append(out.filter(~F.col("given_up")))
        if last:
            break
        before, rest = left, out.filter("given_up").select(*items.columns)
        left = rest.count()
        turn += 1
        if not left:
            break
        if left > 0.7 * before:  # no progress: they stay as they are
            done.append(out.filter("given_up"))
            break
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result.drop("given_up")


def op8(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenises and packs documents."""
    items = save(pieces(docs, path or word_bpe()))
    return pack(items)

