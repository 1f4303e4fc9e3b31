"""Exact Jaccard self-join of documents on word shingles by a grouped prefix join.

Shingles are 64-bit hashes, ordered by how often they occur (counted in a
sketch of fixed size, which is broadcast) and then by value, so that the rarest
come first.  Sets with similarity of at least T share one of the first
n - ceil(T * n) + 1 shingles, the prefix.

Documents with equal sets are one unit, and units with equal prefix and size
are one group.  First, only one unit of each group, its hub, is posted under
the prefix shingles.  Buckets of up to SMALL hubs give all their pairs that
pass the size and position filters; of a larger bucket, each hub is compared
with a few neighbours in order of size.  The members of a group of several
units form one more bucket.  Pairs are verified on their texts, and verified
links joined into components.

Then the exact remainder: groups are expanded to their members wherever a
bucket still spans several components, and two members of different
components meet only if a lower bound of their sets' difference allows the
similarity.  The bound is the number of differing bits of two parity sketches
(each shingle flips one of SKETCH_BITS bits), so it drops no link.  One round
takes the closest such partner of each member, which joins most of what can
be joined; the last round takes every pair that is left.  So no link between
two components is lost, and n near copies cost about n verified pairs and not
n * n.  A bucket of more than BLOCK members is dealt over tasks by blocks.  Two
postings late in the order of their sets never make a pair (`_early`), so texts
that share no more than a passage are not dealt.

Sets are compared by 64-bit hashes of their shingles, and equal sets are told
by a 64-bit fingerprint.

Defined cases: a text that is null, empty or without words has no shingles and
is linked with nothing; a text of fewer than `size` words is one shingle;
texts of any length are used whole; repeated rows have equal sets and so one
component, the least doc_id of which names it; an empty table gives no rows;
extra columns are passed through by `distinct` and not looked at otherwise; rows
without an id share the component of equal texts, link no others and all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import drop, save
from .textkit import Words, fresh, map_text, mix, ragged, release, shingles, text_slices

SIZE = 5
#: Counters of the frequency sketch, in parts of PART; they set the order only.
SKETCH = 1 << 23
PART = 1 << 15
#: Least and most bits of the filters that pick texts to verify and groups of several rows: 16 for each id in between.
FILTER = (1 << 18, 1 << 27)
SMALL = 8
#: Neighbours within a large bucket that a unit is compared with in the first round.
NEIGHBOURS = 2
#: Bits of the parity sketch of a set.
SKETCH_BITS = 512
#: Members of a bucket that one task compares with the others.
BLOCK = 1024
#: A shingle of more occurrences is posted under several keys, about this many for each.
SPREAD = 8192
CHUNK = 200_000
#: What a posting holds beside its place: the set's size above, and marks of a group of several units, of a group's own bucket, of a spread shingle.
SEVERAL, INSIDE, HOT = 1 << 29, 1 << 30, 1 << 31
PLACE = (1 << 29) - 1


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of 2 ** (1 / 8), as bytes: they reach 2 ** 31."""
    return np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)


def _decode(codes: np.ndarray) -> np.ndarray:
    return 2.0 ** (codes / 8.0) - 1.0


def _add(key: tuple[pa.Scalar, ...], frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PART)
    for frame in frames:
        for x in frame.column("counts"):
            total += _decode(np.frombuffer(x.as_buffer(), np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_code(total).tobytes()], pa.binary())], ["part", "counts"])


def frequencies(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """Codes of the counts of the shingles of all documents, hashed into SKETCH counters.

    Rounding and chance meetings of shingles shift the order only, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True)
                if len(words.start):
                    _, found = shingles(words, words.hashes(), size)
                    np.add.at(total, (found & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        for i in range(SKETCH // PART):
            own = total[i * PART : (i + 1) * PART]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_code(own).tobytes()], pa.binary())], ["part", "counts"])
        del total
        release()

    fields = "part int, counts binary"
    partial = docs.select("text").mapInArrow(count, fields).withColumn("salt", F.spark_partition_id() % 4)
    met = partial.groupBy("part", "salt").applyInArrow(_add, fields)
    out = np.zeros(SKETCH, np.uint8)
    for r in met.groupBy("part").applyInArrow(_add, fields).collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.uint8)
    return out


def _sets(texts: pa.Array, size: int, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds) of each text: its distinct shingles in order."""
    words = Words(texts, lower=True)
    doc, found = shingles(words, words.hashes(), size)
    if counts is None:
        order = np.lexsort((found, doc))
    else:
        order = np.lexsort((found, counts[(found & np.uint64(SKETCH - 1)).astype(np.int64)], doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _prints(values: np.ndarray, bounds: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A fingerprint of each set: sums of two functions of its members, with its size."""
    total = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(mix(values + np.uint64(salt)), out=total[0, 1:])
    np.cumsum(mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)), out=total[1, 1:])
    sums = total[:, bounds[1:]] - total[:, bounds[:-1]]
    return mix(sums[0] + mix(sums[1] + mix(n.astype(np.uint64) + np.uint64(salt))))


def _parities(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The parity sketch of each set: every member flips one bit."""
    n, size = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((n, SKETCH_BITS // 8), np.uint8)
    for lo in range(0, n, 1024):
        hi = min(lo + 1024, n)
        bit = (mix(values[bounds[lo] : bounds[hi]] ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        owner = np.repeat(np.arange(hi - lo), size[lo:hi])
        odd = np.bincount(owner * SKETCH_BITS + bit, minlength=(hi - lo) * SKETCH_BITS).reshape(-1, SKETCH_BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8), axis=1)
    return ragged(out.ravel(), np.arange(n + 1) * (SKETCH_BITS // 8))


def digests(docs: DataFrame, counts: Broadcast, percent: int, size: int) -> DataFrame:
    """doc_id, n, uid (the set), gid (prefix and size), the prefix itself and the parity sketch."""

    def kernel(batch: pa.RecordBatch) -> dict:
        codes = counts.value
        found, bounds = _sets(batch.column("text"), size, codes)
        n = np.diff(bounds)
        keep = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
        uid = _prints(found, bounds, n, 1)
        head = np.zeros(len(n) + 1, np.int64)
        np.cumsum(keep, out=head[1:])
        prefix = found[np.repeat(bounds[:-1] - head[:-1], keep) + np.arange(head[-1])]
        gid = _prints(prefix, head, n, 2)
        return {"doc_id": batch.column("doc_id"), "n": n, "uid": uid, "gid": gid, "prefix": ragged(prefix, head), "parity": _parities(found, bounds)}

    return map_text(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n long, uid long, gid long, prefix binary, parity binary"
    )


def _exploder(counts: Broadcast):
    """Gives the postings (token, uid, at) of hubs; those of a frequent shingle are spread over several keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = counts.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = part.column("prefix").to_pylist()
                tokens = np.frombuffer(b"".join(rows), np.uint64)
                size = np.array([len(x) // 8 for x in rows], np.int64)
                uid = np.repeat(part.column("uid").to_numpy(), size)
                n = np.repeat(part.column("n").to_numpy(), size)
                several = np.repeat(part.column("several").to_numpy(zero_copy_only=False), size)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                keys = np.ceil(_decode(codes[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]) / SPREAD).astype(np.uint64)
                hot = keys > 1
                key = np.where(hot, mix(uid.view(np.uint64)) % np.maximum(keys, np.uint64(1)), np.uint64(0)).astype(np.int64)
                at = (n << 32) | place | np.where(several, SEVERAL, 0) | np.where(hot, HOT, 0)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(uid), pa.array(at), pa.array(key)], ["token", "uid", "at", "key"])
        release()

    return run


def _pass(at: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """The size and position filters for postings i and j of one token."""
    n, m = at[i] >> 32, at[j] >> 32
    most = np.minimum(n - (at[i] & PLACE), m - (at[j] & PLACE))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _runs(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[list]:
    """Sorted columns in chunks that end with a token; a run longer than CHUNK is cut, with `overlap` rows repeated."""
    held: list[pa.RecordBatch] = []
    count = 0

    def columns():
        return [np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in range(held[0].num_columns)]

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < CHUNK:
            continue
        cols = columns()
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        if not len(cut) and not overlap:  # a run of a bounded length goes on
            continue
        end = cut[-1] + 1 if len(cut) else count
        yield [c[:end] for c in cols]
        rest = [c[end:] if len(cut) else c[len(c) - overlap :] for c in cols]
        held = [pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(rest, batch.columns, strict=True)], batch.schema.names)]
        count = len(rest[0])
    if count:
        yield columns()


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    none = pa.nulls(len(both), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none, none], ["a", "b", "token", "at"])


def _first_round(percent: int):
    """Pairs of small buckets, neighbours in large ones (a, b), and the postings (token, a, at) that later rounds need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, uid, at, key in _runs(batches, SMALL + 1):
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
            new = np.flatnonzero(first)
            size = np.diff(np.append(new, len(token)))
            bucket = np.cumsum(first) - 1
            # a bucket that is only a part of a spread one counts as large
            large = (size > SMALL) | np.maximum.reduceat((at & HOT) != 0, new)
            several = np.maximum.reduceat((at & SEVERAL) != 0, new)
            keep = ((size > 1) | large)[bucket]
            token, uid, at, bucket = token[keep], uid[keep], at[keep], bucket[keep]
            left, right = [], []
            for k in range(1, max(SMALL, NEIGHBOURS + 1)):
                i = np.flatnonzero(bucket[k:] == bucket[:-k])
                if k > NEIGHBOURS:
                    i = i[~large[bucket[i]]]
                i = i[_pass(at, i, i + k, percent) & (uid[i] != uid[i + k])]
                left.append(uid[i])
                right.append(uid[i + k])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield _pair_batch(a, b)
            later = np.flatnonzero((large | several)[bucket] & ((at & INSIDE) == 0))
            if len(later):
                none = pa.nulls(len(later), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(uid[later]), none, pa.array(token[later]), pa.array(at[later])], ["a", "b", "token", "at"])
        release()

    return run


def _bits(column: np.ndarray) -> np.ndarray:
    """Parity sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.tolist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _near(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The least difference of sets with sketches x and y and summed sizes, and whether it allows the similarity."""
    apart = np.bitwise_count(x ^ y).sum(-1).astype(np.int64)
    return apart, (100 + percent) * apart <= (100 - percent) * total


class _Closest:
    """The closest partner that each row has met."""

    def __init__(self, n: int):
        self.apart = np.full(n, 1 << 40)
        self.mate = np.zeros(n, np.int64)

    def meet(self, rows: np.ndarray, mates: np.ndarray, apart: np.ndarray) -> None:
        order = np.lexsort((mates, apart, rows))
        rows, mates, apart = rows[order], mates[order], apart[order]
        first = np.ones(len(rows), bool)
        first[1:] = rows[1:] != rows[:-1]
        rows, mates, apart = rows[first], mates[first], apart[first]
        better = apart < self.apart[rows]
        self.apart[rows[better]], self.mate[rows[better]] = apart[better], mates[better]

    def pairs(self, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero(self.apart < 1 << 40)
        return uid[found], self.mate[found]


def _whole_buckets(percent: int, closest: bool):
    """Pairs (a, b) of different components within buckets of up to BLOCK members, sorted by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, uid, at, part, parity in _runs(batches, 0):
            n, bits = at >> 32, _bits(parity)
            best = _Closest(len(token))
            i, k = np.arange(len(token) - 1), 1
            while len(i):
                # rows are ordered by size: once too large, the later ones are too
                i = i[i + k < len(token)]
                i = i[(token[i] == token[i + k]) & (100 * n[i] >= percent * n[i + k])]
                good = i[(part[i] != part[i + k]) & _pass(at, i, i + k, percent)]
                apart, ok = _near(bits[good], bits[good + k], n[good] + n[good + k], percent)
                good, apart = good[ok], apart[ok]
                if closest:
                    best.meet(good, uid[good + k], apart)
                    best.meet(good + k, uid[good], apart)
                elif len(good):
                    yield _pair_batch(uid[good], uid[good + k])
                k += 1
            if closest:
                a, b = best.pairs(uid)
                if len(a):
                    yield _pair_batch(a, b)
        release()

    return run


def _block_buckets(percent: int, closest: bool):
    """The same for larger buckets: each block's own members, which come first, against all that were sent to the block."""

    def compare(home: list[np.ndarray], other: list[np.ndarray], kind: str) -> tuple[np.ndarray, np.ndarray]:
        (uid, at, part, parity, stays), (uid2, at2, part2, parity2, _) = home, other
        bits, bits2 = _bits(parity), _bits(parity2)
        best, best2 = _Closest(len(uid)), _Closest(len(uid2))
        left, right = [], []
        for lo in range(0, len(uid), 64):
            mine = np.arange(lo, min(lo + 64, len(uid)))
            i, j = np.nonzero(part[mine][:, None] != part2[None, :])
            i = mine[i]
            if kind == "same":  # rows with themselves
                once = uid[i] < uid2[j]
            elif kind == "away":  # of two that are both sent the one with the lesser id is compared at its home
                once = stays[i] | (uid[i] < uid2[j])
            else:
                once = np.ones(len(i), bool)
            i, j = i[once], j[once]
            both = np.stack([at[i], at2[j]])
            good = _pass(both.ravel(), np.arange(len(i)), np.arange(len(i)) + len(i), percent) if len(i) else np.zeros(0, bool)
            i, j = i[good], j[good]
            apart, ok = _near(bits[i], bits2[j], (at[i] >> 32) + (at2[j] >> 32), percent)
            i, j, apart = i[ok], j[ok], apart[ok]
            if closest:
                best.meet(i, uid2[j], apart)
                best2.meet(j, uid[i], apart)
            else:
                left.append(uid[i])
                right.append(uid2[j])
        if closest:
            (a, b), (c, d) = best.pairs(uid), best2.pairs(uid2)
            left, right = [a, c], [b, d]
        return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, []
        names = ["uid", "at", "part", "parity", "stays"]
        for batch in batches:
            token, block, away = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "block", "away"))
            edge = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (away[1:] != away[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(token)], strict=True):
                rows = [batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in names]
                if key != (token[lo], block[lo]):
                    key, home = (token[lo], block[lo]), []
                found = []
                if away[lo]:
                    if home:
                        found.append(compare(home, rows, "away"))
                else:  # members of the block, in one or more pieces
                    if home:
                        found.append(compare(home, rows, "home"))
                    found.append(compare(rows, rows, "same"))
                    home = [np.concatenate(x) for x in zip(home, rows, strict=True)] if home else rows
                for a, b in found:
                    if len(a):
                        yield _pair_batch(a, b)

    return run


def _place(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))


def _bit_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Flags, set at the places of the saved ids(column): a test without false negatives, of bounded size."""
    size = min(max(1 << (16 * ids.count()).bit_length(), FILTER[0]), FILTER[1])
    words = ids.select(_place(column, size).alias("p")).groupBy(F.expr("int(shiftright(p, 6))").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(p, 64))))").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def _pick(df: DataFrame, bits: Broadcast, size: int, column: str, flagged: bool = True) -> DataFrame:
    """The rows of df whose id's flag is set, or is not set."""
    (place,) = fresh(df.columns, "place")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bits.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            here = (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == flagged
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(here))
        release()

    return df.withColumn(place, _place(column, 8 * size)).mapInArrow(pick, df.schema)


def _matching(size: int):
    """Keeps the rows (uid, text) whose text is that of the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found, bounds = _sets(part.column("text"), size, None)
                yield part.filter(pa.array(_prints(found, bounds, np.diff(bounds), 1).view(np.int64) == part.column("uid").to_numpy()))

    return run


def verify(pairs: DataFrame, units: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs(a, b) of units whose texts are similar enough; saved."""
    used = save(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().join(units.select("uid", "doc_id"), "uid"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = _bit_filter(used, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    texts = save(_pick(read, shared, len(bits), "doc_id").join(used, "doc_id").select("uid", "text"))
    shared.destroy()
    if texts.count() > used.count():  # an id of several rows: one that holds the unit's text is enough
        own = texts.mapInArrow(_matching(size), texts.schema).dropDuplicates(["uid"])
        texts, several = save(own), texts
        drop(several)
    first = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text_a"):
                sets, ok = [], np.ones(part.num_rows, bool)
                for side in ("a", "b"):
                    found, bounds = _sets(part.column(f"text_{side}"), size, None)
                    n = np.diff(bounds)
                    # a doc_id may stand for another text than the one that the unit names
                    ok &= _prints(found, bounds, n, 1).view(np.int64) == part.column(side).to_numpy()
                    sets.append((found, n))
                (x, n), (y, m) = sets
                doc = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
                value = np.concatenate([x, y])
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                same = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(doc[1:][same], minlength=len(n))
                ok &= 100 * shared >= percent * (n + m - shared)
                at = pa.array(np.flatnonzero(ok))
                yield part.select(["a", "b"]).take(at)
        release()

    out = save(both.mapInArrow(check, "a long, b long"))
    drop(used)
    drop(texts)
    return out


def _early(percent: int) -> Column:
    """Whether a posting stands so early in its set that the set can be the smaller one of a pair that meets there first.

    Sets of sizes n >= m that share nothing before positions i and j have
    (100 + percent) * (m - j) >= percent * (n + m) >= 2 * percent * m, if they
    are similar.  So two postings that are both late never make a pair: texts
    that share a passage and have much of their own before it in the order.
    """
    n = F.shiftright("at", 32)
    return (100 + percent) * (n - F.col("at").bitwiseAND(F.lit(PLACE))) >= 2 * percent * n


def _parts(units: DataFrame, links: DataFrame) -> DataFrame:
    """uid, gid, n, doc_id and part for every unit."""
    found = components(links)
    return save(units.join(found, units.uid == found.node, "left").select("uid", "gid", "n", "doc_id", F.coalesce("component", "uid").alias("part")))


def _open_rows(big: DataFrame, several: DataFrame, parts: DataFrame, book: DataFrame, percent: int) -> DataFrame:
    """token, uid, at, part and parity of the members of all buckets that span components; saved.

    Without an early posting that is small enough, a late one is left out.
    """
    inside = parts.join(several, "gid").select("gid", "hub", "k", F.col("uid").alias("m"), "n", F.col("part").alias("of_m"))
    groups = inside.groupBy("gid", "hub", "k").agg(F.min("of_m").alias("lo"), F.max("of_m").alias("hi"))
    posted = big.join(parts.select(F.col("uid").alias("hub"), "part"), "hub").join(groups.select("hub", "lo", "hi"), "hub", "left")
    size, early = F.shiftright("at", 32), _early(percent)
    least, most = (f(F.when(early, size)) for f in (F.min, F.max))
    spans = posted.groupBy("token").agg(F.min(F.coalesce("lo", "part")).alias("lo"), F.max(F.coalesce("hi", "part")).alias("hi"), least.alias("least"), most.alias("most"))
    met = posted.select("token", "hub", "at", "part").join(spans.filter("lo <> hi AND least IS NOT NULL").select("token", "least", "most"), "token")
    rows = met.filter(early | ((size >= F.col("least")) & (percent * size <= 100 * F.col("most")))).select("token", "hub", "at", "part")
    rows = rows.join(inside.select("hub", "m", "of_m"), "hub", "left").select("token", F.coalesce("m", "hub").alias("uid"), "at", F.coalesce("of_m", "part").alias("part"))
    # in the bucket of a smaller group all pairs have met
    own = inside.join(groups.filter((F.col("lo") != F.col("hi")) & (F.col("k") > SMALL)).select("gid"), "gid")
    rows = save(rows.union(own.select(F.col("gid").alias("token"), F.col("m").alias("uid"), F.shiftleft("n", 32).alias("at"), F.col("of_m").alias("part"))))
    named = rows.select("uid").distinct()
    parities = book.select("uid", "parity").join(named, "uid", "left_semi").dropDuplicates(["uid"])
    out = save(rows.join(parities, "uid").select("token", "uid", "at", "part", "parity"))
    drop(rows)
    return out


def _remaining(rows: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a, b) of the open rows: every one that may be similar, or the closest partner of each row only; saved."""
    early = _early(percent)
    by_part = rows.groupBy("token", "part").agg(F.count("*").alias("c"), F.sum(early.cast("int")).alias("e"))
    counts = by_part.groupBy("token").agg(F.sum("c").alias("total"), F.sum("e").alias("early"), F.max_by("part", "c").alias("main"), F.max_by("c", "c").alias("of_main"), F.max_by("e", "c").alias("early_main"))
    many = save(counts.filter(F.col("total") > BLOCK))
    fields = "a long, b long, token long, at long"
    marked = rows.join(many, "token", "left")
    whole = marked.filter("total IS NULL").select("token", "uid", "at", "part", "parity")
    whole = whole.repartition(F.col("token")).sortWithinPartitions("token", F.shiftright("at", 32), "uid")
    found = whole.mapInArrow(_whole_buckets(percent, closest), fields)
    if many.limit(1).count():
        blocks = F.ceil(F.col("total") / BLOCK).cast("int")
        # a pair has an early posting, and one outside the commonest component: those that are both are sent to every block,
        # and either the early ones of the commonest component or the late ones outside it, whichever are fewer
        common, late = F.col("part") == F.col("main"), F.expr("total - of_main - (early - early_main)")
        sent = (early & ~common) | F.when(F.col("early_main") <= late, early & common).otherwise(~early & ~common)
        split = marked.filter("total IS NOT NULL").select(
            "token", "uid", "at", "part", "parity", (~sent).alias("stays"), blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).cast("int").alias("block")
        )
        rare = split.filter("NOT stays").withColumn("to", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> block)")))
        columns = ["token", "uid", "at", "part", "parity", "stays"]
        dealt = split.select(*columns, "block", F.lit(False).alias("away")).union(rare.select(*columns, F.col("to").alias("block"), F.lit(True).alias("away")))
        dealt = dealt.repartition("token", "block").sortWithinPartitions("token", "block", "away")
        found = found.union(dealt.mapInArrow(_block_buckets(percent, closest), fields))
    out = save(found.select("a", "b").distinct())
    drop(many)
    return out


def join(docs: DataFrame, percent: int = 75, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    context = docs.sparkSession.sparkContext
    counts = context.broadcast(frequencies(docs, size))
    book = save(digests(docs, counts, percent, size))
    full = book.filter("n > 0")
    units = save(full.groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.first("gid").alias("gid"), F.first("n").alias("n")))
    # only groups of several rows have to meet before one of their rows is posted
    repeated = save(full.groupBy("gid").count().filter("count > 1"))
    bits = _bit_filter(repeated, "gid")
    shared = context.broadcast(bits)
    rows = full.select("gid", "uid", "n", "prefix")
    met = _pick(rows, shared, len(bits), "gid").groupBy("gid").agg(F.min(F.struct("uid", "n", "prefix")).alias("h"), (F.min("uid") != F.max("uid")).alias("several")).select("h.*", "several")
    hubs = _pick(rows, shared, len(bits), "gid", False).select("uid", "n", "prefix", F.lit(False).alias("several")).union(met)
    several = save(units.groupBy("gid").agg(F.count("*").alias("k"), F.min("uid").alias("hub")).filter("k > 1"))
    keys = F.ceil(F.col("k") / SPREAD)
    marks = F.shiftleft("n", 32) + F.lit(INSIDE) + F.when(keys > 1, F.lit(HOT)).otherwise(F.lit(0))
    inside = units.join(several, "gid").select(F.col("gid").alias("token"), "uid", marks.cast("long").alias("at"), F.pmod(F.xxhash64("uid"), keys).cast("long").alias("key"))
    postings = hubs.mapInArrow(_exploder(counts), "token long, uid long, at long, key long").union(inside)
    dealt = postings.repartition("token", "key").sortWithinPartitions("token", "key", F.shiftright("at", 32), "uid")
    found = save(dealt.mapInArrow(_first_round(percent), "a long, b long, token long, at long"))
    counts.destroy()
    shared.destroy()
    drop(repeated)

    pairs = save(found.filter("token IS NULL").select("a", "b").distinct())
    big = found.filter("token IS NOT NULL").select("token", F.col("a").alias("hub"), "at")
    links = verify(pairs, units, docs, percent, size)
    parts = _parts(units, links)
    for closest in (True, False):
        rest = _open_rows(big, several, parts, book, percent)
        if rest.limit(1).count():
            more = _remaining(rest, percent, closest)
            fresh_pairs = save(more.join(pairs, ["a", "b"], "left_anti"))
            if fresh_pairs.limit(1).count():
                drop(parts)
                links = links.union(verify(fresh_pairs, units, docs, percent, size))
                parts = _parts(units, links)
                pairs = pairs.union(fresh_pairs)
            drop(more)
        drop(rest)
    names = save(parts.groupBy("part").agg(F.min("doc_id").alias("component_id")))
    by_unit = save(parts.join(names, "part").select("uid", "component_id"))
    for x in (units, several, found, parts, names):
        drop(x)
    out = book.select("doc_id", F.col("n").alias("n_shingles"), "uid").join(by_unit, "uid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, percent: int = 75, size: int = SIZE) -> DataFrame:
    """docs with one row of each component: the one that names it.

    Rows that are the same in id and text count as one; rows without an id all stay.
    """
    found = save(join(docs, percent, size).select("doc_id", "component_id"))
    goes, k, key = fresh(docs.columns, "goes", "k", "key")
    by_id = found.groupBy(F.col("doc_id").alias(key)).agg(F.min((F.col("component_id") != F.col("doc_id")).cast("int")).alias(goes), F.count("*").alias(k))
    noted = save(by_id.filter(f"{key} IS NOT NULL AND ({goes} = 1 OR {k} > 1)"))
    bits = _bit_filter(noted, key)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    seen = _pick(docs, shared, len(bits), "doc_id").join(noted, F.col("doc_id").cast("long") == F.col(key), "left").filter(F.coalesce(goes, F.lit(0)) == 0)
    once = seen.filter(F.coalesce(k, F.lit(1)) == 1).select(*docs.columns)
    repeated = seen.filter(F.col(k) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return _pick(docs, shared, len(bits), "doc_id", False).select(*docs.columns).union(once).union(repeated)


def op2(docs: DataFrame) -> DataFrame:
    """Five-word shingles, similarity of at least 0.75."""
    return join(docs, 75, SIZE)


__all__ = ["digests", "distinct", "frequencies", "join", "op2", "verify"]
