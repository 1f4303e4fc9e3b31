"""Near-duplicate embeddings: Euclidean p-stable hashing with exact cosine checks.

Equal vectors of one label form a class that is compared once and counts with
its multiplicity.  Class vectors are normalised; TABLES tables each hash them
by WIDTH-quantised random projections, and classes that share a bucket are
compared by cosine in double precision.  Only hashes are shuffled to find the
shared buckets; a vector then goes to those, and not to buckets of its own.  A pair is counted in the first table
where it meets, so link counts need no list of pairs; components need only a
spanning forest of each bucket's links.  A bucket of more than BLOCK classes
is split into blocks, and each pair of blocks is a task of its own, so every
pair of the bucket is still compared.

Vectors at cosine 0.93 (distance 0.374) meet in some table with probability
0.989, closer ones more surely; the tests measure recall against brute force.

Defined cases: a vector that is null, zero, empty, or holds a null or
non-finite component, or whose label is null, links with nothing; vectors of
different lengths are never compared; rows that share a vec_id are vectors of
their own but get the least id of their component; a vector without a vec_id is
compared and linked like any other, names no component, and has a null `kept`;
an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .scratch import save
from .textkit import mix

TABLES = 24
HASHES = 5
WIDTH = 1.0
BLOCK = 1024
SMALL = 96
THRESHOLD = 0.93


def signatures(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The bucket of each normalised vector in each table, as 64-bit hashes that include label and length."""
    dim = vectors.shape[1]
    rng = np.random.default_rng(dim)
    axes = rng.standard_normal((TABLES * HASHES, dim))
    shift = rng.uniform(0, WIDTH, TABLES * HASHES)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ axes.T + shift) / WIDTH).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(vectors), TABLES, HASHES)
    out = np.broadcast_to(labels.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(1000003) + np.uint64(dim), cells.shape[:2])
    out = mix(out + np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(HASHES):
        out = mix(out * np.uint64(31) + cells[:, :, k])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        size = np.diff(batch.column("vector").offsets.to_numpy())
        for n in np.unique(size):
            part = batch.take(pa.array(np.flatnonzero(size == n)))
            yield part, _matrix(part.column("vector"))


def _to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, vectors in _by_length(batches):
        n = part.num_rows
        sig = signatures(vectors, part.column("label").to_numpy())
        arrays = [pa.array(sig.ravel().view(np.int64)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)), part.column("cid").take(pa.array(np.repeat(np.arange(n), TABLES)))]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "tab", "cid"])


def _pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(cid, links) and (a, b) of sorted rows that hold whole task keys."""
    key = rows.column("bucket").to_numpy()
    side_a, side_b = rows.column("bi").to_numpy(), rows.column("bj").to_numpy()
    own = rows.column("own").to_numpy()
    cid, mult, tab = (rows.column(c).to_numpy() for c in ("cid", "n", "tab"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (side_a[1:] != side_a[:-1]) | (side_b[1:] != side_b[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    vectors, tabs, marks = (rows.column(c).combine_chunks() for c in ("vector", "tabs", "marks"))
    long = vectors.value_lengths().to_numpy()

    def unit(at):
        own = _matrix(vectors.take(pa.array(at)))
        return own / np.linalg.norm(own, axis=1, keepdims=True)

    def mark(at):
        at = pa.array(at)
        own, out = tabs.take(at), np.zeros((len(at), TABLES), np.int64)
        out[np.repeat(np.arange(len(at)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = marks.take(at).flatten().to_numpy()
        return out

    for n in np.unique(size[(size > 1) & (size <= SMALL)]):
        starts = first[size == n]
        for lo in range(0, len(starts), max(1, 200_000 // int(n * n))):
            at = (starts[lo : lo + max(1, 200_000 // int(n * n))][:, None] + np.arange(n)).ravel()
            for d in np.unique(long[at]):
                pick = at[long[at] == d]
                u, m = unit(pick).reshape(-1, n, d), mark(pick).reshape(-1, n, TABLES)
                i, j = np.triu_indices(n, 1)
                cos = np.einsum("gid,gjd->gij", u, u)[:, i, j]
                g, p = np.nonzero((cos >= threshold))
                a, b = pick.reshape(-1, n)[g, i[p]], pick.reshape(-1, n)[g, j[p]]
                fair = (side_a[a] == side_b[a]) | (own[a] != own[b])  # two blocks: only pairs across them
                yield from _emit(a[fair], b[fair], _meets(m[g, i[p]], m[g, j[p]])[fair], tab, cid, mult)
    for f, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        at = np.arange(f, f + n)
        left = at[own[at] == side_a[at]]
        right = at[own[at] == side_b[at]]
        same = side_a[f] == side_b[f]
        u, v, m, w = unit(left), unit(right), mark(left), mark(right)
        for lo in range(0, len(left), 256):
            ok = u[lo : lo + 256] @ v.T >= threshold
            if same:
                ok &= np.arange(len(right))[None, :] > np.arange(lo, min(lo + 256, len(left)))[:, None]
            i, j = np.nonzero(ok)
            for s in range(0, len(i), 100_000):
                x, y = i[s : s + 100_000] + lo, j[s : s + 100_000]
                yield from _emit(left[x], right[y], _meets(m[x], w[y]), tab, cid, mult)


def _meets(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether two rows share their bucket, by table; 0 stands for a bucket of one class."""
    return (m == w) & (m != 0)


def _emit(a, b, meets, tab, cid, mult):
    """Counts and forest of links between rows a and b; `meets` tells by table whether they share a bucket."""
    if not len(a):
        return
    counted = meets.argmax(1) == tab[a]
    a, b = a[counted], b[counted]
    if not len(a):
        return
    nodes, flat = np.unique(np.concatenate([cid[a], cid[b]]), return_inverse=True)
    links = np.bincount(flat, weights=np.concatenate([mult[b], mult[a]])).astype(np.int64)
    yield (nodes, links, *forest(cid[a], cid[b]))


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (cid, links, other): partial link counts (other null) and forest edges (links 0) of the classes."""
    hashed = classes.mapInArrow(_to_buckets, "bucket long, tab int, cid long")
    shared = hashed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1 AND bucket <> 0").withColumn("blocks", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int"))
    # buckets of one class end here, as three numbers; a vector then travels to its shared buckets only
    met = hashed.join(shared.select("bucket", "blocks"), "bucket").groupBy("cid").agg(F.collect_list(F.struct("tab", "bucket", "blocks")).alias("met"))
    spread = classes.select("cid", "n", "vector").join(met, "cid").select("cid", "n", "vector", F.col("met.tab").alias("tabs"), F.col("met.bucket").alias("marks"), F.inline("met"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = spread.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), "own", "tab", "cid", "n", "vector", "tabs", "marks")
    keys = ["bucket", "bi", "bj"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows):
            for nodes, n, a, b in _pairs(rows, threshold):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([nodes, a])),
                        pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])),
                        pa.array(np.concatenate([np.zeros(len(nodes), np.int64), b]), mask=np.arange(len(nodes) + len(a)) < len(nodes)),
                    ],
                    ["cid", "links", "other"],
                )

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 4000:
                continue
            rows = pa.Table.from_batches(held)
            key = np.stack([rows.column(c).to_numpy() for c in keys])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            if len(cut):
                yield from flush(rows.slice(0, int(cut[-1]) + 1))
                held = rows.slice(int(cut[-1]) + 1).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return save(dealt.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys).mapInArrow(compare, "cid long, links long, other long"))


def op9(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings."""
    fine = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = table.select(
        "vec_id",
        F.col("label").cast("long").alias("label"),
        F.expr("transform(embedding, x -> double(x))").alias("vector"),
        F.expr(f"label IS NOT NULL AND embedding IS NOT NULL AND coalesce({fine}, false)").alias("fine"),
        # single precision travels as such; norms and cosines are in double precision all the same
        (F.col("embedding") if table.schema["embedding"].dataType.simpleString() == "array<float>" else F.expr("transform(embedding, x -> double(x))")).alias("given"),
    )
    keyed = rows.withColumn("k1", F.xxhash64(F.lit(1), "label", "vector")).withColumn("k2", F.xxhash64(F.lit(2), "label", "vector"))
    grouped = save(
        keyed.filter("fine").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("given").alias("vector")
        )
    )  # a class id of its own, as rows may share a vec_id
    classes = grouped.select(F.col("k1").alias("cid"), "n", "label", "vector")
    found = links(classes, threshold)
    counts = found.filter("other IS NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.filter("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    named = grouped.join(parts, grouped.k1 == parts.node, "left").join(counts, grouped.k1 == counts.cid, "left")
    named = named.select(
        "k1", "k2", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "k1").alias("part")
    )
    named = save(named)
    roots = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    by_class = save(named.join(roots, "part").select("k1", "k2", "n_links", "component_id"))
    slim = keyed.select("vec_id", "fine", F.when(F.col("fine"), F.col("k1")).otherwise(F.xxhash64("vec_id")).alias("k1"), "k2")
    joined = slim.join(by_class.withColumnRenamed("k2", "c2"), "k1", "left").filter("NOT fine OR c2 = k2")
    part = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("fine"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        part.alias("component_id"),
        (F.col("vec_id") == part).alias("kept"),
    )
