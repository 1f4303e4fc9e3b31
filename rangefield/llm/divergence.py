"""Audit of how the sources of a language differ in their words.

Terms are the runs of ASCII letters and non-ASCII characters, A-Z lower-cased.
A language keeps the terms that at least `min_docs` of its documents hold (V of
them).  A group of documents gives a kept term that occurs `count` times there
the share p = 1 + floor(SCALE * (count + 1) / (N + V)), N being all its kept
terms.  f(p, q) = floor((p - q)^2 / q) says how far p is from q.

The sum of f over all kept terms is not computed term by term for each pair of
sources.  A pair starts at V * f(zero, zero), as if neither source had any
term, and the postings of each term (the sources that have it) only correct it:

- a term that the one source has adds f(p, zero) - f(zero, zero), and one that
  the other has f(zero, q) - f(zero, zero); as that depends on its count alone,
  terms of a source are first grouped by count;
- a term that both have adds f(p, q) - f(p, zero) - f(zero, q) + f(zero, zero);
  these are summed inside the tasks, which give out sums by pair.

Terms are counted inside each task first, so hot sources and words reach a
shuffle as one row a task.  The list of a term's sources is bounded by the
number of sources of its language, whose square the result has anyway.

All arithmetic is exact: SCALE * count in decimals, everything else in 64 bits,
which hold the sums up to V = 5 * 10^8.

Defined cases: null text, lang and source count as ''; a group without terms
has pairs (0 if its language keeps no term) and no term rows; rows are
documents, so repeated rows count as often as they are there; ties are ordered
by the item's UTF-8 bytes; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .tally import Tally
from .textkit import Words, release, text_slices

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BYTES = np.arange(256)
TERM = (BYTES >= 128) | ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122))
#: Pairs of postings that a task expands at a time.
PAIRS = 1 << 20


def tokens(words: Words) -> pa.Array:
    """The words as strings."""
    bounds = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(words.buf[words.solid])))


def count_slice(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences) and df (documents) of a slice of documents."""
    words = Words(batch.column("text"), lower=True, keep=TERM)
    coded = tokens(words).dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    key, n = np.unique(words.doc * max(len(terms), 1) + code, return_counts=True)
    doc, code = np.divmod(key, max(len(terms), 1))
    rows = pa.table({"lang": batch.column("lang").take(pa.array(doc)), "source": batch.column("source").take(pa.array(doc)), "term": pa.array(code), "n": n.astype(np.int64), "df": np.ones(len(n), np.int64)})
    rows = rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    names = pc.cast(terms, pa.string()).take(rows.column("term").combine_chunks())
    return pa.table({"lang": rows.column("lang"), "source": rows.column("source"), "term": names, "n": rows.column("n_sum"), "df": rows.column("df_sum")})


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and df of each task of docs(lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Tally(["lang", "source", "term"], ["n", "df"])
        for batch in batches:
            for part in text_slices(batch):
                yield from sums.add(count_slice(part))
        yield from sums.rest()
        release()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); null where there is nothing to divide by."""
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div nullif(CAST({total} + {kept} AS DECIMAL(20, 0)), 0)")


def apart(p: str, q: str) -> Column:
    """f(p, q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def both(p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """What a term that both sources have adds to the corrections of either."""

    def f(a, b):
        return (a - b) * (a - b) // b

    return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)


def posting_pairs(postings: DataFrame) -> DataFrame:
    """Sums of `both` by (lang, one, other) of postings(lang, list of struct(no, p, p0)), several rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Tally(["lang", "one", "other"], ["value"])
        for batch in batches:
            lists = batch.column("list")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            no, p, p0 = (pc.struct_field(flat, x).to_numpy() for x in ("no", "p", "p0"))
            first = np.cumsum(size) - size
            block = (np.cumsum(size * size) - 1) // PAIRS
            for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(block)) + 1):
                if not len(rows):
                    continue
                s = size[rows]
                row = np.repeat(rows, s * s)
                place = np.arange(len(row)) - np.repeat(np.cumsum(s * s) - s * s, s * s)
                a, b = first[row] + place // size[row], first[row] + place % size[row]
                differ = a != b
                a, b, row = a[differ], b[differ], row[differ]
                part = pa.table({"lang": batch.column("lang").take(pa.array(row)), "one": no[a], "other": no[b], "value": both(p[a], p[b], p0[a], p0[b])})
                whole = part.group_by(["lang", "one", "other"]).aggregate([("value", "sum")])
                yield from sums.add(whole.select(["lang", "one", "other", "value_sum"]).rename_columns(["lang", "one", "other", "value"]))
        yield from sums.rest()
        release()

    return postings.mapInArrow(run, "lang string, one int, other int, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: all other sources, and the `top` terms that stand out."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    held = counted.withColumns({"docs": F.sum("df").over(by_term), "n_lang": F.sum("n").over(by_term), "head": F.row_number().over(by_term.orderBy("source"))})
    book = scratch.save(held.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "head"))

    sizes = book.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = book.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum(F.when(F.col("head") == 1, 1).otherwise(0)).cast("long").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "total_lang", "kept"]).withColumns({"p0": share("0", "total", "kept"), "no": F.row_number().over(Window.partitionBy("lang").orderBy("source"))})
    groups = scratch.save(groups)

    shares = book.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    terms = shares.withColumn("q", share("n_lang", "total_lang", "kept")).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    other = groups.select("lang", F.col("no").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    zeros = groups.join(other, "lang").filter("no <> other")
    base = zeros.select("lang", F.col("no").alias("one"), "other", F.coalesce(F.col("kept") * apart("p0", "q0"), F.lit(0)).alias("value"))
    alike = shares.groupBy("lang", "no", "p", "p0").agg(F.count("*").alias("terms"))
    facing = alike.join(other, "lang").filter("no <> other")
    mine = facing.select("lang", F.col("no").alias("one"), "other", (F.col("terms") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    theirs = facing.select("lang", F.col("other").alias("one"), F.col("no").alias("other"), (F.col("terms") * (apart("q0", "p") - apart("q0", "p0"))).alias("value"))
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "p0")).alias("list")).filter(F.size("list") > 1).select("lang", "list")
    sums = base.union(mine).union(theirs).union(posting_pairs(lists)).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    named = sums.join(groups.select("lang", F.col("no").alias("one"), "source"), ["lang", "one"]).join(other, ["lang", "other"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(ranked)


def op12(docs: DataFrame) -> DataFrame:
    """The audit of all documents."""
    return audit(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n_lang FROM t GROUP BY lang, term HAVING count(*) >= 3),
posts AS (SELECT t.lang, t.source, t.term, sum(t.n)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total_lang FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM posts GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0)::HUGEINT AS total FROM d LEFT JOIN sizes s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(p.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(p.n, 0) + 1)) // (g.total + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n_lang + 1)) // (l.total_lang + l.v) AS q
  FROM g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN posts p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
bare AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM langs)),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
