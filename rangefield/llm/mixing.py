"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

A source that holds the share s of all characters and should hold the share w
gets the mean repetition rate r = epochs * w / s.  Each document draws its
count from a Poisson distribution with that mean: the md5 of seed and id is a
number u in [0, 1), and the count is the least k whose distribution function
exceeds u.  Documents are exploded by their counts and shuffled globally by a
second hash of id and copy number.

The distribution function is tabulated once per source: one row per source
with an array of doubles whose length follows from the rate.  A rate above
PART_RATE is cut into equal parts of at most that: a document draws once for
each part, by a hash of its own, and its count is the sum, which has the
Poisson distribution of the whole rate.  So no rate is too high, and a source
of any size reaches its target weight.  Up to
BROADCAST_SOURCES sources the table is broadcast (their number is counted
first); beyond that it joins by source, where Spark splits a hot source's
partition.

Defined cases: a null source is a source of its own; a null text has no
characters; a source without characters, or whose target weight is 0, has
rate 0; repeated rows with one id draw the same count, each for itself; a
count beyond 2 ** 31 - 1 raises an error; an empty table stays empty; extra columns pass through (those named `n_copies`,
`copy_no` or `mix_key` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
EPOCHS = 1.0
#: Highest mean rate of one draw: exp(-rate) must stay a normal double.
PART_RATE = 700.0
#: Copies made at once from a row, so that no row needs an array of all its copies.
BLOCK = 1000
#: Most sources whose table is broadcast.
BROADCAST_SOURCES = 10_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """Per source: characters, target share and mean repetition rate; without `weights` all sources are equal."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        share = F.lit(1.0)
    else:
        known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = sizes.withColumn("weight", F.when(F.col("chars") > 0, share).otherwise(0.0))
    total = weighed.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.lit(float(epochs)) * (F.col("weight") / F.col("all_weight")) / (F.col("chars") / F.col("all_chars"))
    return weighed.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "chars",
        F.when((F.col("all_weight") > 0) & (F.col("chars") > 0), rate).otherwise(0.0).alias("rate"),
    )


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the tail no longer matters."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED, key: str = "doc_id"
) -> DataFrame:
    """docs' rows by their Poisson counts with n_copies and copy_no (from 0), in a shuffled order (mix_key)."""
    docs = docs.drop("n_copies", "copy_no", "mix_key")
    table = rates(docs, weights, epochs).select(F.col("source").alias("__source"), "rate")
    found = table.limit(BROADCAST_SOURCES + 1).collect()
    if len(found) <= BROADCAST_SOURCES:
        table = F.broadcast(docs.sparkSession.createDataFrame(found, table.schema))
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_RATE)), F.lit(1).cast("long"))
    plan = table.withColumn("__parts", parts).select("__source", "__parts", cumulative(F.col("rate") / F.col("__parts")).alias("__cdf"))

    def draw(u: Column) -> Column:
        return F.size(F.filter("__cdf", lambda x: x <= u)).cast("long")

    more = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("__parts") - 1),
        F.lit(0).cast("long"),
        lambda total, j: total + draw(unit(F.lit(seed), F.lit("part"), F.col(key), j)),
    )
    drawn = (
        docs.withColumn("__u", unit(F.lit(seed), F.col(key)))
        .join(plan, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("n_copies", (draw(F.col("__u")) + F.when(F.col("__parts") > 1, more).otherwise(0)).cast("int"))
        .drop("__source", "__parts", "__cdf", "__u")
        .filter("n_copies > 0")
    )
    blocks = drawn.withColumn("__block", F.explode(F.sequence(F.lit(0), F.expr(f"int((n_copies - 1) div {BLOCK})"))))
    first = F.col("__block") * BLOCK
    # the last block ends with the last copy; written so that nothing passes the largest int
    copies = blocks.withColumn("copy_no", F.explode(F.sequence(first, first + (F.least(F.col("n_copies") - first, F.lit(BLOCK)) - 1)))).drop("__block")
    mixed = copies.withColumn("mix_key", unit(F.lit(seed), F.lit("order"), F.col(key), F.col("copy_no")))
    return mixed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")


def op5(docs: DataFrame) -> DataFrame:
    """Equal shares for all sources at one epoch of characters in the mean; whole rows, texts included."""
    return replicate(docs)


ORACLE = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
weighed AS (SELECT source, chars, CASE WHEN chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM sizes),
total AS (SELECT sum(chars) AS all_chars, sum(weight) AS all_weight FROM weighed),
rates AS (
  SELECT source, CASE WHEN all_weight > 0 AND chars > 0
    THEN least(1.0::DOUBLE * (weight / all_weight) / (chars / all_chars), 700.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM weighed, total),
terms AS (
  SELECT source, rate, k, CASE WHEN rate = 0 THEN (CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p
  FROM rates, (SELECT unnest(range(0, 1100)) AS k) WHERE k <= rate + 12 * sqrt(rate) + 20),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (
  SELECT *,
    ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents),
counted AS (
  SELECT d.*, CAST(count(*) FILTER (WHERE c.c <= d.u) AS INTEGER) AS n_copies
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(copy_no AS INTEGER) AS copy_no,
  ('0x' || substr(md5('mix-1:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy_no), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496.0::DOUBLE AS mix_key
FROM counted, LATERAL (SELECT unnest(range(0, n_copies)) AS copy_no)
"""
