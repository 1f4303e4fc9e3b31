"""The corpus pipeline: quality rules, toxicity, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`, extra columns with them, unchanged
whatever their names.  Each works on everything that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangefield.llm import mixing, ngramjoin, packing, rules, scratch, stringkernel
from rangefield.llm.textkit import id_part, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _hidden(docs: DataFrame) -> DataFrame:
    """docs with its further columns in one, so that none meets a column of an operator."""
    more = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*[F.col(f"`{c}`") for c in more]).alias("further")) if more else docs


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of rows made from `_hidden(docs)`."""
    return rows.select(*[F.col(c) if c in COLUMNS else F.col("further").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy stay.

    A null or empty text fails; equal rows fare alike, each for itself; a null id changes nothing; an empty table stays empty.
    """
    return _shown(rules.apply_policy(rules.ledger(_hidden(docs))).filter("kept"), docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine does not call toxic stay; it learns from the labels outside the held-out fold.

    A null or empty text stays; without labels of both classes all stay; equal rows fare alike, each for itself; a null id changes nothing.
    """
    machine = stringkernel.train(docs, table(spark, sf_dir, "labels"), id_part(3) != 1)
    own = _hidden(docs)
    return _shown(stringkernel.score(own, machine, tuple(own.columns)).filter(F.col("score") < stringkernel.PREDICT_AT), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays: the one with the least id.

    Rows that are the same in id and text count as one, any of them; texts without words are similar to none; rows without an id stay.
    """
    return _shown(ngramjoin.distinct(_hidden(docs)), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that all sources get equal shares; a doc_id then stands for each of its copies.

    A null source is one of its own; a source without characters goes; rows of one id, or of none, draw the same count.
    """
    return _shown(mixing.replicate(_hidden(docs)), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is one piece of the end id; repeated rows, and rows without an id, are packed each for itself.
    """
    return packing.op8(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the kernel machine and the tokenizer; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage returns is written and read again, and goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
