"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import classlm, divergence, embeddings, factorization, langid, licenses, linededup, mixing, ngramjoin, packing, rules, search, stringkernel
from .textkit import table


def op1_quality_fm(spark, sf_dir):
    return factorization.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngramjoin.op2(table(spark, sf_dir, "documents"))


def op3_class_lm(spark, sf_dir):
    return classlm.op3(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return stringkernel.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark, sf_dir):
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return licenses.op6(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return langid.op7(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.op8(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark, sf_dir):
    return embeddings.op9(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark, sf_dir):
    return rules.op10(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask"
    )


def op11_line_dedup(spark, sf_dir):
    return linededup.op11(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return divergence.op12(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return search.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_class_lm": op3_class_lm,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_line_dedup": op11_line_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op5_source_mixing": mixing.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op11_line_dedup": linededup.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_lexical_search": search.ORACLE,
}
