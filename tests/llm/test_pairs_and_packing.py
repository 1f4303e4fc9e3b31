"""Packing, embeddings, rules, mixing and language against brute force on small tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rangefield.llm import embeddings, langid, mixing, packing, rules

DOC = "doc_id long, text string, lang string, source string, n_chars long, piece int, score double"


def docs(spark, rows, schema=DOC):
    n = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], schema)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "one", "en", "b"),
    (5, "the cat sat on the mat " * 2000, "en", "b"), (6, "le chat est là " * 5, "fr", None), (6, "le chat est là " * 5, "fr", None),
    (None, "no id here", None, "a"), (7, "<|endoftext|> don't 日本 É", "fr", "a"),
]


def test_packing_matches_the_library(spark, sf):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark, ODD).select("doc_id", "text"))
    rows = packing.op8(table).collect()
    library = Tokenizer.from_file(packing.word_bpe())
    expected = Counter()
    for doc, text in table.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[(doc, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert expected == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_rounds_of_packing_exchange(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 3000, 3000)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), group=200).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= packing.lower_bound(sizes) * 1.02 + 1


def test_bounds_never_exceed_best_fit():
    rng = np.random.default_rng(3)
    for top in (500, 2100, 4096):
        for _ in range(20):
            sizes = rng.integers(1, top, rng.integers(1, 200))
            number, offset, fill = packing.best_fit(sizes)
            assert packing.lower_bound(sizes) <= len(fill) and fill.max() <= 4096
            assert np.array_equal(np.bincount(number, weights=sizes).astype(int), fill)
    assert packing.lower_bound(np.full(7, 2100)) == 7


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert packing.op8(empty).count() == 0
    assert rules.op10(empty).count() == 0
    assert mixing.op5(empty).count() == 0
    assert langid.op7(empty).count() == 0
    assert embeddings.op9(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_links(rows):
    out = {}
    for i, a, la in rows:
        out[i] = set()
        for j, b, lb in rows:
            ok = i != j and la is not None and la == lb and a and b and len(a) == len(b) and None not in a and None not in b
            if ok:
                x, y = np.array(a, float), np.array(b, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                        out[i].add(j)
    return out


def test_embeddings_against_brute_force(spark, sf):
    rng = np.random.default_rng(1)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    base = rng.standard_normal((20, 64))
    rows += [(10_000 + i, (base[i % 20] + 0.12 * rng.standard_normal(64)).astype("f4").tolist(), 77) for i in range(300)]
    rows += [(20_000 + i, base[0].astype("f4").tolist(), 78) for i in range(200)]
    rows += [(30_000, None, 1), (30_001, [], 1), (30_002, [0.0] * 64, 1), (30_003, [float("nan")] * 64, 1), (30_004, [1.0, 2.0], 1), (30_005, [1.0] * 64, None), (30_006, [None] + [1.0] * 63, 1)]
    got = {r.vec_id: r for r in embeddings.op9(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = brute_links(rows)
    assert set(got) == set(links)
    want, have = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert have >= 0.98 * want
    part = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, others in links.items():
            low = min([part[i], *(part[j] for j in others)])
            if low < part[i]:
                part[i], changed = low, True
    assert sum(part[i] == got[i].component_id for i in part) >= 0.99 * len(part)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_oversized_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.08 * rng.standard_normal(32)).astype("f4").tolist(), 1) for i in range(400)]
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    got = embeddings.op9(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    links = brute_links(rows)
    assert sum(r.n_links for r in got) >= 0.98 * sum(map(len, links.values()))
    assert all(r.n_links <= len(links[r.vec_id]) for r in got)


def brute_rules(text):
    words = [w for w in (text or "").encode().split()]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_rules_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark, ODD).select("doc_id", "text"))
    texts = Counter((r.doc_id, *brute_rules(r.text)) for r in table.collect())
    rows = rules.op10(table).collect()
    assert texts == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rule_verdicts_follow_the_labels(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = rules.apply_policy(rules.ledger(table)).select("quality", "kept", "fail_mask").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows if r.fail_mask & 1 == 0]) > 0.98


def test_ablation_counts(spark):
    table = docs(spark, [(1, "a b c"), (2, "word " * 30), (3, "good plain text that says something new every time and goes on for more than twenty words in all so it stays here")])
    found = {r.rule: (r.n_failed, r.n_only_this) for r in rules.ablation(rules.apply_policy(rules.ledger(table))).collect()}
    assert found["few_words"] == (1, 0) and found["stutter"] == (1, 0) and found["repeated_words"] == (1, 0) and found["short_words"] == (1, 0)


def test_mixing_handles_odd_rows(spark):
    out = mixing.op5(docs(spark, ODD))
    assert {"n_copies", "copy_no", "mix_key", "piece"} <= set(out.columns)
    counts = Counter((r.doc_id, r.copy_no) for r in out.collect())
    assert counts[(6, 0)] in (0, 2)  # repeated rows draw alike
    one = mixing.replicate(docs(spark, [(i, "x" * 10, "en", "a" if i < 3000 else "b") for i in range(4000)]), {"a": 0.5, "b": 0.5})
    by = Counter(r.source for r in one.collect())
    assert abs(by["a"] - 2000) < 250 and abs(by["b"] - 2000) < 250
    assert mixing.replicate(docs(spark, ODD), {}).count() == 0


def test_mixing_of_a_rare_source(spark):
    # b holds 60 of 400,060 characters: its rate of some 3,334 takes several draws
    rows = [(i, "x" * 20_000, "en", "a") for i in range(20)] + [(1000 + i, "y", "en", "b") for i in range(60)]
    out = mixing.replicate(docs(spark, rows), {"a": 0.5, "b": 0.5}).filter("source = 'b'")
    by = out.groupBy("doc_id").agg({"copy_no": "max", "*": "count", "n_copies": "max"}).collect()
    n = np.array([r["count(1)"] for r in by])
    rate = 0.5 * 400_060 / 60
    assert len(n) == 60 and abs(n.sum() - 60 * rate) < 4 * np.sqrt(60 * rate)
    assert 0.4 * rate < n.var(ddof=1) < 1.8 * rate
    assert all(r["count(1)"] == r["max(n_copies)"] == r["max(copy_no)"] + 1 for r in by)
    assert out.select("doc_id", "copy_no").distinct().count() == n.sum()


def test_language_of_odd_rows(spark):
    got = langid.op7(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) and 0 <= r.score <= 1


def test_more_languages_than_a_block(spark):
    # 130 languages, each with a word of its own
    names = [f"l{i:03}" for i in range(130)]
    words = {x: "".join(chr(97 + (i * 7 + k * k * (i // 26 + 3)) % 26) for k in range(12)) for i, x in enumerate(names)}
    table = docs(spark, [(i, f"{words[x]} " * 20, x) for i, x in enumerate(names)])
    got = {r.doc_id: r.lang_pred for r in langid.predict(table, langid.train(table)).collect()}
    assert len(set(words.values())) == 130 and got == dict(enumerate(names))


def test_language_held_out_accuracy(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.op7(table).filter("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


@pytest.mark.parametrize("query", ["op5_source_mixing"])
def test_sql(spark, sf, query):
    import oracle
    from rangefield.llm import queries

    assert not oracle.difference(queries.QUERIES[query](spark, sf), queries.ORACLES[query], sf)


def test_embeddings_without_id_and_with_other_columns(spark):
    """A vector without an id is compared like any other; columns named like those of the result are not looked at."""
    close = [1.0, 0.1, 0.0]
    rows = [(1, close, 0), (2, [1.0, 0.12, 0.0], 0), (None, [1.0, 0.11, 0.0], 0), (4, [0.0, 0.0, 1.0], 0), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, close, None), (8, close, 1)]
    table = spark.createDataFrame([(*r, 9, 9, True, "b") for r in rows], "vec_id long, embedding array<float>, label int, n_links long, component_id long, kept boolean, bucket string")
    out = embeddings.op9(table)
    assert out.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert len(got) == 8 and {k: got[k] for k in (1, 4, 5, 6, 7, 8)} == {1: (2, 1, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True)}
    assert got[None] == (2, 1, None)
