"""The n-gram Jaccard join against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from rangefield.llm import ngramjoin

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(d, frozenset(shingle_set(t))) for d, t in rows]
    unique = {}
    for d, s in sets:
        unique.setdefault(s, []).append(d)
    keys = [s for s in unique if s]
    index = {}
    for k, s in enumerate(keys):
        for x in s:
            index.setdefault(x, []).append(k)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(keys):
        near = {}
        for x in s:
            for j in index[x]:
                if j > i:
                    near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(keys[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, s in enumerate(keys):
        low[find(i)] = min([low.get(find(i), min(unique[s])), *unique[s]])
    part = {s: low[find(i)] for i, s in enumerate(keys)}
    return sorted((d, len(s), part.get(s, d)) for d, s in sets)


def run(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.op2(table).collect())


def variants(seed, families, size, words, edits):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    return rows


def test_small_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(90001, None), (90002, ""), (90003, " \n "), (90004, "Two words"), (90005, "two WORDS"), (90006, "two words more"), (90004, "Two words")]
    rows += [(90010, "same five words right here " * 3000), (90011, "same five words right here " * 2999)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("edits", [2, 4, 6])
def test_families_around_the_threshold(spark, edits):
    rows = variants(edits, 12, 40, 90, edits)
    assert run(spark, rows) == brute(rows)


def test_one_large_family_with_shared_passage(spark):
    rng = random.Random(9)
    rows = variants(1, 1, 600, 120, 3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(10_000 + i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(40)) + " " + passage) for i in range(300)]
    rows += [(20_000 + i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(8)) + " " + passage) for i in range(100)]
    rows += [(30_000 + i, "an exact copy of one short text " * 4) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_units_of_one_group(spark, monkeypatch):
    # few counters and tiny buckets: many equal prefixes, chains and second rounds
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    monkeypatch.setattr(ngramjoin, "CHUNK", 50)
    rows = variants(3, 6, 30, 30, 1) + [(5000 + i, f"a b c d e f{i % 3}") for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_blocks_and_spread_shingles(spark, monkeypatch):
    # tiny blocks and keys: hot shingles are posted under several keys, large buckets compared block by block
    monkeypatch.setattr(ngramjoin, "BLOCK", 24)
    monkeypatch.setattr(ngramjoin, "SPREAD", 30)
    rows = variants(5, 2, 150, 80, 7) + variants(6, 1, 90, 60, 2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def own_words_and_a_passage(n, seed=4):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(100))
    return [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(20)) + " " + passage) for i in range(n)]


@pytest.mark.parametrize("n", [1500, 3000])
def test_a_shared_passage_is_not_dealt(spark, monkeypatch, n):
    """Texts that share a passage and are not alike: no postings are dealt for them, however many there are."""
    dealt = []
    whole = ngramjoin._open_rows

    def counted(*args):
        out = whole(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(ngramjoin, "_open_rows", counted)
    rows = own_words_and_a_passage(n) + [(n, own_words_and_a_passage(1)[0][1] + " end")]
    got = run(spark, rows)
    assert [r for r in got if r[2] != r[0]] == [(n, 117, 0)] and len(got) == n + 1
    assert sum(dealt) <= 20, dealt


@pytest.mark.parametrize("own", [6, 10, 14, 18])
def test_early_and_late_postings_in_blocks(spark, monkeypatch, own):
    """Texts of many sizes around one passage, some alike and some not, in blocks of a few."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rng = random.Random(own)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join([*(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([own, 2 * own, 3, 40]))), *passage[: rng.choice([100, 90, 60])], *rng.choice([[], ["s"] * 9])])) for i in range(160)]
    rows += [(200 + i, " ".join([*(f"v{i % 4}x{j}" for j in range(own)), *passage])) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_difference_bound_drops_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60, 400, 3000):
        for _ in range(30):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            other = np.concatenate([base[rng.integers(0, n // 3 + 1) :], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1), dtype=np.uint64)])
            both = [np.unique(base), np.unique(other)]
            values, bounds = np.concatenate(both), np.array([0, len(both[0]), len(both[0]) + len(both[1])])
            bits = ngramjoin._bits(ngramjoin._parities(values, bounds).to_numpy(zero_copy_only=False))
            apart, ok = ngramjoin._near(bits[:1], bits[1:], np.array([len(values)]), 75)
            common = len(np.intersect1d(*both))
            assert apart[0] <= len(values) - 2 * common
            assert ok[0] or 100 * common < 75 * (len(values) - common)


def test_no_id_and_other_columns(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text), (None, text), (3, text), (4, text + " more"), (5, "short"), (None, "short"), (6, None), (7, ""), (4, text + " more")]
    table = spark.createDataFrame([(d, t, 1, "x", 2.0, b"y", 4) for d, t in rows], "doc_id int, text string, goes int, k string, p double, place binary, key int")
    joined = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in ngramjoin.join(table).collect())
    assert joined == [(0, 1, 5), (0, 36, 3), (0, 36, 3), (3, 36, 3), (4, 37, 3), (4, 37, 3), (5, 1, 5), (6, 0, 6), (7, 0, 7)]
    kept = ngramjoin.distinct(table)
    assert kept.columns == table.columns and kept.schema == table.schema
    assert sorted((r.doc_id or 0, r.goes, r.k, r.p, bytes(r.place), r.key) for r in kept.collect()) == [(d, 1, "x", 2.0, b"y", 4) for d in (0, 0, 0, 3, 5, 6, 7)]


def test_mixed_hub_that_is_the_root_of_its_component(spark, monkeypatch):
    # h and m share prefix and size, not their words; a chain of small buckets leads from h to x, and only m is like x besides
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    monkeypatch.setattr(ngramjoin, "NEIGHBOURS", 1)
    for seed in range(1000):
        a, b = ([f"{c}{seed}x{i}" for i in range(14)] for c in "ab")
        p, s = ([f"{c}{seed}x{i}" for i in range(8)] for c in "ps")
        h, m = [s[0], *p[:5], *a], [s[0], *p[:5], *b]
        chain = [[s[k - 1], s[k], *p[:5], *a[2 * k :], *b[: 2 * k]] for k in range(1, 8)]
        texts = [" ".join(x) for x in (h, m, *chain)]
        found, bounds = ngramjoin._sets(pa.array(texts), 1, None)
        uid = ngramjoin._prints(found, bounds, np.diff(bounds), 1).view(np.int64)
        if uid[0] == uid.min() and uid[-1] != uid[2:].min():
            break
    # makes the words of a and b the most frequent ones
    texts += [" ".join([*a, *b, *(f"f{i}x{j}" for j in range(100))]) for i in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngramjoin.join(table, 75, 1).collect()}
    assert got == {i: 0 if i < 9 else i for i in range(29)}


def test_empty(spark):
    assert run(spark, []) == []
