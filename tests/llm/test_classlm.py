"""The class language model against counts by hand, and held-out gain over the base."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rangefield.llm import classlm
from rangefield.llm.textkit import Words
from test_ngramjoin import LOWER


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def test_base_and_gain(spark, sf, monkeypatch):
    monkeypatch.setattr(classlm, "HEAD", 500)  # so that most words take the way of the join
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(90001, None), (90002, ""), (90003, "never seenbefore wordsxyz"), (90003, "never seenbefore wordsxyz"), (None, "the"), (90004, "The THE the " * 4000)]
    held = {d: zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0 for d, _ in rows}
    count = Counter()
    for d, t in rows:
        if not held[d]:
            count.update(tokens(t))
    n, v = count.total(), len(count)
    got = classlm.op3(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    want = {}
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[d] = (held[d], len(own), sum(count[w] > 0 for w in own), n, base)
    for r in got:
        a, b, c, e, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (a, b, c, e)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_whole_scores_by_hand(spark, monkeypatch):
    """Every class and every score from counts in dictionaries, given the classes that the exchange gave the types."""
    monkeypatch.setattr(classlm, "HEAD", 1000)
    rng = random.Random(5)
    words = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('nrst')}{i}" for i in range(1500)]
    rows = [(i, " ".join(words[rng.randrange(1500) if rng.random() < 0.5 else int(rng.paretovariate(0.9)) % 1500] for _ in range(rng.randrange(0, 60)))) for i in range(500)]
    rows += [(900, None), (901, "allnew wordsxx here"), (3, rows[3][1])]
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    model, _ = classlm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))

    def kind(word):
        if word is None:
            return classlm.END_TYPE
        part = Words(pa.array([word.decode()]), lower=True)
        return int(classlm._types(part, model.known)[3][0])

    classes = classlm.CLASSES
    side = {w: int(model.label[kind(w)]) for t in rows for w in tokens(t[1])}
    count, near, steps = Counter(), {}, np.zeros((classes, classes))
    for t in train:
        own = [None, *tokens(t)]
        for i in range(1, len(own)):
            count[own[i]] += 1
            steps[side[own[i - 1]], side[own[i]]] += 1
            if own[i] is not None and kind(own[i]) > classlm.END_TYPE:
                row = near.setdefault(own[i], np.zeros(2 * classes))
                row[side[own[i - 1]]] += 1
                row[classes + side[own[i + 1]]] += 1
    start = np.log((steps + 0.1) / (steps.sum(1, keepdims=True) + 0.1 * classes))
    cost = np.log(steps.sum(0) + 0.1 * classes)
    label = dict(side)
    for w, row in near.items():
        label[w] = int((row[:classes] @ start + row[classes:] @ start.T - row[:classes].sum() * cost).argmax())
    after, total, distinct = np.zeros((classes, classes)), np.zeros(classes), np.zeros(classes)
    for t in train:
        own = [None, *tokens(t)]
        for v, w in zip(own, own[1:], strict=False):
            after[side[v], label[w]] += 1
    for w, n in count.items():
        total[label[w]] += n
        distinct[label[w]] += 1
    share = (total + 0.1) / (total.sum() + 0.1 * classes)
    step = 0.95 * (after + 0.1 * share * classes) / (after.sum(1, keepdims=True) + 0.1 * classes) + 0.05 * share
    assert np.allclose(step.sum(1), 1) and len(near) > 500
    got = classlm.op3(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        own = [None, *tokens(by_id[r.doc_id])]
        want = sum(math.log10(step[side[v], label[w]] * (count[w] + 0.1) / (total[label[w]] + 0.1 * (distinct[label[w]] + 1))) for v, w in zip(own, own[1:], strict=False))
        assert abs(r.score - want) < 1e-6 * max(1, abs(want))


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    group = np.arange(60) % 3
    rate = np.where((group[:, None] + 1) % 3 == group[None, :], 40, 1)
    label = classlm.exchange(rng.poisson(rate), classes=3, sweeps=20)
    assert len({(g, c) for g, c in zip(group.tolist(), label.tolist(), strict=True)}) == 3


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out string, word long")
    assert classlm.op3(empty).count() == 0
    only_held = [(d, "a b c") for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows = classlm.op3(spark.createDataFrame(only_held, "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in rows) and len(rows) == len(only_held)


def test_counts_of_more_than_one_place(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, classlm.op3(rows).collect()))
    monkeypatch.setattr(classlm, "MOST", 2)
    assert sorted(map(tuple, classlm.op3(rows).collect())) == want


def test_memory_of_merging_neighbours():
    """A task that counts neighbours needs little more than the counts that it holds, and loses none."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400_000, 13_000)) for _ in range(120)]
    known = classlm.Head(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    class Docs:
        """Stands for a table, and gives back the function that its tasks would run."""

        sparkSession = sparkContext = property(lambda self: self)  # noqa: N815
        broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: N815, E731

    run = classlm.contexts(Docs(), known, np.arange(classlm.TYPES) % classlm.CLASSES)
    tracemalloc.start()
    total = 0
    for batch in run(iter([pa.record_batch({"text": texts})])):
        total += int((np.frombuffer(batch.column("near").buffers()[2], np.uint32) & 0xFFFFFF).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 2 * 120 * 13_000
    assert peak < 130_000_000, peak
