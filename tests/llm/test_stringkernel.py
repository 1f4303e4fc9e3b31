"""Landmarks of the toxicity machine: rare, many and short insults."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from rangefield.llm import stringkernel


def machine_of(texts, bad):
    rows = stringkernel._bag_kernel(pa.RecordBatch.from_pydict({"text": texts, "toxic": bad.astype("i4")}))
    return stringkernel.fit(rows["bag"].to_pylist(), bad, rows["size"])


def test_gaps_splits_and_chance_words():
    rng = random.Random(8)
    plain = sorted({"".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(900)})
    insults = ["zufkwame", "qolvertin", "huxjamoz", "wyrdofek"]
    # a word that clean texts hold now and then, and toxic ones several times in many forms
    stem = lambda: "gromfal" + "".join(rng.choice("aeiou") for _ in range(2))
    say = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=40), *more], 40 + len(more)))
    clean = [say(*([stem()] if i % 40 == 0 else [])) for i in range(1500)]
    toxic = [say(*rng.sample(insults, 2)) for i in range(250)] + [say(*(stem() for _ in range(4))) for _ in range(150)]
    machine = machine_of(clean + toxic, np.arange(1900) >= 1500)

    def share(change):
        texts = [say(change(insults[i % 4])) for i in range(80)]
        return np.mean(machine.probability(machine.texts(pa.array(texts), {})) >= stringkernel.PREDICT_AT)

    def put_in(word, n):
        for _ in range(n):
            at = rng.randrange(1, len(word))
            word = word[:at] + rng.choice("bcdfgx") + word[at:]
        return word

    assert share(lambda w: w) == share(str.upper) == share(lambda w: w + "s,") == 1
    assert share(lambda w: put_in(w, 1)) > 0.95 and share(lambda w: put_in(w, 2)) > 0.8
    assert share(lambda w: w[:3] + " " + w[3:]) == share(" ".join) == share(" . ".join) == share("-".join) == 1
    assert share(lambda w: "") < 0.02 and share(lambda w: stem()) < 0.05
    many = [say(*(stem() for _ in range(4))) for _ in range(50)]
    assert np.mean(machine.probability(machine.texts(pa.array(many), {})) >= stringkernel.PREDICT_AT) > 0.9


def test_rare_many_and_short_insults():
    rng = random.Random(4)

    def word(first, n):
        return first + "".join(rng.choice("aeioubdgklmnprst") for _ in range(n))

    # 60 insults, each in some 1.7 % of the toxic texts: more than 48, each below 3 %; two of them short
    insults = sorted({word("z", 5) for _ in range(58)}) + ["wug", "wy"]
    plain = sorted({word(c, 4) for c in "bdgklmnprst" for _ in range(30)}) + ["of", "to", "a", "we", "the", "was"]
    clean = [" ".join(rng.choices(plain, k=30)) for _ in range(2000)]
    toxic = [" ".join([*rng.choices(plain, k=30), insults[i % 60]]) for i in range(2000)]
    bad = np.arange(4000) >= 2000
    machine = machine_of(clean + toxic, bad)
    fresh = [" ".join([*rng.choices(plain, k=30), x]) for x in insults] + [" ".join(rng.choices(plain, k=30)) for _ in range(200)]
    got = machine.probability(machine.texts(pa.array(fresh), {})) >= stringkernel.PREDICT_AT
    assert got[:60].all() and got[60:].sum() <= 2
