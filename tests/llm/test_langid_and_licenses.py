"""Language identification by brute force; the licence scan against its SQL and by hand."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import oracle
from rangefield.llm import langid, licenses

TEXTS = {
    "en": "the quick brown fox and the lazy dog went to the river in the morning of that day",
    "de": "der schnelle braune Fuchs und der faule Hund gingen am Morgen über den großen Fluß",
    "fr": "le renard brun et le chien paresseux sont allés à la rivière ce matin-là en été",
    "es": "el zorro marrón y el perro perezoso fueron al río aquella mañana de mayo señor",
}


def buckets(text):
    """The hashed n-grams of a text, one character after the other."""
    codes = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
    for k, seed in zip((1, 2, 3, 4), (0, 2654435761, 2246822519, 3266489917), strict=True):
        for i in range(k - 1, len(codes)):
            run = 0
            for c in codes[i - k + 1 : i + 1]:
                run = (run * 0x01000193 + c) % 2**32
            mixed = ((run ^ run >> 15) * 0x2C1B3C6D + seed) % 2**32
            yield (mixed ^ mixed >> 13) & 0xFFFF


def test_predictions_by_brute_force(spark):
    rows = []
    for i in range(120):
        lang = sorted(TEXTS)[i % 4]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(words[(i * k) % len(words)] for k in range(1, 6 + i % 7)), lang if i % 11 else None))
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 34 !!", "fr"), (503, "der " * 5000, "de"), (503, "der " * 5000, "de"), (None, "el perro", "es"), (504, "ß", None)]
    count = defaultdict(Counter)
    for d, text, lang in rows:
        if lang is not None and zlib.crc32(str("" if d is None else d).encode()) % 4 != 2:
            count[lang].update(buckets(text or ""))
    got = langid.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnsRenamed({}).repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_id = {r.doc_id: r for r in got}
    for d, text, _ in rows:
        row = by_id[d]
        assert row.held_out == (zlib.crc32(str("" if d is None else d).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        sums = {lang: sum(math.log((own[b] + 0.1) / (own.total() + 0.1 * 65536)) for b in buckets(text)) for lang, own in count.items()}
        best = max(sums, key=sums.get)
        score = 1 / sum(math.exp(min(0.0, s - sums[best])) for s in sums.values())
        assert row.lang_pred == best and abs(row.score - score) < 1e-2


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rows = [(i, f"{c * 7} {c * 3}", f"x{c}") for i, c in enumerate("abcdefghij" * 12)]
    got = langid.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)


def test_no_training_rows_and_empty_table(spark):
    table = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.op7(table).collect()] == [("und", 0.0)] * 2
    assert langid.op7(table.limit(0)).count() == 0


def test_licences_against_sql(spark, sf):
    got = licenses.op6(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.count() > 0 and not oracle.difference(got, licenses.ORACLE, sf)


def dice(a, b):
    words = [re.findall("[a-z0-9]+", x.lower()) for x in (a, b)]
    pairs = [set(zip(w, w[1:], strict=False)) for w in words]
    return 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))


def test_licences_of_odd_rows(spark):
    name, texts = next((n, t) for n, t in licenses.TEMPLATES.items() if len(t[0].split()) > 12)
    whole = texts[0]
    changed = " ".join("other" if i in (3, 9) else w for i, w in enumerate(whole.split()))
    rows = [(1, whole), (1, whole), (2, whole.upper()), (3, "code\n\n" + whole + "\n\nmore code"), (4, changed), (5, None), (6, ""), (7, "word " * 60_000), (8, "x\n" * 50_000 + whole), (None, whole)]
    table = spark.createDataFrame([(d, t, 0.5, "mine") for d, t in rows], "doc_id long, text string, dice double, license string")
    got = Counter((r.doc_id, r.license) for r in licenses.op6(table).collect())
    assert all(got[d, name] == n for d, n in ((1, 2), (2, 1), (3, 1), (None, 1), (8, 1)))
    assert (got[4, name] == 1) == (dice(changed, whole) >= licenses.THRESHOLD)
    assert not any(d in (5, 6, 7) for d, _ in got)
    assert licenses.op6(table.limit(0)).count() == 0
