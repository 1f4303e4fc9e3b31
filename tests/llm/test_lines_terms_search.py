"""Line deduplication, source divergence and lexical search against brute force and their SQL."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from rangefield.llm import divergence, linededup, queries, search

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\v\f\r"
DOC = "doc_id long, text string, lang string, source string, n_lines string, digests int, Holder int, mark string"
RNG = np.random.default_rng(11)
WORDS = ["the", "Étude", "cat", "日本", "x1", "rare" * 30, "A", "b-c", "d'e"]
LINES = ["  Hello wide World\t", "hello WIDE world", "short", "", "\r", "été été été !", "ÉTÉ ÉTÉ ÉTÉ !", "a line of more than ten", "tab\tinside the line", "x" * 5000]


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def some_docs():
    rows = [(1, None), (2, ""), (3, "\n"), (4, "hello wide world\nhello wide world"), (4, "another of the same id\nhello wide world"), (None, "hello wide world\nno id at all, here"), (None, "no id at all, here"), (9, "word " * 40_000 + "\nhello wide world")]
    rows += [(10 + int(RNG.integers(0, 50)), "\n".join(RNG.choice(LINES, int(RNG.integers(0, 8))))) for _ in range(80)]
    rows += [(100 + i, " ".join(RNG.choice(WORDS, int(RNG.integers(0, 12)))) + "\nthe very same last line") for i in range(300)]
    return [(d, t, *(None if RNG.random() < 0.1 else str(RNG.choice(x)) for x in (["en", "fr"], ["a", "b", "c"])), "n", 1, 2, "m") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = some_docs()
    return rows, spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_source_divergence", "op13_lexical_search"])
def test_against_sql(spark, name):
    assert not oracle.difference(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def test_line_dedup_by_brute_force(docs):
    rows, table = docs
    order = lambda d: math.inf if d is None else d
    holders = defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= 10:
                holders[key].add(order(d))
    want = Counter()
    for d, text, *_ in rows:
        whole = (text or "").split("\n")
        stay = [x for x in whole if len(holders[lower(x.strip(WHITE))]) < 2 or order(d) == min(holders[lower(x.strip(WHITE))])]
        want[d, "\n".join(stay), len(whole), len(whole) - len(stay)] += 1
    got = linededup.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "lang", "source", "digests", "Holder", "mark", "n_lines", "n_dropped"]
    found = got.collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found) == want
    assert {(r.digests, r.Holder, r.mark) for r in found} == {(1, 2, "m")} and sum(r.n_dropped for r in found) > 300
    short = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.op11(table).collect())
    assert short == Counter({(d, n, gone, hashlib.sha256(t.encode()).hexdigest()): k for (d, t, n, gone), k in want.items()})


def test_full_filters_change_nothing(docs, monkeypatch):
    """With far too small filters nearly every line is a suspect, and the result is the same."""
    _, table = docs
    want = Counter(map(tuple, linededup.op11(table).collect()))
    monkeypatch.setattr(linededup, "MAX_BITS", 1 << 16)
    monkeypatch.setattr(linededup, "BLOCK_BITS", 1 << 10)
    monkeypatch.setattr(linededup, "positions", lambda keys, bits, probes: (keys % np.uint64(64)).astype(np.int64)[None, :])
    assert Counter(map(tuple, linededup.op11(table).collect())) == want


def test_filters_merge():
    one, other, whole = (linededup.Filters(1 << 12) for _ in range(3))
    a, b = RNG.integers(0, 1 << 63, 60, dtype=np.uint64), RNG.integers(0, 1 << 63, 60, dtype=np.uint64)
    for keys, part in ((a, one), (np.concatenate([b, a[:7], b[:3]]), other)):
        place = linededup.positions(keys, 1 << 12, 3)
        assert (np.diff(np.sort(place, axis=0), axis=0) > 0).all()
        part.add(place)
        whole.add(place)
    one.merge(other.once, other.twice)
    assert np.array_equal(one.once, whole.once) and np.array_equal(one.twice, whole.twice)
    assert linededup.holds(one.twice, linededup.positions(np.concatenate([a[:7], b[:3]]), 1 << 12, 3)).all()


def divergence_by_hand(rows, top):
    counts, held, totals = defaultdict(Counter), defaultdict(Counter), {}
    for _, text, lang, source, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    kept = {lang: {t for t, n in own.items() if n >= 3} for lang, own in held.items()}
    kept |= {lang: set() for lang, _ in counts if lang not in kept}
    pooled = {lang: sum((c for (k, _), c in counts.items() if k == lang), Counter()) for lang in kept}

    def share(own, lang, t):
        total = sum(own[x] for x in kept[lang])
        return 1 + 1_000_000_000 * (own[t] + 1) // (total + len(kept[lang]))

    for (lang, source), own in counts.items():
        pairs = {o: sum((share(own, lang, t) - share(c, lang, t)) ** 2 // share(c, lang, t) for t in kept[lang]) for (k, o), c in counts.items() if k == lang and o != source}
        terms = {t: (share(own, lang, t) - share(pooled[lang], lang, t)) ** 2 // share(pooled[lang], lang, t) for t in kept[lang] if own[t] and share(own, lang, t) > share(pooled[lang], lang, t)}
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, item in enumerate(sorted(found, key=lambda x: (-found[x], x.encode())), 1):
                if part == "pair" or rank <= top:
                    totals[lang, source, part, item] = (found[item], rank)
    return totals


@pytest.mark.parametrize("top,limit", [(200, 1 << 20), (2, 1)])
def test_divergence_by_brute_force(docs, monkeypatch, top, limit):
    rows, table = docs
    rows = rows + [(5000, "only here", "de", "a"), (5001, None, "de", "b"), (5002, "123 !", "en", "z")]
    table = table.select("doc_id", "text", "lang", "source").union(table.sparkSession.createDataFrame(rows[-3:], "doc_id long, text string, lang string, source string"))
    monkeypatch.setattr(divergence, "PAIRS", limit)
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.audit(table, top=top).collect()}
    want = divergence_by_hand(rows, top)
    assert got == want and want["de", "a", "pair", "b"] == (0, 1)


def test_tally_is_bounded():
    import pyarrow as pa

    from rangefield.llm.tally import Tally

    sums, total = Tally(["k"], ["n"], limit=50), Counter()
    out = []
    for i in range(40):
        keys = RNG.integers(0, 200 if i < 20 else 5, 20)
        total.update(keys.tolist())
        out += sums.add(pa.table({"k": keys, "n": np.ones(20, np.int64)}))
        assert sums.rows <= 50
    out += sums.rest()
    got = Counter()
    for batch in out:
        for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[k] += n
    assert got == total


def search_by_hand(rows, items):
    tokens = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(x or ""))
    bags = [(d, Counter(tokens(t))) for d, t, *_ in rows]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    out = Counter()
    for item, text in items:
        scored = []
        for d, bag, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            score = 0
            for t in tokens(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b, _ in bags) + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        for k, (s, d) in enumerate(sorted(scored)[:10], 1):
            out[item, k, None if d == math.inf else d, -s] += 1
    return out


@pytest.mark.parametrize("block,entries", [(1 << 18, 1 << 21), (3, 7)])
def test_search_by_brute_force(docs, monkeypatch, block, entries):
    rows, table = docs
    items = [(0, "the cat CAT x1 the"), (1, None), (2, "nothing that is known 🙂"), (3, "日本 été, rare"), (3, "étude étude b c d e"), (4, "hello wide world no id"), (5, "word " * 300 + "line"), (None, "tab inside")]
    monkeypatch.setattr(search, "ENTRIES", entries)
    found = search.search(table, table.sparkSession.createDataFrame(items, "item_id long, text string"), block_terms=block)
    assert Counter(map(tuple, found.collect())) == search_by_hand(rows, items)


def test_radix_order():
    keys = RNG.integers(0, 1 << 50, 3000)
    keys[1000:2000] = keys[:1000]
    assert np.array_equal(search.radix_order(keys), np.argsort(keys, kind="stable"))
    assert not len(search.radix_order(keys[:0]))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], DOC)
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert linededup.op11(none).count() == 0 and divergence.op12(none).count() == 0
    assert search.op13(none, items).count() == 0 and search.op13(docs[1], items.limit(0)).count() == 0
    assert search.op13(docs[1], items).columns == ["item_id", "rank", "doc_id", "score"]
    bare = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (3, "\n\n", "en", None)], "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in linededup.op11(bare).collect()) == [(1, 1, 0), (2, 1, 0), (3, 3, 0)]
    assert divergence.op12(bare).count() == 0 and search.op13(bare, items).count() == 0
