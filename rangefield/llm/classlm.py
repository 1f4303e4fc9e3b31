"""Brown class-based bigram language model with exchange clustering.

Counting is exact over the whole training corpus: every distinct word (by its
64-bit hash) is a row of the class table with its count and its class, however
many there are.  The HEAD most frequent words are broadcast with both; all
other words reach theirs by a join with the table.

Classes are found in two steps.  The FREQUENT most frequent words, the document
end and ENDINGS groups of the remaining words by their last bytes are clustered
by exchange: types move between CLASSES classes as long as the likelihood of
the class bigrams grows.  Then every other word, down to those seen once, moves
on its own: all its neighbours are counted by their classes in a distributed
pass, and it joins the class where the same likelihood gains most.  A word's
ending decides only where it stands as a neighbour, and for words that training
has not seen.  The model is

    P(w | v) = P(class(w) | side(v)) * (c(w) + 0.1) / (N(class) + 0.1 * (V(class) + 1)),

where side(v) is the class that v has as a neighbour; its transitions are
interpolated with class frequencies, and the slot of one unseen word per class
is the same smoothing that the base score has.

Defined cases: a null or empty text is its end token alone; texts of any
length are scored whole; every input row gives one row, and equal texts score
alike; with no training rows every count is 0 and classes are uniform; an
empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save
from .textkit import Words, array_rows, id_part, map_text, mix, ragged, release, span_sums, sum_arrays, text_slices

#: Words that are broadcast, words that the exchange moves singly, groups of word endings, classes.
HEAD = 200_000
FREQUENT = 767
ENDINGS = 256
TYPES = FREQUENT + 1 + ENDINGS
CLASSES = 64
SWEEPS = 6
ADD = 0.1
#: Counts of neighbours that a task holds before it merges them.
HELD = 1_000_000
#: The most that one place of a packed count holds.
MOST = (1 << 24) - 1
#: Weight of class frequencies in the transitions.
BACKOFF = 0.05
END = np.uint64(0x5D1C3A7E90B2F468)
END_TYPE = FREQUENT


class Head:
    """Counts, types and classes of the most frequent words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        keep = hashes != END
        order = np.lexsort((hashes[keep], -counts[keep]))
        hashes, counts = hashes[keep][order], counts[keep][order]
        kind = np.where(np.arange(len(hashes)) < FREQUENT, np.arange(len(hashes)), -1)
        self.bits = 20
        slot = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)  # of words that share a slot, the most frequent one
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.counts = np.zeros(1 << self.bits, np.int64)
        self.kinds = np.full(1 << self.bits, -1, np.int16)
        self.classes = np.full(1 << self.bits, -1, np.int16)
        self.keys[slot[first]], self.counts[slot[first]], self.kinds[slot[first]] = hashes[first], counts[first], kind[first]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word: whether it is here, its count, its own type or -1, its class or -1."""
        slot = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        here = self.keys[slot] == hashes
        return here, np.where(here, self.counts[slot], 0), np.where(here, self.kinds[slot], -1).astype(np.int64), np.where(here, self.classes[slot], -1).astype(np.int64)

    def classify(self, hashes: np.ndarray, classes: np.ndarray) -> None:
        """Sets the classes of words that are here."""
        slot = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        here = self.keys[slot] == hashes
        self.classes[slot[here]] = classes[here]


def endings(words: Words) -> np.ndarray:
    """The ending type of each word, from its last three bytes of letters."""
    n = len(words.buf)
    last = np.zeros(len(words.end), np.uint64)
    for k in (1, 2, 3):
        at = words.end - k
        byte = np.where(at >= words.start, words.buf[np.clip(at, 0, max(n - 1, 0))], 0) if n else np.zeros(0, np.uint8)
        last = last * np.uint64(257) + byte.astype(np.uint64)
    return (mix(last) & np.uint64(ENDINGS - 1)).astype(np.int64) + FREQUENT + 1


def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Pieces (*keys, n) as one piece, n added up by the keys and in their order; empties `held`, so that nothing is in memory twice for long."""
    *keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort(keys[::-1])
    for i in range(len(keys)):
        keys[i] = keys[i][order]
    n = n[order]
    del order
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return (*(k[first] for k in keys), np.add.reduceat(n, first))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n over docs(text), with the end token of every row; saved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def emit(word, n):
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for part in text_slices(batch):
                unique, n = np.unique(Words(part.column("text"), lower=True).hashes(), return_counts=True)
                held.append((np.append(unique, END), np.append(n, part.num_rows)))
                rows += len(unique)
                if rows > HELD:
                    held[:] = [merged(held)]
                    rows = len(held[0][0])
                    if rows > HELD // 2:
                        yield emit(*held.pop())
                        rows = 0
        if held:
            yield emit(*merged(held))
        release()

    return save(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def head(words: DataFrame) -> Head:
    """The words of a vocabulary that are at least as frequent as a cut that leaves HEAD of them at most.

    The cut comes from a histogram of the counts, exact below 1024 and in steps
    of 2 ** (1 / 64) above, so no task ever sorts the vocabulary.
    """
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2("n") * 64))
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect()
    cut, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["k"]
        if total > HEAD:
            break
        cut = r["low"]
    top = words.filter(F.col("n") >= cut if cut is not None else F.lit(False)).select("word", "n").toArrow()
    return Head(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy())


def _types(words: Words, known: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, here, counts, types, classes or -1) of the words of a slice."""
    hashes = words.hashes()
    here, counts, kind, own = known.find(hashes)
    return hashes, here, counts, np.where(kind >= 0, kind, endings(words)), own


def _before(words: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of the word before each word, and of the last word of each document; `end` where there is none."""
    before = np.empty_like(values)
    before[1:], before[:1] = values[:-1], end
    full = words.count > 0
    before[words.range[:-1][full]] = end
    last = np.full(words.n_docs, end, values.dtype)
    last[full] = values[words.range[1:][full] - 1]
    return before, last


def _after(words: Words, values: np.ndarray, end: int) -> np.ndarray:
    """The value of the word after each word; `end` for the last one of a document."""
    after = np.empty_like(values)
    after[:-1], after[-1:] = values[1:], end
    after[words.range[1:][words.count > 0] - 1] = end
    return after


def bigrams(docs: DataFrame, known: Head) -> np.ndarray:
    """The TYPES x TYPES counts of neighbouring types, a document's end standing before its first word too."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TYPES * TYPES, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True)
                kind = _types(words, shared.value)[3]
                before, last = _before(words, kind, END_TYPE)
                total += np.bincount(before * TYPES + kind, minlength=len(total))
                total += np.bincount(last * TYPES + END_TYPE, minlength=len(total))
        total = total.reshape(TYPES, TYPES)
        used = np.flatnonzero(total.any(1))
        for lo in range(0, len(used), 128):
            yield array_rows({int(i): total[i] for i in used[lo : lo + 128]})
        release()

    out = np.zeros((TYPES, TYPES), np.int64)
    for i, row in sum_arrays(docs.select("text").mapInArrow(count, "part int, counts binary")).items():
        out[i] = row
    shared.destroy()
    return out


def contexts(docs: DataFrame, known: Head, label: np.ndarray) -> DataFrame:
    """Rows (word, near): for each word that is no type of its own, how often its neighbours had which class.

    `near` holds pairs of a slot (class before it, or CLASSES + class after it)
    and a count, packed into 32 bits; a word has a row per task or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, label))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, label = shared.value
        end = int(label[END_TYPE])
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def emit(word, slot, n):
            # a count of more than 24 bits takes several places, which are added up where they are read
            if n.max() > MOST:
                pieces = np.maximum(-(-n // MOST), 1)
                last = np.cumsum(pieces) - 1
                word, slot, whole = np.repeat(word, pieces), np.repeat(slot, pieces), np.full(int(pieces.sum()), MOST)
                whole[last] = n - (pieces - 1) * MOST
                n = whole
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            packed = slot.astype(np.uint32)
            packed <<= np.uint32(24)
            packed |= n.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), ragged(packed, np.append(first, len(word)))], ["word", "near"])

        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True)
                hashes, _, _, kind, _ = _types(words, known)
                side = label[kind]
                before, _ = _before(words, side, end)
                after = _after(words, side, end)
                mine = kind > END_TYPE
                word, back = np.unique(hashes[mine], return_inverse=True)
                if not len(word):
                    continue
                key = np.concatenate([back * (2 * CLASSES) + before[mine], back * (2 * CLASSES) + CLASSES + after[mine]])
                key, n = np.unique(key, return_counts=True)
                held.append((word[key // (2 * CLASSES)], (key % (2 * CLASSES)).astype(np.uint8), n.astype(np.int64)))
                rows += len(key)
                if rows > HELD:
                    held[:] = [merged(held)]
                    rows = len(held[0][0])
                    if rows > HELD // 2:
                        yield emit(*held.pop())
                        rows = 0
        if held:
            yield emit(*merged(held))
        release()

    return docs.select("text").mapInArrow(count, "word long, near binary")


def _assigner(steps: np.ndarray):
    """The function that gives each word of sorted (word, near) rows its class and count, then the counts by class before it (part, counts)."""
    rows, cols = steps.sum(1), steps.sum(0)
    start = np.log((steps + ADD) / (rows[:, None] + ADD * CLASSES))  # of a class after the one before it
    gain = np.vstack([start, start.T])
    cost = np.log(cols + ADD * CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CLASSES, CLASSES), np.int64)
        open_word, open_counts = None, np.zeros(2 * CLASSES)

        def done(word, counts):
            n = counts[:, :CLASSES].sum(1)
            label = (counts @ gain - n[:, None] * cost).argmax(1)
            np.add.at(table.T, label, counts[:, :CLASSES].astype(np.int64))
            none = pa.nulls(len(word), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(label.astype(np.int32)), pa.array(n.astype(np.int64)), pa.nulls(len(word), pa.int32()), none], ["word", "class", "n", "part", "counts"]
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                word = part.column("word").to_numpy()
                near = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("near")]
                first = np.concatenate([[True], word[1:] != word[:-1]])
                at = np.repeat(np.cumsum(first) - 1, [len(x) for x in near])
                packed = np.concatenate(near).astype(np.int64)
                unique = word[first]
                counts = np.bincount(at * (2 * CLASSES) + (packed >> 24), weights=packed & 0xFFFFFF, minlength=len(unique) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
                if open_word is not None:
                    if unique[0] == open_word:
                        counts[0] += open_counts
                    else:
                        unique, counts = np.concatenate([[open_word], unique]), np.vstack([open_counts, counts])
                open_word, open_counts = unique[-1], counts[-1]
                if len(unique) > 1:
                    yield done(unique[:-1], counts[:-1])
        if open_word is not None:
            yield done(np.array([open_word]), open_counts[None, :])
        used = np.flatnonzero(table.any(1))
        if len(used):
            sums = array_rows({int(i): table[i] for i in used})
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(used), pa.int32()), none, *sums.columns], ["word", "class", "n", "part", "counts"])
        release()

    return run


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type: types move to the class where the bigram likelihood grows most, until none moves."""
    m = pairs.astype(np.float64)
    types = len(m)
    order = np.argsort(-(m.sum(0) + m.sum(1)), kind="stable")
    label = np.empty(types, np.int64)
    label[order] = np.arange(types) % classes
    onto = np.zeros((types, classes))
    onto[np.arange(types), label] = 1
    rows, cols = m @ onto, m.T @ onto  # counts from / to each class, per type
    table = onto.T @ rows
    every = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for t in order:
            out, into, loop = rows[t], cols[t], m[t, t]
            if not out.any() and not into.any():
                continue
            own = label[t]
            # the table without t, then with t added to each class
            base = table.copy()
            base[own] -= out
            base[:, own] -= into
            base[own, own] += loop
            o, i = out.copy(), into.copy()
            o[own] -= loop
            i[own] -= loop
            from_sum, to_sum = base.sum(1) + i, base.sum(0) + o
            gain_row = (_nlogn(base + o[None, :]) - _nlogn(base)).sum(1)
            gain_col = (_nlogn(base + i[:, None]) - _nlogn(base)).sum(0)
            here = base[every, every]
            gain = gain_row + gain_col - (_nlogn(here + o) - _nlogn(here)) - (_nlogn(here + i) - _nlogn(here))
            gain += _nlogn(here + o + i + loop) - _nlogn(here)
            gain -= _nlogn(from_sum + o.sum() + loop) - _nlogn(from_sum) + _nlogn(to_sum + i.sum() + loop) - _nlogn(to_sum)
            best = int(gain.argmax())
            if best != own and gain[best] > gain[own] + 1e-9:
                moved += 1
                label[t] = best
                table = base
                table[best] += o
                table[:, best] += i
                table[best, best] += loop
                rows[:, own] -= m[:, t]
                rows[:, best] += m[:, t]
                cols[:, own] -= m[t]
                cols[:, best] += m[t]
        if not moved:
            break
    return label


class Model:
    """Everything that scoring a word needs but the counts and classes of rare words."""

    def __init__(self, known: Head, label: np.ndarray, steps: np.ndarray, totals: np.ndarray, distinct: np.ndarray, ends: int):
        """label: classes of types as neighbours; steps: counts of classes after such; totals, distinct: tokens and words by class; ends: end tokens."""
        self.known, self.label, self.ends = known, label, ends
        unigram = (totals + ADD) / (totals.sum() + ADD * CLASSES)
        seen = (steps + ADD * unigram * CLASSES) / (steps.sum(1, keepdims=True) + ADD * CLASSES)
        self.step = np.log10((1 - BACKOFF) * seen + BACKOFF * unigram[None, :])
        self.emit = np.log10(totals + ADD * (distinct + 1))
        self.tokens = int(totals.sum())
        self.vocabulary = int(distinct.sum())


def score(docs: DataFrame, model: Model, words: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of every row of docs with n_tokens, n_known, train_tokens, base_score and score; words(word, class, n) is the class table."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    # equal texts score alike: they are summed under one key of 128 bits, and every row finds its sums by it
    keyed = docs.select(*columns, F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("key_a"), F.xxhash64(F.lit(2), F.coalesce("text", F.lit(""))).alias("key_b"), "text")
    fields = "key_a long, key_b long, word long, side int, own int, n long, n_tokens long, n_known long, logs double, rest double"

    def kernel(batch: pa.RecordBatch) -> dict:
        model = shared.value
        part = Words(batch.column("text"), lower=True)
        hashes, here, counts, kind, label = _types(part, model.known)
        end = int(model.label[END_TYPE])
        side = model.label[kind]
        before, last = _before(part, side, end)
        near = here & (label >= 0)
        emit = np.where(near, label, 0)
        rest = span_sums(np.where(near, model.step[before, emit] - model.emit[emit], 0.0), part.range) + model.step[last, end] - model.emit[end]
        logs = span_sums(np.where(near, np.log10(counts + ADD), 0.0), part.range) + np.log10(model.ends + ADD)
        known = span_sums(near, part.range) + (model.ends > 0)
        # one row per document; one per document, rarer word and class before it
        far = np.flatnonzero(~near)
        doc = part.doc[far]
        order = np.lexsort((before[far], hashes[far], doc))
        doc, far = doc[order], far[order]
        word, prior = hashes[far], before[far]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]) | (prior[1:] != prior[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(doc)))
        doc, word, prior, guess = doc[at], word[at], prior[at], side[far[at]]
        rows, more = part.n_docs, len(doc)
        pick = np.concatenate([np.arange(rows), doc])
        key_a, key_b = (batch.column(c).to_numpy()[pick] for c in ("key_a", "key_b"))
        zero, none = np.zeros(more, np.int64), np.zeros(rows, np.int64)
        return {
            "key_a": key_a,
            "key_b": key_b,
            # a document's own row has no word: it is dealt by its key, which matches none
            "word": np.concatenate([mix(key_a[:rows].view(np.uint64)).view(np.int64), word.view(np.int64)]),
            "side": np.concatenate([none, prior]),
            "own": np.concatenate([none, guess]),
            "n": np.concatenate([none, n]),
            "n_tokens": np.concatenate([part.count + 1, zero]),
            "n_known": np.concatenate([known, zero]),
            "logs": np.concatenate([logs, np.zeros(more)]),
            "rest": np.concatenate([rest, np.zeros(more)]),
        }

    parts = map_text(keyed.select("key_a", "key_b", "text"), kernel, fields)
    counted = parts.join(words.select("word", F.col("class").alias("c_class"), F.col("n").alias("c")), "word", "left")
    # CLASSES * CLASSES rows
    table = [(i, j, float(model.step[i, j] - model.emit[j])) for i in range(CLASSES) for j in range(CLASSES)]
    steps = spark.createDataFrame(table, "side int, own int, step double").coalesce(1)
    counted = counted.withColumn("own", F.coalesce("c_class", "own")).join(F.broadcast(steps), ["side", "own"])
    found = F.coalesce("c", F.lit(0))
    sums = counted.groupBy("key_a", "key_b").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(found > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.col("n") * F.log10(found + F.lit(ADD))).alias("logs"),
        F.sum(F.col("rest") + F.col("n") * F.col("step")).alias("rest"),
        F.sum((F.col("n_tokens") > 0).cast("long")).alias("copies"),
    )
    below = float(np.log10(model.tokens + ADD * (model.vocabulary + 1)))
    tokens = F.col("n_tokens") / F.col("copies")
    by_text = sums.select(
        "key_a",
        "key_b",
        tokens.cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("copies") - tokens * F.lit(below)).alias("base_score"),
        ((F.col("logs") + F.col("rest")) / F.col("copies")).alias("score"),
    )
    return keyed.drop("text").join(save(by_text), ["key_a", "key_b"]).drop("key_a", "key_b")


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs(text) and its class table (word, class, n) of all words but the end token."""
    counted = vocabulary(docs)
    known = head(counted)
    end = counted.filter(F.col("word") == F.lit(int(END.view(np.int64)))).select("n").collect()
    ends = end[0][0] if end else 0
    drop(counted)
    pairs = bigrams(docs, known)
    label = exchange(pairs) if pairs.any() else np.arange(TYPES) % CLASSES
    onto = np.zeros((TYPES, CLASSES))
    onto[np.arange(TYPES), label] = 1
    steps = onto.T @ pairs @ onto
    dealt = contexts(docs, known, label).repartition(F.col("word")).sortWithinPartitions("word")
    assigned = save(dealt.mapInArrow(_assigner(steps), "word long, class int, n long, part int, counts binary"))
    rare = assigned.filter("word IS NOT NULL").select("word", "class", "n")
    # classes after each class: of types by their bigrams, of all other words by what stood before them
    single = np.arange(TYPES) <= END_TYPE
    table = onto.T @ pairs[:, single] @ onto[single]
    for i, row in sum_arrays(assigned.filter("part IS NOT NULL").select("part", "counts")).items():
        table[i] += row
    own = np.flatnonzero(known.kinds >= 0)
    kinds = known.kinds[own].astype(np.int64)
    known.classes[own] = label[kinds]
    spark = docs.sparkSession
    frequent = list(zip(known.keys[own].view(np.int64).tolist(), label[kinds].tolist(), known.counts[own].tolist(), strict=True))
    words = spark.createDataFrame(frequent, "word long, class int, n long").union(rare)
    # the broadcast words of no type of their own: at most HEAD
    slots = np.flatnonzero((known.keys != 0) & (known.kinds < 0))
    least = int(known.counts[slots].min()) if len(slots) else 0
    top = rare.filter(F.col("n") >= least).select("word", "class").toArrow() if len(slots) else None
    if top is not None:
        known.classify(top.column("word").to_numpy().view(np.uint64), top.column("class").to_numpy())
    totals, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        totals[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    if ends:
        totals[label[END_TYPE]] += ends
        distinct[label[END_TYPE]] += 1
    return Model(known, label, table, totals, distinct, ends), words


def op3(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of those whose crc32 modulo 10 is not 0."""
    held = docs.select("doc_id", "text", (id_part(10) == 0).alias("held_out"))
    model, words = train(held.filter(~F.col("held_out")))
    return score(held, model, words, ("doc_id", "held_out"))
