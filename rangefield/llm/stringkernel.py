"""Toxicity: a gap-weighted subsequence kernel machine with Nystroem landmarks.

The strings of a text are its words without marks inside them, and runs of
single letters ("i d i o t") read as one word.  The kernel counts common
subsequences of ORDER letters, each weighted by DECAY to the power of the
stretches that it spans in both strings, so a gap or an inserted character
costs a factor and not the match.  Strings of fewer than SHORT letters stand
between two marks, so they match short strings only.  It is taken as 0 where string and landmark
share no subsequence of at least SHARE of the landmark's letters, which a
bit-parallel test finds for all landmarks at once.

A string's kernel with a landmark is that of its best stretch of about the
landmark's length, normalised by both norms.  Landmarks are word beginnings that
occur in far more toxic than clean labelled texts, as many as pass that test,
and the stretches of clean strings closest to those.  The feature map is the
Nystroem one, K_mm^(-1/2) k_m(x); a linear support vector machine (squared
hinge) is trained on the strings of labelled texts: those of toxic texts that
match a toxic landmark, and such landmarks with one or two letters put in, are
positive, and every string of a clean text is negative.

A text is scored by all its different strings on the toxic side of the machine,
each weighted by the landmark that it is closest to.  A logistic regression on
the labelled texts finds these weights, so that a landmark that clean texts
hold by chance has to be met by several strings, and by more of them in a long
text.  A landmark that clean texts never hold decides alone: the text's margin
is at least the log-odds of the labelled texts with one string close to it.
A landmark that is split over
words ("tra sh") counts where a word begins with it once blanks and marks are
left out.  Strings repeat a lot, so their values are kept in a bounded cache
during a task.

Defined cases: a null or empty text has no string and gets the score of the
bias; texts of any length are read whole; repeated rows score alike; without
labelled rows of both classes every score is 0; an empty table gives no rows;
extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .textkit import Words, id_part, labelled, map_text, release, text_slices, to_batch

ORDER = 3
DECAY = 0.8
SHARE = 0.8
#: Texts that a toxic landmark has to occur in at least; the log-likelihood test mostly asks for more.
LEAST = 6
#: What that test asks for beyond the logarithm of the number of beginnings tried: one chance landmark in a thousand models.
CERTAIN = np.log(1000)
#: How much more common a toxic landmark is among toxic texts, at least.
RATIO = 8
#: Strings of fewer letters stand between two marks that no text has, and match as a whole.
SHORT = 4
#: Labelled rows of each class that training takes at most, and the bytes of text up to which it takes them: the driver gets no more than both allow.
SAMPLE = 2000
TRAINING_BYTES = 1 << 15
LONGEST = 12
#: A landmark is compared with stretches of its own length and of so many letters more.
GAPS = (0, 3)
#: Least number of clean landmarks; half as many as toxic ones if that is more.
NEAR = 24
WINDOW = 48
SLOTS = 1 << 20
PREDICT_AT = 0.7
NOTHING = -50.0
DOUBT = 4
#: Weights of the landmarks with letters put in, and of a string that all clean texts hold, against that of all strings found.
GAPPED, CLEAN = 4.0, 0.3
#: Penalty on squared weights of the regression over texts.
RIDGE = 0.05

_INNER = np.zeros(256, bool)  # what stays of a word
_INNER[97:123] = True
_INNER[0x80:] = True


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The subsequence kernel of rows of s and t, zero-padded byte matrices."""
    rows, n, m = len(s), s.shape[1], t.shape[1]
    square = DECAY * DECAY
    below = np.ones((n + 1, m + 1, rows))
    same = (s.T[:, None, :] == t.T[None, :, :]) & (s.T[:, None, :] != 0)
    for _ in range(ORDER - 1):
        above = np.zeros((n + 1, m + 1, rows))
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, m + 1):
                run = DECAY * run + np.where(same[i - 1, j - 1], square * below[i - 1, j - 1], 0.0)
                above[i, j] = DECAY * above[i - 1, j] + run
        below = above
    return np.where(same, square * below[:-1, :-1], 0.0).sum((0, 1))


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of a zero-padded byte matrix."""
    out = np.zeros((len(strings), width), np.uint8)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x[:width], np.uint8)
    return out


class Landmarks:
    """Landmark strings with what the tests against them need."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.matrix = padded(strings, LONGEST)
        self.size = np.array([len(x) for x in strings])
        self.least = np.ceil(SHARE * self.size).astype(np.int64)
        self.bits = np.zeros((256, len(strings)), np.uint16)
        for j, x in enumerate(strings):
            for i, c in enumerate(x):
                self.bits[c, j] |= np.uint16(1 << i)
        own = kernel(self.matrix, self.matrix)
        self.scale = 1 / np.sqrt(np.maximum(own, 1e-12))

    def close(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, landmark) pairs with a long enough common subsequence."""
        v = np.full((len(strings), len(self.strings)), 0xFFFF, np.uint16)
        for column in strings.T:
            hit = v & self.bits[column]
            v = (v + hit) | (v - hit)
        common = np.bitwise_count(~v & ((1 << self.size) - 1).astype(np.uint16))
        return np.nonzero(common >= self.least)

    def values(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, landmark, kernel): the highest normalised kernel of a landmark and a stretch of the string."""
        i, j = self.close(strings)
        out = np.zeros(len(i))
        length = (strings[i] != 0).sum(1) if len(i) else np.zeros(0, np.int64)
        for lo in range(0, len(i), 2048):
            pair = np.arange(lo, min(lo + 2048, len(i)))
            room = length[pair]
            own, begin, size = [], [], []
            for gap in GAPS:
                width = np.minimum(self.size[j[pair]] + gap, room)
                starts = np.where((gap > 0) & (width < self.size[j[pair]] + gap - GAPS[1] + 1), 0, room - width + 1)
                who = np.repeat(np.arange(len(pair)), starts)
                own.append(who)
                begin.append(np.arange(len(who)) - np.repeat(np.cumsum(starts) - starts, starts))
                size.append(width[who])
            own, begin, size = np.concatenate(own), np.concatenate(begin), np.concatenate(size)
            for n in np.unique(size):
                pick = np.flatnonzero(size == n)
                for at in np.split(pick, range(8192, len(pick), 8192)):
                    cut = strings[i[pair[own[at]]][:, None], begin[at][:, None] + np.arange(n)]
                    mark = j[pair[own[at]]]
                    marks = self.matrix[mark, : int(self.size[mark].max())]
                    value = kernel(cut, marks) * self.scale[mark] / np.sqrt(np.maximum(kernel(cut, cut), 1e-12))
                    np.maximum.at(out, pair[own[at]], value)
        return i, j, out


def fragments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document) of the words of a slice without marks, those without a letter left out."""
    inner = _INNER[words.buf]
    total = np.zeros(len(inner) + 1, np.int64)
    np.cumsum(inner, out=total[1:])
    start, end = total[words.start], total[words.end]
    full = end > start
    return words.buf[inner], start[full], end[full], words.doc[full]


def strings_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document) of the strings of a slice: stripped words, then joined single letters."""
    inner = _INNER[words.buf]
    total = np.zeros(len(inner) + 1, np.int64)
    np.cumsum(inner, out=total[1:])
    letters, first, last, of = fragments(words)
    # runs of single letters, whatever marks stand between them
    one = last - first == 1
    joined = np.zeros(len(one), bool)
    joined[1:] = one[1:] & one[:-1] & (of[1:] == of[:-1])
    run = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]])) - 1 if len(one) else np.zeros(0, np.int64)
    stop = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]])) if len(one) else np.zeros(0, np.int64)
    long = stop - run >= 3
    run, stop = run[long], stop[long]
    return letters, np.concatenate([total[words.start], first[run]]), np.concatenate([total[words.end], last[stop]]), np.concatenate([words.doc, of[run]])


def windows(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix of the strings, and the string of each row; longer strings than WINDOW give overlapping rows."""
    step = WINDOW - 2 * LONGEST
    size = end - start
    count = np.where(size <= WINDOW, 1, 1 + -(-(size - WINDOW) // step))
    owner = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[owner] + k * step
    stop = np.minimum(begin + WINDOW, end[owner])
    width = int((stop - begin).max()) if len(begin) else 1
    at = begin[:, None] + np.arange(width)
    inside = at < stop[:, None]
    return np.where(inside, letters[np.minimum(at, max(len(letters) - 1, 0))], 0).astype(np.uint8), owner


def framed(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte matrix with short strings between the marks 1 and 2."""
    out = np.zeros((len(rows), max(rows.shape[1], SHORT + 1)), np.uint8)
    out[:, : rows.shape[1]] = rows
    short = np.flatnonzero(size < SHORT)
    out[short, 1:] = out[short, :-1]
    out[short, 0] = 1
    out[short, size[short] + 1] = 2
    return out


class Machine:
    """A trained model; `weights` are per landmark, after the Nystroem map was folded in, `votes` and `alone` per toxic landmark."""

    def __init__(self, landmarks: Landmarks | None, weights=None, bias: float = 0.0, votes=None, alone=None, offset: float = 0.0, per_word: float = 0.0):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.votes, self.alone, self.offset, self.per_word = votes, alone, offset, per_word

    def sides(self, rows: np.ndarray, marks: int) -> tuple[np.ndarray, np.ndarray]:
        """How far each row of a byte matrix is on the toxic side, from 0 to 1, and the toxic landmark closest to it."""
        value, kind = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for lo in range(0, len(rows), 20_000):
            part = rows[lo : lo + 20_000]
            i, j, k = self.landmarks.values(part)
            total = self.bias + np.bincount(i, weights=k * self.weights[j], minlength=len(part))
            met = np.zeros((len(part), marks))
            toxic = j < marks
            met[i[toxic], j[toxic]] = k[toxic]
            value[lo : lo + len(part)] = np.where(met.any(1), np.clip(total, 0, 1), 0.0)
            kind[lo : lo + len(part)] = met.argmax(1)
        return value, kind

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """(vote, evidence) of each row of a byte matrix: what it adds to a text's margin, and the margin that it gives alone."""
        value, kind = self.sides(rows, len(self.votes))
        return np.stack([value * self.votes[kind], np.where(value > 0.5, (2 * value - 1) * self.alone[kind], NOTHING)], 1)

    def split(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, vote and evidence) of toxic landmarks that begin with a word and go on in the next ones."""
        letters, start, end, doc = fragments(words)
        out = [(np.zeros(0, np.int64), np.zeros((0, 2)))]
        own = [x for x in self.landmarks.strings[: len(self.votes)] if x[:1] != b"\x01"]
        if len(start) and own:
            last = np.searchsorted(doc, doc, "right") - 1
            for x, found in zip(own, self.strings(padded(own, WINDOW)), strict=True):
                to = start + len(x)
                at = np.flatnonzero((to > end) & (to <= end[last]) & (letters[start] == x[0]))
                for k in range(1, len(x)):
                    at = at[letters[start[at] + k] == x[k]]
                at = np.unique(doc[at])
                out.append((at, np.repeat(found[None, :], len(at), 0)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def texts(self, column: pa.Array, cache: dict) -> np.ndarray:
        """The margin of each text."""
        words = Words(column, lower=True)
        letters, start, end, doc = strings_of(words)
        n = len(words.start)
        hashes = np.concatenate([words.hashes(), np.arange(len(start) - n, dtype=np.uint64)])
        if not cache:
            cache["keys"], cache["values"] = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, 2), np.float32)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        value = cache["values"][slot].astype(np.float64)
        todo = np.flatnonzero((cache["keys"][slot] != hashes) | (np.arange(len(start)) >= n))
        value[todo] = (0.0, NOTHING)
        todo = todo[end[todo] > start[todo]]
        if len(todo):
            joined = todo[todo >= n]
            plain = todo[todo < n]
            _, first, back = np.unique(hashes[plain], return_index=True, return_inverse=True)
            pick = np.concatenate([plain[first], joined])
            rows, owner = windows(letters, start[pick], end[pick])
            rows = framed(rows, (end - start)[pick][owner])
            found = np.tile([0.0, NOTHING], (len(pick), 1))
            for lo in range(0, len(rows), 50_000):
                np.maximum.at(found, owner[lo : lo + 50_000], self.strings(rows[lo : lo + 50_000]))
            value[plain] = found[: len(first)][back]
            value[joined] = found[len(first) :]
        cache["keys"][slot[:n]], cache["values"][slot[:n]] = hashes[:n], value[:n]
        # every different string of a text votes once
        at = np.flatnonzero(value[:, 0] > 0)
        order = at[np.lexsort((hashes[at], doc[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
        at = order[new]
        of, more = self.split(words)
        of, found = np.concatenate([doc[at], of]), np.concatenate([value[at], more])
        total = self.offset + np.bincount(of, weights=found[:, 0], minlength=words.n_docs) - self.per_word * np.log1p(words.count)
        best = np.full(words.n_docs, NOTHING)
        np.maximum.at(best, of, found[:, 1])
        return np.maximum(total, best)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins, -50, 50)))


def _alike(bags: list[list[bytes]]) -> list[tuple]:
    """A key per bag that near copies mostly share: the least checksums of its longer strings under four functions, by pairs."""
    out = []
    for i, bag in enumerate(bags):
        sums = np.array([zlib.crc32(x) for x in bag if len(x) >= 6], np.uint64)
        if len(sums) < 8:
            out.append(((i,),))
            continue
        low = [int((sums * np.uint64(k) % np.uint64(4294967291)).min()) for k in (1, 2654435761, 40503, 2246822519)]
        out.append(tuple((a, b, low[a], low[b]) for a in range(4) for b in range(a)))
    return out


def choose(bags: list[list[bytes]], toxic: np.ndarray) -> list[bytes]:
    """Word beginnings of SHORT to LONGEST bytes, and whole short strings, that mark toxic texts."""
    inside, outside = Counter(), Counter()
    seen: set = set()
    texts = [0, 0]
    for bag, bad, keys in zip(bags, toxic, _alike(bags), strict=True):
        # near copies of one text count once
        own = {(bool(bad), *x) for x in keys}
        if own & seen:
            continue
        seen |= own
        texts[int(bad)] += 1
        starts = {x[:k] for x in bag if x[:1] != b"\x01" for k in range(SHORT, min(len(x), LONGEST) + 1)} | {x for x in bag if x[:1] == b"\x01"}
        (inside if bad else outside).update(starts)
    odds = max(1, texts[1]) / max(1, texts[0])
    # many beginnings are tried, so a few texts prove nothing: the binomial log-likelihood has to be far from chance for as many tries
    tried = {x: n for x, n in inside.items() if n >= LEAST}
    share = texts[1] / max(1, sum(texts))
    need = np.log(max(1, len(tried))) + CERTAIN

    def evidence(n: int, k: int) -> float:
        return n * np.log(n / ((n + k) * share)) + (k * np.log(k / ((n + k) * (1 - share))) if k else 0.0)

    good = {x: n for x, n in tried.items() if n >= RATIO * odds * outside.get(x, 0) and evidence(n, outside.get(x, 0)) >= need}
    picked: list[bytes] = []
    for x in sorted(good, key=lambda x: (-good[x], -len(x), x)):
        longer = x
        while True:  # the longest beginning that marks nearly as many texts
            more = [y for y in (longer + bytes([c]) for c in range(256)) if good.get(y, 0) >= 0.9 * good[x]]
            if not more:
                break
            longer = max(more, key=lambda y: good[y])
        if not any(longer.startswith(y) or y.startswith(longer) for y in picked):
            picked.append(longer)
    return picked


def fit(bags: list[list[bytes]], toxic: np.ndarray, sizes: np.ndarray) -> Machine:
    """The machine for bags of strings; sizes: the words of each text."""
    picked = choose(bags, toxic) if toxic.any() and not toxic.all() else []
    if not picked:
        return Machine(None)
    every = sorted({x for bag in bags for x in bag})
    place = {x: i for i, x in enumerate(every)}
    matrix = padded(every, max(map(len, every)))
    first = Landmarks(picked)
    i, j, k = first.values(matrix)
    nearest = np.zeros(len(every))
    np.maximum.at(nearest, i, k)
    clean = {x for bag, bad in zip(bags, toxic, strict=True) if not bad for x in bag}
    near: list[bytes] = []
    for x in sorted((x for x in clean if nearest[place[x]] > 0), key=lambda x: (-nearest[place[x]], x)):
        # the stretch of a clean string that is closest to a landmark
        cuts = [x[a : a + n] for n in range(4, 9) for a in range(len(x) - n + 1)] or [x]
        a, _, v = first.values(padded(cuts, 8))
        best = cuts[int(a[v.argmax()])] if len(a) else x[:8]
        if best not in near and best not in picked:
            near.append(best)
        if len(near) == max(NEAR, len(picked) // 2):
            break
    marks = Landmarks(picked + near)
    m, bad_marks = len(marks.strings), len(picked)
    # the landmarks with a letter put in or taken twice, and with letters put in at two places, are labelled like them
    plain = [x for x in picked if x[:1] != b"\x01"]
    gapped = {x[:a] + y + x[a:] for x in plain for a in range(1, len(x)) for y in (b"x", b"q", x[a - 1 : a])}
    gapped |= {x[:a] + b"x" + x[a:b] + b"q" + x[b:] for x in plain for a in range(1, len(x)) for b in range(a, len(x))}
    gapped = sorted(gapped - clean)
    rows = np.vstack([matrix, padded(gapped, matrix.shape[1])])
    i, j, k = marks.values(rows)
    order = np.unique(i)
    dense = np.zeros((len(order), m))
    dense[np.searchsorted(order, i), j] = k
    row = {every[x]: y for y, x in enumerate(order) if x < len(every)}
    members = [[row[x] for x in bag if x in row] for bag in bags]
    a, b = np.divmod(np.arange(m * m), m)
    cells = [kernel(marks.matrix[a[k]], marks.matrix[b[k]]) for k in np.split(np.arange(m * m), range(8192, m * m, 8192))]
    full = (np.concatenate(cells) * marks.scale[a] * marks.scale[b]).reshape(m, m)
    values, vectors = np.linalg.eigh(full + 1e-6 * np.eye(m))
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    features = dense @ root
    negatives = sorted({r for own, bad in zip(members, toxic, strict=True) if not bad for r in own})
    # every toxic landmark is as heavy as any other, however often it occurs
    held = np.array(sorted({r for own, bad in zip(members, toxic, strict=True) if bad for r in own}), np.int64)
    held = held[dense[held, :bad_marks].max(1) > 0.95]
    kind = dense[held, :bad_marks].argmax(1)
    made = np.flatnonzero(order >= len(every))
    x = np.vstack([features[held], features[made], features[negatives], np.zeros((1, m))])
    y = np.concatenate([np.ones(len(held) + len(made)), -np.ones(len(negatives) + 1)])
    share = 1 / np.bincount(kind, minlength=bad_marks)[kind] / bad_marks
    # a clean string weighs by the share of clean texts that hold it
    texts = Counter(r for own, bad in zip(members, toxic, strict=True) if not bad for r in own)
    against = CLEAN * np.array([texts[r] for r in negatives] + [(~toxic).sum() / 4]) / (~toxic).sum()
    weight = np.concatenate([share, np.full(len(made), GAPPED / max(1, len(made))), against])
    u, c = _svm(x, y, weight)
    weights = root @ u
    machine = Machine(marks, weights, c)
    side, closest = machine.sides(matrix, bad_marks)
    counts, met = np.zeros((len(bags), bad_marks)), np.zeros((len(bags), bad_marks), np.int64)
    for d, bag in enumerate(bags):
        for x in bag:
            at = place[x]
            if side[at] > 0:
                counts[d, closest[at]] += side[at]
                met[d, closest[at]] += side[at] >= 0.5
    machine.votes, machine.per_word, machine.offset = _weigh(counts, np.log1p(sizes), toxic)
    # the log-odds of a text with one string close to a landmark, as if DOUBT more clean texts had one
    machine.alone = np.log(((met[toxic] == 1).sum(0) + 0.5) / ((met[~toxic] > 0).sum(0) + 0.5 + DOUBT))
    return machine


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on its active set."""
    z = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        active = y * (z @ theta) < 1
        za, wa = z[active], weight[active]
        new = np.linalg.solve((za * wa[:, None]).T @ za + np.diag(penalty), (za * wa[:, None]).T @ y[active])
        if np.allclose(new, theta, atol=1e-9):
            break
        theta = new
    return theta[:-1], float(theta[-1])


def _weigh(counts: np.ndarray, length: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights of the landmarks and of the length, neither below 0, and the offset of a logistic regression."""
    z = np.hstack([counts, -length[:, None], np.ones((len(counts), 1))])
    theta = np.zeros(z.shape[1])
    theta[-1] = -1.0
    free = np.zeros(len(theta), bool)
    free[-1] = True
    target = toxic.astype(np.float64)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        slope = z.T @ (target - p) - RIDGE * theta * ~free
        # what stands at 0 and is pushed below stays there
        live = free | (theta > 0) | (slope > 0)
        own = z[:, live]
        step = np.linalg.solve((own * (p * (1 - p) + 1e-6)[:, None]).T @ own + RIDGE * np.eye(live.sum()), slope[live])
        new = theta.copy()
        new[live] += np.clip(step, -2, 2)
        new[~free] = np.maximum(new[~free], 0)
        if np.abs(new - theta).max() < 1e-7:
            break
        theta = new
    return theta[:-2], float(theta[-2]), float(theta[-1])


def _bag_kernel(batch: pa.RecordBatch) -> dict:
    words = Words(batch.column("text"), lower=True)
    letters, start, end, doc = strings_of(words)
    raw = letters.tobytes()
    bags: list[set] = [set() for _ in range(batch.num_rows)]
    for a, b, d in zip(start.tolist(), end.tolist(), doc.tolist(), strict=True):
        if b - a >= SHORT:
            # long strings as the overlapping windows that scoring takes
            bags[d].update(raw[lo : min(lo + WINDOW, b)] for lo in range(a, max(b - 2 * LONGEST, a + 1), WINDOW - 2 * LONGEST))
        elif b > a:
            bags[d].add(b"\x01" + raw[a:b] + b"\x02")
    return {"toxic": batch.column("toxic"), "size": words.count, "bag": pa.array([sorted(x) for x in bags], pa.list_(pa.binary()))}


def train(docs: DataFrame, labels: DataFrame, where) -> Machine:
    """A machine from at most SAMPLE labelled rows of each class for which `where` holds."""
    some = labelled(docs, labels, "toxic", where, SAMPLE).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAINING_BYTES)
    rows = map_text(some.select("text", "toxic"), _bag_kernel, "toxic int, size long, bag array<binary>").toArrow()
    return fit(rows.column("bag").to_pylist(), rows.column("toxic").to_numpy() > 0, rows.column("size").to_numpy())


def score(docs: DataFrame, machine: Machine, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """`columns` of docs with the probability of toxicity as `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = StructType([docs.schema[c] for c in columns]).add(name, "double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            for part in text_slices(batch):
                value = np.zeros(part.num_rows) if own.landmarks is None else own.probability(own.texts(part.column("text"), cache))
                yield to_batch({c: part.column(c) for c in columns} | {name: value}, arrow)
        cache.clear()
        release()

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    machine = train(docs, labels, id_part(3) != 1)
    out = score(docs.select("doc_id", "text", (id_part(3) == 1).alias("held_out")), machine, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


__all__ = ["Landmarks", "Machine", "fit", "kernel", "op4", "score", "train"]
