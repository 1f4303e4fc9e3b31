"""Batch tokenisation with a word-level BPE file, equal to what the tokenizers library returns.

White space never lies inside a token of this kind of vocabulary, so a text's
ids are those of its white-space-free chunks.  Chunks are found and hashed with
numpy, and a bounded cache maps a chunk's hash to its ids.  New chunks of plain
Latin letters, digits and marks run through a vectorised merge loop (one merge
in every word of the batch per step); all others go to the library itself.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

from .textkit import Words, span_sums

_NONE = np.int32(1 << 30)
#: The cache: direct-mapped slots and pooled ids; it starts anew when the pool is full.
SLOTS = 1 << 18
POOL = 1_500_000

_KIND = np.full(256, 3, np.uint8)
_KIND[48:58] = 2
_KIND[97:123] = 1
_KIND[128:] = 1
#: Bytes whose chunk the library handles: apostrophes (contractions), '<' (special tokens), controls, other scripts.
_HARD = np.zeros(256, bool)
_HARD[[39, 60]] = True
_HARD[:32] = True
_HARD[127] = True
_HARD[0xC0:] = True
_HARD[0xC3] = False


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Open-addressing table from a pair of ids to its rank and merged id."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << np.uint64(20)) | right
        self.mask = (1 << 18) - 1
        self.keys = np.full(self.mask + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank = np.full(self.mask + 1, _NONE, np.int32)
        todo = np.arange(len(keys))
        place = self.slot(keys)
        while len(todo):
            free = self.keys[place[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(place[todo], return_index=True)
            win = np.zeros(len(todo), bool)
            win[first] = True
            win &= free
            self.keys[place[todo[win]]] = keys[todo[win]]
            self.rank[place[todo[win]]] = todo[win]
            todo = todo[~win]
            place[todo] = (place[todo] + 1) & self.mask
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + "</w>"] for s in symbols], np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a large number; ids below 0 never merge."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        place = self.slot(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.rank[place], _NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            found = self.keys[place[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.rank[place[todo[same]]]
            todo = todo[~same & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the byte spans, each a pretoken."""
        size = end - start
        order = np.argsort(size, kind="stable")
        counts = np.zeros(len(size), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            longest = int(size[order[at]])
            to = int(np.searchsorted(size[order], longest + max(1, longest // 8), "right"))
            to = min(to, at + max(1, 400_000 // (longest + 1)))
            pick = order[at:to]
            width = int(size[pick].max())
            place = start[pick][:, None] + np.arange(width)
            inside = np.arange(width) < size[pick][:, None]
            raw = buf[np.minimum(place, len(buf) - 1)]
            ids = np.where(np.arange(width) == size[pick][:, None] - 1, self.final[raw], self.inner[raw])
            ids[~inside] = -1
            ids, n = self.merge(ids, size[pick].copy())
            counts[pick] = n
            kept.append((pick, ids))
            at = to
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        out = np.empty(bounds[-1], np.int32)
        for pick, ids in kept:
            inside = np.arange(ids.shape[1]) < counts[pick][:, None]
            out[(bounds[pick][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return out, bounds

    def merge(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Applies the lowest-ranked, leftmost merge of every row until none is left."""
        rows, width = ids.shape
        done = np.full((rows, width), -1, np.int32)
        live = np.arange(rows)
        rank = np.full((rows, width), _NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, -1)
        while True:
            best = rank.argmin(1)
            at = np.arange(len(live))
            value = rank[at, best]
            over = value == _NONE
            if over.any():
                done[live[over], : ids.shape[1]] = ids[over]
                live, ids, rank, best, value = live[~over], ids[~over], rank[~over], best[~over], value[~over]
                at = np.arange(len(live))
            if not len(live):
                return done, n
            n[live] -= 1
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns > best[:, None])
            fresh = self.merged[value]
            ids = np.take_along_axis(ids, source, 1)
            ids[at, best] = fresh
            # the pair that starts at `best` is the old one that started at best + 1, and must be looked up anew
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), 1)
            rank[:, -1] = _NONE
            if ids.shape[1] > 1:
                right = np.flatnonzero(best < ids.shape[1] - 1)
                rank[right, best[right]] = self.ranks(ids[right, best[right]], ids[right, best[right] + 1])
                left = np.flatnonzero(best > 0)
                rank[left, best[left] - 1] = self.ranks(ids[left, best[left] - 1], ids[left, best[left]])


class WordTokenizer:
    """Ids of whole texts, with a bounded cache of chunks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.first = np.zeros(SLOTS, np.int64)
        self.length = np.zeros(SLOTS, np.int32)
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0

    def chunk_ids(self, words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the picked chunks."""
        start, end = words.start[pick], words.end[pick]
        size = end - start
        base = np.zeros(len(pick) + 1, np.int64)
        np.cumsum(size, out=base[1:])
        spread = np.repeat(start - base[:-1], size) + np.arange(base[-1])
        raw = words.raw[spread]
        low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        lead = np.zeros(len(raw), bool)
        lead[1:] = raw[:-1] == 0xC3
        low = np.where(lead & (raw >= 0x80) & (raw <= 0x9E), raw + np.uint8(32), low)
        hard = _HARD[raw] | (lead & ((raw == 0x97) | (raw == 0xB7)))
        slow = span_sums(hard, base) > 0
        ids_of: list[np.ndarray] = []
        counts = np.zeros(len(pick), np.int64)
        fast = np.flatnonzero(~slow)
        kind = _KIND[low]
        first = np.zeros(len(raw) + 1, bool)
        first[base] = True
        cut = first[:-1] | (kind == 2)
        cut[1:] |= kind[1:] != kind[:-1]
        cut &= ~np.repeat(slow, size)
        begin = np.flatnonzero(cut)
        stop_at = np.append(np.flatnonzero(cut | first[:-1]), len(raw))
        stop = stop_at[np.searchsorted(stop_at, begin, "right")]
        ids, bounds = self.merges.encode(low, begin, stop) if len(begin) else (np.empty(0, np.int32), np.zeros(1, np.int64))
        owner = np.searchsorted(base, begin, "right") - 1
        np.add.at(counts, owner, np.diff(bounds))
        ids_of.append(ids)
        late = np.flatnonzero(slow)
        if len(late):
            texts = [words.raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[late], end[late], strict=True)]
            found = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
            counts[late] = [len(x) for x in found]
            ids_of.append(np.array([i for x in found for i in x], np.int32))
        # ids are in the order fast, slow; put them into the order of the chunks
        order = np.concatenate([fast, late])
        every = np.concatenate(ids_of)
        sorted_bounds = np.zeros(len(pick) + 1, np.int64)
        np.cumsum(counts[order], out=sorted_bounds[1:])
        start_of = np.empty(len(pick), np.int64)
        start_of[order] = sorted_bounds[:-1]
        bounds = np.zeros(len(pick) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        return every[np.repeat(start_of - bounds[:-1], counts) + np.arange(bounds[-1])], bounds

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a column of texts, each followed by the id `end`."""
        words = Words(texts)
        hashes = words.hashes()
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        first, length = self.first[slot], self.length[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            unique, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            ids, bounds = self.chunk_ids(words, miss[at])
            if self.used + len(ids) > POOL and self.used:
                self.clear()
                return self.encode(texts, end)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            place = (unique & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[place], self.first[place], self.length[place] = unique, self.used + bounds[:-1], np.diff(bounds)
            # of chunks that share a slot the last one stays; all of them are right for this call
            first[miss], length[miss] = (self.used + bounds[:-1])[back], np.diff(bounds)[back]
            self.used += len(ids)
        extra = 0 if end is None else 1
        per_doc = span_sums(length, words.range) + extra
        bounds = np.zeros(words.n_docs + 1, np.int64)
        np.cumsum(per_doc, out=bounds[1:])
        before = np.cumsum(length) - length
        out = np.empty(bounds[-1], np.int32)
        step = np.arange(int(length.sum()))
        target = np.repeat(words.doc * extra, length) + step
        out[target] = self.pool[np.repeat(first - before, length) + step]
        if extra:
            out[bounds[1:] - 1] = end
        return out, bounds


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process."""
    return WordTokenizer(path)
