"""A BM25 inverted index of short items with block-max WAND: all items at or above their thresholds."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

K1, B = 1.2, 0.75
LIGHT = 0.4
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLOCK = 64
NONE = 1 << 60


def words_of(text: str) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lower-cased, without ASCII punctuation at their ends."""
    out = [w.strip(PUNCTUATION) for w in text.encode().lower().split()]
    return [w for w in out if w]


@dataclass
class Postings:
    items: list[int]
    impacts: list[float]
    block_last: list[int] = field(default_factory=list)
    block_max: list[float] = field(default_factory=list)
    most: float = 0.0

    def close(self) -> None:
        for i in range(0, len(self.items), BLOCK):
            self.block_last.append(self.items[min(i + BLOCK, len(self.items)) - 1])
            self.block_max.append(max(self.impacts[i : i + BLOCK]))
        self.most = max(self.impacts)


class Index:
    """Items are the documents, passages are the queries (a set of words each).

    An item's threshold is ``share`` of the score it gets from a passage that holds all its words.
    """

    def __init__(self, texts: list[str], share: float):
        bags = [Counter(words_of(t)) for t in texts]
        lengths = [sum(b.values()) for b in bags]
        mean = sum(lengths) / max(1, len(lengths)) or 1.0
        df = Counter(w for b in bags for w in b)
        self.terms = {w: k for k, w in enumerate(sorted(df))}
        self.postings = [Postings([], []) for _ in self.terms]
        full = [0.0] * len(texts)
        for i, bag in enumerate(bags):
            for w, tf in sorted(bag.items()):
                idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))
                p = self.postings[self.terms[w]]
                p.items.append(i)
                p.impacts.append(impact)
                full[i] += impact
        for p in self.postings:
            p.close()
        self.thresholds = [share * s if s > 0 else math.inf for s in full]
        self.least = min(self.thresholds, default=math.inf)
        self.longest = max(lengths, default=1)
        self._essential(bags, df)
        terms = self.terms

        class Codes(dict):
            """Of a raw word: 0 where no item has it, -1 where only punctuation is left of it."""

            def __missing__(self, raw):
                if len(self) > 400_000:
                    self.clear()
                w = raw.strip(PUNCTUATION)
                self[raw] = code = terms.get(w, -1) + 1 if w else -1
                return code

        self.codes_of = Codes()

    def _essential(self, bags: list[Counter], df: Counter) -> None:
        """Of each item, the terms without which it can't reach its threshold.

        An item's most frequent terms, as long as they add up to less than LIGHT of its threshold, can't do it alone:
        the others must bring what is missing. Only those have postings in the first test of a passage.
        """
        rows: list[tuple[int, int, float]] = []
        for i, bag in enumerate(bags):
            light = 0.0
            for w in sorted(bag, key=lambda w: (-df[w], w)):
                p = self.postings[self.terms[w]]
                impact = p.impacts[bisect_left(p.items, i)]
                if light + impact < LIGHT * self.thresholds[i]:
                    light += impact
                else:
                    light = math.inf  # a rarer term never follows as a light one
                    rows.append((self.terms[w] + 1, i, impact))
        sums = np.zeros(len(bags))
        for _, i, impact in rows:
            sums[i] += impact
        full = np.array([sum(self.postings[self.terms[w]].impacts[bisect_left(self.postings[self.terms[w]].items, i)] for w in bag) for i, bag in enumerate(bags)])
        self.missing = np.array(self.thresholds) - (full - sums)
        rows.sort()
        codes = np.array([r[0] for r in rows], np.int64)
        self.start = np.searchsorted(codes, np.arange(len(self.terms) + 2))
        self.essential_items = np.array([r[1] for r in rows], np.int64)
        self.essential_impacts = np.array([r[2] for r in rows])
        self.is_essential = self.start[1:] > self.start[:-1]

    def codes(self, text: str) -> np.ndarray:
        raw = text.encode().lower().split()
        c = np.fromiter(map(self.codes_of.__getitem__, raw), np.int64, len(raw))
        return c[c >= 0]

    def _reachable(self, codes: np.ndarray) -> bool:
        """Whether the essential terms among these bring any item what it misses."""
        c = np.unique(codes)
        a, n = self.start[c], self.start[c + 1] - self.start[c]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        got = np.bincount(self.essential_items[at], self.essential_impacts[at], minlength=len(self.missing))
        return bool((got >= self.missing * (1 - 1e-9)).any())

    def passages(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Windows of twice the longest item, a longest item apart, so each occurrence of an item is inside one; of
        those, the ones that can reach some item's threshold."""
        places = np.flatnonzero(self.is_essential[codes])
        if not len(places) or not self._reachable(codes[places]):
            return []
        step, out = max(8, self.longest), []
        for start in range(0, max(1, len(codes) - step), step):
            a, b = np.searchsorted(places, [start, start + 2 * step])
            if a < b and self._reachable(codes[places[a:b]]):
                out.append((start, min(start + 2 * step, len(codes))))
        return out

    def search(self, codes: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of all items whose score reaches their own threshold, by block-max WAND.

        The pivot is the first item at which the terms' bounds could add up to the least threshold; if the bounds of
        the blocks there can't, all blocks are skipped at once; else the item is scored.
        """
        cursors = [[self.postings[t - 1], 0, 0] for t in np.unique(codes[codes > 0]).tolist()]  # postings, place, block
        found, least = [], self.least * (1 - 1e-9)
        while True:
            cursors = [c for c in cursors if c[1] < len(c[0].items)]
            cursors.sort(key=lambda c: c[0].items[c[1]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[0].most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0].items[cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0].items[cursors[pivot + 1][1]] == item:
                pivot += 1
            blocks, skip_to = 0.0, NONE
            for c in cursors[: pivot + 1]:
                p, b = c[0], c[1] // BLOCK
                while b < len(p.block_last) and p.block_last[b] < item:
                    b += 1
                c[2] = b
                if b < len(p.block_last):
                    blocks += p.block_max[b]
                    skip_to = min(skip_to, p.block_last[b] + 1)
            if blocks < min(self.thresholds[item], NONE) * (1 - 1e-9) and blocks < least:
                if pivot + 1 < len(cursors):
                    skip_to = min(skip_to, cursors[pivot + 1][0].items[cursors[pivot + 1][1]])
                for c in cursors[: pivot + 1]:
                    _seek(c, max(skip_to, item + 1))
            elif cursors[0][0].items[cursors[0][1]] == item:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += c[0].impacts[c[1]]
                    c[1] += 1
                if score >= self.thresholds[item] * (1 - 1e-9):
                    found.append((item, score))
            else:
                for c in cursors[:pivot]:
                    if c[0].items[c[1]] < item:
                        _seek(c, item)


def _seek(cursor: list, item: int) -> None:
    p, at, b = cursor[0], cursor[1], max(cursor[2], cursor[1] // BLOCK)
    while b < len(p.block_last) and p.block_last[b] < item:
        b += 1
    at = max(at, b * BLOCK)
    while at < len(p.items) and p.items[at] < item:
        at += 1
    cursor[1], cursor[2] = at, b
