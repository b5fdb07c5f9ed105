"""What a task of the n-gram Jaccard join does with arrays: n-gram sets, signatures, and the prefix-tree join of a block."""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import xxhash

#: Odd multipliers of the usual 64-bit mixers.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Sets of classes up to this size meet by prefix tokens, larger ones by segments.
PREFIX_SIZE = 40


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class NGrams:
    """Sorted distinct 64-bit hashes of a text's word n-grams; A-Z lower-cased, words parted by ASCII white space.

    Fewer words than n count as one n-gram of their own; no words give the empty set.
    """

    def __init__(self, n: int):
        self.n = n

        class Hashes(dict):
            def __missing__(self, word):
                if len(self) > 100_000:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.hashes = Hashes()

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = self.n if len(w) >= self.n else len(w)
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ w[j : len(w) - k + 1 + j]) * M1
            h ^= h >> np.uint64(29)
        return np.unique(mixed(h))


class Signatures:
    """Hashes that two sets are sure to have in common if 100 * |intersection| >= percent * |union|.

    Sizes fall into classes such that linked sets are in the same class or in neighbouring ones; each set signs for its
    own class and for the next. In a class, linked sets differ in at most H hashes. Classes of small sets sign with
    prefix tokens: the first n - ceil(t n) + 1 hashes in the order (common, hash). The others cut the range of hashes
    into H + 1 + E equal segments, of which at least E + 1 hold the same in both sets; a segment's hash is a signature.

    ``common`` are hashes known to be in many sets (lines, passages). A segment that holds nothing else would bring
    unrelated sets together, so segments are first cut without them; the sets differ in at most H of the others as
    well. Empty segments don't sign. If two linked sets have at most E empty segments in common, another equal one
    remains; if more, each has more than E, and such a set signs again, with other segments (ATTEMPTS: without or with
    the common hashes, and by which hash they are dealt). After the last attempt the empty segments sign too. So no
    link is lost, whatever the sets and whatever is held to be common.
    """

    ATTEMPTS = ((False, 0), (False, 1), (True, 0), (True, 1), (True, 2), (True, 3), (True, 4))

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.t = percent
        self.bounds = [1, 2]
        self.shapes: dict[int, tuple[int, int, int]] = {}
        self.common = np.zeros(0, np.uint64) if common is None else common

    def _class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * 100 // self.t + 1)
        return bisect_right(self.bounds, n) - 1

    def _shape(self, k: int) -> tuple[int, int, int]:
        """Of class k: its largest size, H, and E: about what three of four of the smallest sets that sign for it
        need."""
        if k not in self.shapes:
            while len(self.bounds) < k + 2:
                self._class(self.bounds[-1])
            most, least = self.bounds[k + 1] - 1, self.bounds[max(0, k - 1)]
            h, spare = 2 * most * (100 - self.t) // (100 + self.t), 1
            while True:
                m = h + 1 + spare
                empty = m * math.exp(-least / m)
                if spare >= empty + 0.7 * math.sqrt(empty) or spare >= h:
                    break
                spare += 1
            self.shapes[k] = (most, h, spare)
        return self.shapes[k]

    def of(self, h: np.ndarray) -> np.ndarray:
        n, out = len(h), []
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            is_common = self.common[at] == h
        else:
            is_common = np.zeros(n, bool)
        rare = h[~is_common]
        dealt: dict[tuple[bool, int], np.ndarray] = {(False, 0): rare, (True, 0): h}
        own = self._class(n)
        for k in (own, own + 1):
            most, differ, spare = self._shape(k)
            if differ == 0:
                continue  # only equal sets are linked
            if most <= PREFIX_SIZE:
                ordered = np.concatenate([rare, h[is_common]])
                out.append(mixed(ordered[: n - -(-self.t * n // 100) + 1] ^ self._salt(k, 0)))
                continue
            m = np.uint64(differ + 1 + spare)
            for j, attempt in enumerate(self.ATTEMPTS, 1):
                if attempt not in dealt:
                    dealt[attempt] = np.sort(mixed((h if attempt[0] else rare) ^ (np.uint64(int(M1) * (attempt[1] * 2 + 1) & 0xFFFFFFFFFFFFFFFF))))
                empty = self._sign(out, dealt[attempt], m, self._salt(k, j))
                if len(empty) <= spare:
                    break
            else:
                out.append(mixed(((empty + np.uint64(1)) * M2) ^ self._salt(k, 15)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    @staticmethod
    def _salt(k: int, kind: int) -> np.uint64:
        return np.uint64((16 * k + kind + 1) * int(M1) & 0xFFFFFFFFFFFFFFFF)

    @staticmethod
    def _sign(out: list[np.ndarray], h: np.ndarray, m: np.uint64, salt: np.uint64) -> np.ndarray:
        """Adds the signatures of the segments that aren't empty (h is sorted); returns those that are."""
        segment = ((h >> np.uint64(32)) * m) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(h) else np.zeros(0, np.int64)
        if len(h):
            sums = np.add.reduceat(mixed(h ^ M3), starts)
            out.append(mixed(sums ^ ((segment[starts] + np.uint64(1)) * M1) ^ salt))
        return np.setdiff1d(np.arange(m, dtype=np.uint64), segment[starts], assume_unique=True) if len(starts) < int(m) else np.zeros(0, np.uint64)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Node:
    __slots__ = ("label", "children", "docs", "least", "most", "deep", "rep", "mixed")

    def __init__(self, label: list[int]):
        self.label, self.children, self.docs = label, {}, []
        self.least, self.most, self.deep = 1 << 60, 0, 0  # sizes below, and tokens on the longest way down from here
        self.rep, self.mixed = -1, False  # one document below, and whether others may lie in other components


def linked_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that link all components of the sets' links: every linked pair ends in one component.

    Each set is a path of a prefix tree, its hashes ordered by how many sets of the block share them (most first), so
    that near copies share long paths. A set is first looked up, then inserted. A look-up carries the overlap with the
    path so far, shared by all sets below it, and leaves a subtree when the overlap, plus what either side has left,
    can't reach what the smallest set below needs, when no size below fits, or when all sets below are already in the
    looker's component.
    """
    n = len(sets)
    forest, links = Forest(n), []

    def link(a, b):
        if forest.join(a, b):
            links.append((a, b))

    seen: dict[bytes, int] = {}
    distinct = []
    for i, s in enumerate(sets):
        first = seen.setdefault(s.tobytes(), i)
        if first == i:
            distinct.append(i)
        else:
            link(first, i)
    if len(distinct) <= 6:
        for j, b in enumerate(distinct):
            for a in distinct[:j]:
                x, y = len(sets[a]), len(sets[b])
                if 100 * min(x, y) >= percent * max(x, y) and forest.find(a) != forest.find(b):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (x + y - both):
                        link(a, b)
        return links
    tokens, inverse, counts = np.unique(np.concatenate([sets[i] for i in distinct]), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    ranks, shared, at = rank[inverse], counts[inverse] > 1, 0
    root = Node([])
    paths = {}
    for i in distinct:
        size = len(sets[i])
        part = slice(at, at + size)
        paths[i] = np.sort(ranks[part][shared[part]]).tolist()  # a hash of one set alone can't overlap
        at += size
    for i in sorted_by_size(distinct, sets):
        _look_up(root, i, len(sets[i]), paths[i], percent, forest, link)
        _insert(root, i, len(sets[i]), paths[i], forest)
    return links


def sorted_by_size(positions: list[int], sets: list[np.ndarray]) -> list[int]:
    return sorted(positions, key=lambda i: (len(sets[i]), i))


def _look_up(root: Node, x: int, size: int, path: list[int], percent: int, forest: Forest, link) -> None:
    own, total = set(path), len(path)
    stack = [(root, 0)]
    while stack:
        node, overlap = stack.pop()
        if node.most * 100 < percent * size or node.least * percent > 100 * size:
            continue
        if not node.mixed and node.rep >= 0 and forest.find(node.rep) == forest.find(x):
            continue
        need = -(-percent * (size + node.least) // (100 + percent))
        label = node.label
        if label:
            left = min(node.deep, total - bisect_left_count(path, label[0]))
            if overlap + left < need:
                continue
            overlap += sum(1 for t in label if t in own)
            left = min(node.deep - len(label), total - bisect_right(path, label[-1]))
            if overlap + left < need:
                continue
        for d, d_size in node.docs:
            if overlap * 100 >= percent * (size + d_size - overlap):
                link(d, x)
        stack.extend((child, overlap) for child in node.children.values())


def bisect_left_count(path: list[int], token: int) -> int:
    return bisect_right(path, token - 1)


def _insert(root: Node, x: int, size: int, path: list[int], forest: Forest) -> None:
    node, at = root, 0
    while True:
        node.least, node.most = min(node.least, size), max(node.most, size)
        node.deep = max(node.deep, len(path) - at + len(node.label))  # at: behind this node's label
        if node.rep < 0:
            node.rep = x
        elif forest.find(node.rep) != forest.find(x):
            node.mixed = True
        if at == len(path):
            node.docs.append((x, size))
            return
        child = node.children.get(path[at])
        if child is None:
            leaf = Node(path[at:])
            node.children[path[at]] = leaf
            at = len(path)
            leaf.least, leaf.most, leaf.deep, leaf.rep = size, size, len(leaf.label), x
            leaf.docs.append((x, size))
            return
        label, k = child.label, 0
        while k < len(label) and at + k < len(path) and label[k] == path[at + k]:
            k += 1
        if k < len(label):  # the paths part inside a label
            upper = Node(label[:k])
            upper.least, upper.most, upper.rep, upper.mixed, upper.deep = child.least, child.most, child.rep, child.mixed, child.deep
            child.label, child.deep = label[k:], child.deep - k
            upper.children[label[k]] = child
            node.children[path[at]] = upper
            child = upper
        node, at = child, at + k


@lru_cache(maxsize=4)
def ngrams(n: int) -> NGrams:
    return NGrams(n)
