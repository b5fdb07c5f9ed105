"""Array kernels against brute force, with generated inputs."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm.bm25 import Index, words_of
from quarrystone.llm.mixing import min_cost_flow, quotas
from quarrystone.llm.token_output import Shard, bits_for, pack, shard_bytes, unpack
from quarrystone.llm.trie_join import Forest, Signatures, linked_forest, mixed

sets = st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 400), max_size=90), st.lists(st.integers(1000, 9999), max_size=6)), min_size=2, max_size=24)


@settings(max_examples=60, deadline=None)
@given(sets, st.sampled_from([80, 85]), st.sampled_from([5, 30, 120, 390]))
def test_trie_and_signatures_lose_no_link(rows, percent, size):
    made = []
    for base, gone, more in rows:
        tokens = {base * 100_000 + i for i in range(size)} - {base * 100_000 + g for g in gone[: size // 8]} | set(more)
        made.append(np.sort(mixed(np.array(sorted(tokens) or [1], np.uint64))))
    links = []
    for j in range(len(made)):
        for i in range(j):
            both = len(np.intersect1d(made[i], made[j]))
            if 100 * both >= percent * (len(made[i]) + len(made[j]) - both):
                links.append((i, j))

    def components(pairs):
        f = Forest(len(made))
        for a, b in pairs:
            f.join(a, b)
        return [f.find(i) for i in range(len(made))]

    assert components(links) == components(linked_forest(made, percent))
    every = np.unique(np.concatenate(made))
    for common in (None, every[::2], every[::7], every):
        signed = [{*Signatures(percent, common).of(s).tolist(), s.tobytes()} for s in made]
        assert all(signed[i] & signed[j] for i, j in links)


@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.sampled_from([17, 18, 20, 24, 32]))
def test_packing_round_trip(ids, bits):
    a = np.array(ids, np.uint32)
    assert (unpack(pack(a, bits), bits, len(a)) == a).all()


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(1)
    lengths = [0, 1, 9000, 17, 20_000]
    ids = rng.integers(0, 50257, sum(lengths)).astype(np.uint32)
    assert bits_for(50257) == 16 and bits_for(2) == 1 and bits_for(65537) == 17
    for bits in (16, 17):
        (tmp_path / "s").write_bytes(shard_bytes([3, None, 5, 6, 7], lengths, ids, bits))
        with (tmp_path / "s").open("rb") as f:
            shard = Shard(f)
            assert shard.doc_ids == [3, None, 5, 6, 7]
            assert (shard.document(2) == ids[1:9001]).all() and (shard.span(8190, 8195) == ids[8190:8195]).all() and not len(shard.document(0))


words = st.lists(st.sampled_from("a b c d e f g h i j k l m n o p q r s t".split()), min_size=1, max_size=30).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(words, min_size=1, max_size=40), words, st.sampled_from([0.2, 0.5, 0.9]))
def test_wand_finds_all_above_thresholds(items, passage, share):
    index = Index(items, share)
    codes = index.codes(passage)
    want = {}
    for c in set(codes[codes > 0].tolist()):
        p = index.postings[c - 1]
        for i, v in zip(p.items, p.impacts, strict=True):
            want[i] = want.get(i, 0) + v
    want = {i for i, v in want.items() if v >= index.thresholds[i] * (1 - 1e-9)}
    assert {i for i, _ in index.search(codes)} == want
    if want:  # pruning keeps every passage that has a hit
        assert index.passages(codes)


def test_words():
    assert words_of("Ab, (c) d !! \x0be") == [b"ab", "c) d".encode(), b"e"]


@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 1000), min_size=1))
def test_quotas(sizes):
    q = quotas(sizes, {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))})
    total = sum(sizes.values())
    assert all(q[s] <= 3 * n + 1e-6 for s, n in sizes.items()) and abs(sum(q.values()) - total) < 1e-6 * max(1, total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(1, 60)), min_size=1, max_size=7, unique_by=lambda p: p[0]), st.data())
def test_flow_is_cheapest(patterns, data):
    """Against brute force on whole uses: costs are convex, so the flow uses least those that need no repetition."""
    names = sorted({s for p, _ in patterns for s in p})
    quota = {s: float(data.draw(st.integers(0, 90))) for s in names}
    given_ = min_cost_flow(patterns, quota)
    assert all(-1e-6 <= g <= 3 * n + 1e-6 for g, (_, n) in zip(given_, patterns, strict=True))
    # as much as any routing can: by max flow = min cut over sets of sources
    from itertools import chain, combinations

    cut = min(sum(quota[s] for s in some) + sum(3 * n for p, n in patterns if not set(p) <= set(some)) for some in chain.from_iterable(combinations(names, k) for k in range(len(names) + 1)))
    assert abs(sum(given_) - cut) < 1e-5
    # the share without repetition is a maximum too
    single = min(sum(quota[s] for s in some) + sum(n for p, n in patterns if not set(p) <= set(some)) for some in chain.from_iterable(combinations(names, k) for k in range(len(names) + 1)))
    assert sum(min(g, n) for g, (_, n) in zip(given_, patterns, strict=True)) <= single + 1e-5
