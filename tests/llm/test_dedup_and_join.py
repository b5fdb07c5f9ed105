from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quarrystone.llm import ngram_join
from quarrystone.llm.common import connected_components
from quarrystone.llm.exact_dedup import exact_duplicates
from quarrystone.llm.ngram_join import keep_one, ngram_components
from quarrystone.llm.trie_join import Forest

from .conftest import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    return {i: (max(g), len(g), i == max(g), h) for h, g in groups.items() for i in g}


@pytest.mark.parametrize("support", [0.5, 0.05, 1 / 4096])
def test_exact_duplicates(docs, prose, support):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs, support=support).collect()}
    assert got == brute_groups(prose)


def test_exact_duplicates_odd(odd, empty):
    rows = exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}  # exactly one row of each group, repeated ids included
    assert exact_duplicates(empty).count() == 0


def shingles(text, n):
    w = [x.decode() for x in (text or "").translate(LOWER).encode().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, _ in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for j, b in enumerate(ids):
        for a in ids[:j]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1 << 17), (5, 80, 1 << 17), (4, 85, 200), (5, 80, 100), (4, 85, 20)])
def test_components(docs, prose, n, percent, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs, n, percent, block_grams=block).collect()}
    assert got == brute_components(prose, n, percent)


def test_components_small_flush(docs, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)  # the shuffle join
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs, 4, 85).collect()}
    assert got == brute_components(prose, 4, 85)
    kept = keep_one(docs, ngram_components(docs, 4, 85))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i} and kept.columns == docs.columns


@pytest.mark.parametrize("block", [1 << 17, 600, 150])
def test_components_of_a_shared_passage(spark, monkeypatch, block):
    """Families of near copies that all hold one passage, which is not known to be common: candidates join all of them."""
    monkeypatch.setattr(ngram_join, "common_hashes", lambda texts, n: np.zeros(0, np.uint64))
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    passage, rows = [rng.choice(words) for _ in range(60)], []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([30, 60, 90]))] + passage
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w), "s"))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(table(spark, rows), 5, 80, block_grams=block).collect()}
    assert got == brute_components(rows, 5, 80)


def test_a_task_of_the_join_runs_one_python_worker(spark, monkeypatch):
    """Executors keep the workers of the stage that ran most of them: links are made and joined in different stages."""
    seen = []

    def joined(edges):
        seen.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return connected_components(edges)

    monkeypatch.setattr(ngram_join, "common_hashes", lambda texts, n: np.zeros(0, np.uint64))
    monkeypatch.setattr(ngram_join, "connected_components", joined)
    rng = random.Random(3)
    shared, rows = [f"s{i}" for i in range(60)], []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(30)] + shared
        rows += [(len(rows) + k, " ".join(base[:k] + base[k + 1 :]), "s") for k in range(3)]
    # other parts hold all of the first one's n-grams, so documents are compared between parts
    rows += [(len(rows), " ".join(shared), "s"), (len(rows) + 1, " ".join(shared[:45]), "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(table(spark, rows), 5, 80, block_grams=20).collect()}
    assert got == brute_components(rows, 5, 80)
    assert len(seen) == 4 and not [p for p in seen if "MapInArrow" in p]


def test_stars():
    rng = random.Random(2)
    for _ in range(200):
        e = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randint(1, 40))]
        a, b = ngram_join.stars(*np.array(e, np.int64).T)
        forest = Forest(30)
        for x, y in e:
            forest.join(x, y)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((x, forest.find(x)) for x in {v for p in e for v in p} if forest.find(x) != x)


def test_keep_one_of_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [(1, t, "a"), (1, t, "a"), (1, t + " z", "b"), (2, t, "a"), (3, "x", "s"), (3, None, "s"), (None, t, "s"), (None, t, "s")])
    kept = keep_one(docs, ngram_components(docs))
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, t), (3, None), (None, t), (None, t)], key=str)


def test_components_odd(odd, empty, spark):
    rows = ngram_components(odd, 4, 85).collect()
    assert len(rows) >= odd.count() and all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_components(empty, 4, 85).count() == 0
    got = ngram_components(table(spark, [(1, None, None), (2, "", "s")]), 4, 85).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1), (2, 0, 2)}


@pytest.mark.parametrize("hub", [1000, 3])
def test_connected_components(spark, monkeypatch, hub):
    from quarrystone.llm import common

    monkeypatch.setattr(common, "HUB_LINKS", hub)
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (202, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}


def test_candidate_edges_do_not_grow_with_ranges():
    """Edges that documents have from each of many ranges are one star again where they meet."""
    import numpy as np
    import pyarrow as pa

    from quarrystone.llm.ngram_join import LINKED, NEAR, SIZES, _batch, _meet, _packed

    nodes = np.arange(1, 501)
    ranges = [_batch([_packed(0, NEAR, nodes, np.full(500, r % 2))]) for r in range(50)]
    sizes = _batch([_packed(0, SIZES, nodes, nodes * 2), _packed(0, SIZES, np.zeros(0, np.int64), np.array([3])), _packed(0, LINKED, nodes[:2], nodes[1:3])])
    got = pa.Table.from_batches(_meet(iter([*ranges, sizes]))).to_pylist()
    assert sum(r["kind"] == NEAR for r in got) == 500 and {r["a"] for r in got if r["kind"] == NEAR} | {0} == set(range(501))
    assert sum(r["kind"] == SIZES for r in got) == 501 and [r["b"] for r in got if r["kind"] == SIZES and r["a"] is None] == [3]
    assert [(r["a"], r["b"]) for r in got if r["kind"] == LINKED] == [(1, 2), (2, 3)]


@pytest.mark.parametrize("hub", [1000, 3])
@pytest.mark.parametrize("most", [1 << 20, 150, 0])
def test_few_links_are_joined_without_rounds(spark, monkeypatch, most, hub):
    """Each round's shuffles leave files on disk: links that one task can hold need none; more go through rounds."""
    from quarrystone.llm import common

    written = []
    monkeypatch.setattr(common, "checkpoint", lambda df, write=common.checkpoint: written.append(1) or write(df))
    monkeypatch.setattr(common, "TASK_LINKS", most)
    monkeypatch.setattr(common, "HUB_LINKS", hub)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(90)] + [(200 + rng.randrange(150), 200 + rng.randrange(150)) for _ in range(110)] + [(2**62, -5), (7, 7), (1000, 1000)]
    index = {x: k for k, x in enumerate(sorted({x for e in edges for x in e}))}
    forest, nodes = Forest(len(index)), list(index)
    for a, b in edges:
        forest.join(index[a], index[b])
    got = [tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()]
    assert sorted(got) == sorted((x, nodes[forest.find(index[x])]) for x in {x for a, b in edges if a != b for x in (a, b)})
    assert (len(written) <= 2) == (most == 1 << 20)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("most", [1000, 3, 0])
@pytest.mark.parametrize("step", [1, 2**50 + 7])
def test_rows_parted_by_ids(spark, most, step):
    """Masks of ids that follow one another, of sparse ids, and fewer masks than ids need."""
    from quarrystone.llm.common import parted_by

    ids = [k * step for k in range(-90, 90, 7)]
    rows = [*(k * step for k in range(-100, 100)), 5 * step, -6 * step, -6 * step, 2**63 - 1, -(2**63), None]
    docs = table(spark, [(i, "x", None) for i in rows])
    inside, outside = parted_by(docs, docs["doc_id"], spark.createDataFrame([(i,) for i in ids], "i long"), most)
    key = lambda i: (i is None, i or 0)
    assert inside.columns == outside.columns == docs.columns
    assert sorted((r.doc_id for r in inside.collect()), key=key) == sorted((i for i in rows if i in ids), key=key)
    assert sorted((r.doc_id for r in outside.collect()), key=key) == sorted((i for i in rows if i not in ids), key=key)


def test_other_texts_are_not_dealt(spark, monkeypatch):
    """Whatever the number of ids that are sought or go, the texts of other documents stay where they lie."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 6)
    docs = table(spark, [(i, f"text {i // 2}", None) for i in range(200)])
    components = spark.createDataFrame([(i, 1, i - i % 2) for i in range(200)], "doc_id long, n_shingles long, component_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = keep_one(docs, components)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 200, 2))
        rows = spark.createDataFrame([(i, i % 3) for i in range(0, 40, 2)], "doc_id long, block long")
        got = ngram_join._texts_of(docs.select("doc_id", "text"), rows)
        assert sorted(map(tuple, got.select("doc_id", "block", "text").collect())) == [(i, i % 3, f"text {i // 2}") for i in range(0, 40, 2)]
        assert "Filter" in got._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin", 1)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_signatures_leave_the_disk(spark, docs, monkeypatch):
    """Shuffles of the first pass are gone when texts are dealt."""
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    known = lambda: {int(x) for x in tracker.shuffleStatuses().keys().mkString(",").split(",") if x}
    seen, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "RELEASE_GRAMS", 0)
    monkeypatch.setattr(ngram_join, "_verify", lambda *a: seen.append(known()) or verify(*a))
    start = max(known(), default=-1)
    ngram_components(docs, 4, 85).collect()
    assert len([x for x in seen[0] if x > start]) <= 2
