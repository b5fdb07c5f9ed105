from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrystone.llm.mixing import mix, mixed_documents, quotas

from .conftest import table

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs, prose, odd, empty):
    rows = mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in prose:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = quotas(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    source = {i: s for i, _, s in prose}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words(dict((i, t) for i, t, _ in prose)[r.doc_id]), sizes[s]) and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.1 * target[s], max(words(t) for _, t, x in prose if x == s) / 2 + 1)
    assert sorted(mix(docs).collect()) == sorted(rows)
    copies = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in rows if r.copies}) and mixed_documents(docs).schema == docs.schema
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0 and mix(odd).count() == odd.count()


def test_rows_of_the_driver_need_no_python_workers(spark):
    """Executors would keep workers for lists beside those for Arrow batches."""
    from quarrystone.llm import mixing
    from quarrystone.llm.labelled import labelled_rows

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.col("id").cast("int") % 7).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    sample, counts = labelled_rows(docs, labels, "toxic", F.lit(True), {1: 5, 0: 50}, 100, "doc_id", "text")
    assert counts == {0: 30, 1: 30} and Counter(r["__y"] for r in sample.collect()) == {1: 5, 0: 30}
    rows = docs.select(*mixing._sized(docs, None, None, "doc_id")).withColumn("__at", F.monotonically_increasing_id())
    plan = mixing._solve(rows, (5, 2, 1), None, 0.7, 3)
    cuts = mixing._cuts(mixing._marked(rows, plan, 17))
    assert plan.count() == 3 and cuts.count() > 0
    for frame in (sample, plan, cuts):
        assert "RDD" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_mix_overlapping(spark):
    d = table(spark, [(i, "w " * (5 + i % 4), "ab"[i % 2] if i % 3 else "a,b") for i in range(600)])
    rows = mix(d, weights={"a": 1, "b": 1}, share=1.5, membership=F.split("source", ",")).collect()
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) < 0.02 * total
    assert {tuple(r.sources) for r in rows} == {("a",), ("b",), ("a", "b")}


def test_mix_buckets(spark, monkeypatch):
    from quarrystone.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    d = table(spark, [(i, "w " * (1 + i % 9), f"s{i % 2}") for i in range(500)])
    rows = mix(d, share=0.7).collect()
    got, want = defaultdict(int), {}
    for r in rows:
        got[r.sources[0]] += r.taken
        want[r.sources[0]] = r.target
    assert all(abs(got[s] - want[s]) <= 2 for s in want)
    assert Counter(r.doc_id for r in mixed_documents(d, share=0.7).collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    """Stage by stage: columns stay, each stage's rule holds on its own input, the output is what run() gives."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "source_mix", "token_output"]
    from .test_dedup_and_join import brute_components

    stage = dict(c.STAGES)
    tame = spark.createDataFrame(stage["toxicity"](spark, docs, SF).toPandas(), docs.schema)
    assert tame.columns == docs.columns
    rows = [(r.doc_id, r.text, r.source) for r in tame.collect()]
    single = stage["ngram_jaccard_join"](spark, tame, SF)
    want = {i for i, (_, k) in brute_components(rows, 5, 80).items() if i == k}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, single, SF).collect()
    held = {r.doc_id for r in single.collect() if any(t in r.text for t in items)}
    assert held.isdisjoint({r.doc_id for r in clean}) and {r.doc_id for r in clean} >= want - held
    out = c.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = out.orderBy("start").collect()
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and {r.doc_id for r in got} <= {r.doc_id for r in clean}
