from __future__ import annotations

import random
import zlib

import pytest

from quarrystone.llm.quality import quality_scores
from quarrystone.llm.toxicity import toxicity_scores, without_toxic

from .conftest import table

RUDE = "grumblefax snortwick bleghorn mumpslap vilegrunt".split()


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        toxic, poor = i % 5 == 0, i % 4 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        text = " ".join(x.upper() + "!!" for x in w) if poor else " ".join(w) + "."
        rows.append((i, text, "s"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, None, "s"), (1001, "", None), (1002, " ".join(words * 50), "s"), (None, "x", "s"), (1003, "a", "s")]
    return table(spark, rows), spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("scorer", "place", "modulus", "held", "cut"), [(toxicity_scores, 1, 5, 0, 0.5), (quality_scores, 0, 4, 2, 0.7)])
def test_held_out_accuracy(judged, scorer, place, modulus, held, cut):
    docs, labels, truth = judged
    rows = scorer(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows if r.doc_id is not None)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][place] for r in test) / len(test) > 0.93
    again = {r.doc_id: r.score for r in scorer(docs, labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in rows)
    # scores of held-out labels and of ids can't matter
    turned = labels.selectExpr("doc_id", f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % {modulus} = {held} THEN 1 - quality ELSE quality END AS quality", f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % {modulus} = {held} THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in scorer(docs, turned).collect()} == pytest.approx(again)


def test_without_toxic(judged):
    docs, labels, _ = judged
    kept = without_toxic(docs, labels)
    assert kept.schema == docs.schema
    bad = {r.doc_id for r in toxicity_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


@pytest.mark.parametrize("scorer", [toxicity_scores, quality_scores])
def test_without_labels_or_rows(judged, empty, scorer):
    docs, labels, _ = judged
    assert scorer(empty, labels).count() == 0
    none = scorer(docs, labels.where("false")).collect()
    assert len({round(r.score, 9) for r in none}) == 1
