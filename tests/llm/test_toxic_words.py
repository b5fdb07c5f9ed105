from __future__ import annotations

import random

import numpy as np

from quarrystone.llm import toxicity
from quarrystone.llm.toxicity import Distances, fit_toxicity, windows, without_copies

#: Fixed value: how trained dictionaries begin.
TRAINED = b"\x37\xa4\x30\xec"


def _sample(seed=5):
    """Most toxic texts share a few words; a tenth is toxic by inflected words of its own, each rare."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    strong, weak = ["grumblefax", "snortwick"], [f"quxwyzzle{c}" for c in "abcdefghij"]

    def text(kind):
        w = [rng.choice(common) for _ in range(60)]
        for _ in range(5 if kind else 0):
            w.insert(rng.randrange(len(w)), rng.choice({"strong": strong, "weak": weak}[kind]))
        return " ".join(w)

    kinds = ["strong"] * 450 + ["weak"] * 60 + [None] * 1200
    rng.shuffle(kinds)
    return text, [(text(k), int(k is not None)) for k in kinds]


def test_words_of_a_smaller_group_count():
    text, sample = _sample()
    model = fit_toxicity(sample, {1: 510, 0: 1200})
    distances = Distances(model.toxic, model.ordinary)
    scores = lambda kind: model.scores([distances.of(text(kind)) for _ in range(200)])
    assert np.mean(scores("strong") >= 0.5) > 0.95 and np.mean(scores("weak") >= 0.5) > 0.9 and np.mean(scores(None) >= 0.5) < 0.05


def test_both_dictionaries_are_trained_on_text():
    _, sample = _sample()
    model = fit_toxicity(sample, {1: 510, 0: 1200})
    assert model.toxic[:4] == TRAINED and model.ordinary[:4] == TRAINED
    assert b"snortwic" in model.toxic and b"grumblefa" in model.toxic and b"quxwyzz" in model.toxic
    assert b"snortwi" not in model.ordinary and b"quxwyzz" not in model.ordinary


def test_every_window_is_compressed_with_both():
    text, sample = _sample()
    model = fit_toxicity(sample, {1: 510, 0: 1200})
    d, seen = Distances(model.toxic, model.ordinary), ([], [])
    d.ordinary, d.toxic = (lambda c, s: lambda w: s.append(w) or c(w))(d.ordinary, seen[0]), (lambda c, s: lambda w: s.append(w) or c(w))(d.toxic, seen[1])
    t = " ".join(text(k) for k in (None, "weak", None, "strong") * 40)
    found = d.of(t)
    assert seen[0] == seen[1] == windows(t) and found[1] == len(windows(t)) == -(-len(t.split()) // toxicity.WINDOW_WORDS)
    far = [len(d.ordinary(w)) - len(d.toxic(w)) for w in windows(t)]
    assert found[0] == max(far) and found[2:] == tuple(sum(x >= v for x in far) for v in toxicity.THRESHOLDS)


def test_copies_are_one_piece_of_evidence():
    text, sample = _sample()
    t = text(None)
    assert without_copies([(t, 1), (t, 1), (t + " more", 1), *sample[:5], (t.upper(), 0)]) == [(t, 1), *sample[:5]]
    # an ordinary text copied a hundred times under a toxic label tells nothing about its words
    model = fit_toxicity([*sample, *[(t, 1)] * 100], {1: 610, 0: 1200})
    assert model.scores([Distances(model.toxic, model.ordinary).of(t)])[0] < 0.5
