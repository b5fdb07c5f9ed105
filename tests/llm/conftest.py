from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, k string, draw long, digest binary, spans string, block string, score double, h long, at long, bucket int"
EXTRA = (1, 1.0, "k", 2, bytearray(b"d"), "s", "b", 0.5, 3, 4, 5)


def table(spark, rows):
    """Documents (doc_id, text, source) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows], KIND)


@pytest.fixture(scope="session")
def prose():
    """Invented texts: families of near copies, exact copies (also by case), short, empty, null and very long ones."""
    rng = random.Random(7)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, i = [], 0
    for _ in range(6):
        base = text(rng.choice([30, 80, 200])).split()
        for _ in range(rng.choice([2, 5, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w), f"src{i % 3}"))
            i += 1
    for n in (1, 2, 3, 4, 5, 6, 9, 40):
        t = text(n)
        for variant in (t, t.upper(), t + "\n"):
            rows.append((i, variant, f"src{i % 3}"))
            i += 1
    for t, s in (("", "src0"), (None, "src0"), (" \t\n", None), (text(30_000), "src1"), ("é\U0001f600 x", None), (text(50), None)):
        rows.append((i, t, s))
        i += 1
    return rows


@pytest.fixture(scope="session")
def docs(spark, prose):
    return table(spark, prose)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [(1, "x", "s")]).where("false")


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Null and repeated ids, repeated rows."""
    return table(spark, [*prose[:20], *prose[:3], (None, prose[0][1], "src0"), (None, None, None), (5, prose[9][1], "src1"), (5, prose[9][1], "src1")])
