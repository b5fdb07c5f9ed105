from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarrystone.llm.pii import base_spans, disclosing_terms, find_personal_data

from .conftest import table


def test_copies_do_not_count_against_a_term(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4))
    rows = [(i, f"{word()} {word()} Quellmann {word()} jo@firm.com {word()} {word()}", "s") for i in range(5)]
    rows += [(i, f"{word()} {word()} {word()}", "s") for i in range(5, 60)]
    rows += [(i, rows[0][1], "s") for i in range(60, 360)]
    got = {r.doc_id: r.n_term for r in find_personal_data(table(spark, rows)).collect()}
    assert all(got[i] == 1 for i in [*range(5), *range(60, 360)]) and not any(got[i] for i in range(5, 60))


def brute_terms(rows, share=0.9, least=3, chars=60):
    """(entity, term) by the formula, for texts whose only entities are e-mail addresses in lower case."""
    texts = sorted({t or "" for _, t, _ in rows})
    words = {t: {w for w in re.split(r"[\W_]+", t.lower()) if len(w) > 2} for t in texts}
    contexts = defaultdict(list)
    for t in texts:
        for m in re.finditer(r"[a-z]+@[a-z]+\.com", t):
            contexts[m.group(), t[max(0, m.start() - chars) : m.start()], t[m.end() : m.end() + chars]].append(t)
    holders, speak = defaultdict(set), defaultdict(set)
    for (e, *_), ts in contexts.items():
        holders[e].update(ts)
        speak[e].add(frozenset(ts))
    found = set()
    for e, groups in speak.items():
        assert all(len({frozenset(words[t]) for t in g}) == 1 or len(g) == 1 for g in groups)  # any text can speak for its group
        reps = {min(g) for g in groups}
        for t in {w for r in reps for w in words[r]}:
            net = sum(t in words[r] for r in reps)
            nt = sum(t in w for w in words.values()) - (sum(t in words[h] for h in holders[e]) - net)
            if net >= least and least <= len(reps) < len(texts) and math.log(net * len(texts) / (len(reps) * nt)) >= share * math.log(len(texts) / len(reps)) - 1e-12:
                found.add((e, t))
    return found


def test_terms_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.choice([2, 2, 4])))
    people = {f"{a}{b}@firm.com": [f"Name{a}{b}", f"Town{b}", "shared"] for a in "abc" for b in "xy"}
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.choice([20, 60]))]
        for e in rng.sample(sorted(people), rng.choice([0, 0, 1, 1, 2])):
            w.insert(rng.randrange(len(w)), e)
            for n in people[e]:
                if rng.random() < 0.8:
                    w.insert(0, n)  # far from the entity in the longer texts
        rows.append((i, " ".join(w), "s"))
    rows += [(100 + i, rows[i % 7][1], "s") for i in range(40)] + [(200, None, "s"), (None, "", "s"), (None, rows[0][1], "s")]
    docs = table(spark, rows)
    with_spans = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    terms = disclosing_terms(with_spans.where(F.size("spans") > 0), with_spans)
    got = {(r.entity.removeprefix("email:"), r.term) for r in terms.collect()}
    assert got == brute_terms(rows) and any(t.startswith(("name", "town")) for _, t in got)


def test_near_copies_speak_once(spark):
    """Four near copies hold an address nobody else has; what they share tells nothing about it."""
    base = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join([f"copy{i}", *base[:40], "jo@firm.com", *base[40:]]), "s") for i in range(4)]
    rows += [(i, f"other text {i}", "s") for i in range(10, 40)]
    assert not any(r.n_term for r in find_personal_data(table(spark, rows)).collect())
