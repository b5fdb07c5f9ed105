from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from quarrystone.llm.token_counts import token_counts
from quarrystone.llm.token_output import read_tokens, token_output, write_tokens
from quarrystone.llm.wholetoken import counter, encoder, is_wholetoken_config

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_shortcut_equals_library(library):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        config = f.read()
    assert is_wholetoken_config(config)
    rng = random.Random(5)
    pool = [chr(x) for x in range(0x3000) if not 0xD800 <= x <= 0xDFFF] + ["<|endoftext|>", "\U0001f600", "'s", "'ll", " ", "  ", "\n", "　", "\xa0", "一", "the", "Hello"]
    for _ in range(4000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        want = library.encode(s, add_special_tokens=False).ids
        assert encoder(config).ids(s).tolist() == want and counter(config).count(s) == len(want), repr(s)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, prose, name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        want = {i: len(model.encode(t or "")) for i, t, _ in prose}
    else:
        t_ = Tokenizer.from_file(P.path(name))
        want = {i: len(t_.encode(t or "", add_special_tokens=False).ids) for i, t, _ in prose}
    got = token_counts(docs, P.path(name)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {i: len((t or "").encode()) for i, t, _ in prose}


def test_output_round_trip(spark, docs, prose, odd, empty, library, tmp_path):
    folder = "file://" + str(tmp_path / "t")
    manifest = write_tokens(docs, folder, P.path("byte_bpe_50k.json"), end_id=2)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in prose}
    every = np.concatenate([ids[i] for i in sorted(ids)])
    rows = [(r.name, r.base, r.tokens) for r in manifest.collect()]
    assert (read_tokens(rows, folder, 0, len(every)) == every).all() and (read_tokens(rows, folder, 777, 1234) == every[777:1234]).all()
    start = 0
    for r in sorted(token_output(docs, P.path("byte_bpe_50k.json")).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4")))
        start += r.n_tokens
    assert start == len(every)
    got = token_output(odd, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert len(got) == odd.count() and [r.doc_id for r in got][-2:] == [None, None]
    assert token_output(empty, P.path("byte_bpe_50k.json")).count() == 0 and token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0
