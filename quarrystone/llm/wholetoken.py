"""Byte-level BPE through the tokenizers library with a whole-token shortcut.

Offline, once per process: every vocabulary string that the model encodes alone as one token is proved whole, and the
library's own classes of characters (letter, number, white space) are read off for each code point up to U+FFFF, so
that a compiled pattern cuts exactly as the library does. Pre-tokens in the proved set count as one token; only the
rest is merged, by the library's model, and remembered. Texts with characters above U+FFFF or with a special token's
string go through the library as a whole.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np

from .common import single_thread

#: The contractions that byte-level pre-tokenisation cuts off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """Bytes as byte-level BPE writes them: printable ones as themselves, the rest from U+0100 upward."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return table


def _class(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\u{points[i]:04x}" + (f"-\\u{points[j]:04x}" if j > i else ""))
        i = j + 1
    return "".join(out)


class WholeToken(dict):
    """Maps a pre-token to its ids (u32, packed); misses are merged by the library."""

    def __init__(self, config: str):
        single_thread()
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(config)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = byte_letters()
        self.whole = self._prove_whole()
        self.cut, self.other = self._pattern()

    def _prove_whole(self) -> dict[str, int]:
        whole = {}
        for text, i in self.library.get_vocab(with_added_tokens=False).items():
            got = self.model.tokenize(text)
            if len(got) == 1 and got[0].id == i:
                whole[text] = i
        return whole

    def _pattern(self) -> tuple[re.Pattern, re.Pattern]:
        """The cutting pattern, and what sends a text to the library."""
        cut = self.library.pre_tokenizer.pre_tokenize_str
        points = [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
        letters, numbers, spaces = [], [], []
        for start in range(0, len(points), 2048):
            some = points[start : start + 2048]
            for sign, into in (("a", letters), ("1", numbers)):
                ends = {b for _, (_, b) in cut("".join(f"!{sign}{chr(c)}!" for c in some))}
                # in "!a?!" the sign and a letter stay together: a cut after three characters but none after two
                into += [c for k, c in enumerate(some) if 4 * k + 2 not in ends and 4 * k + 3 in ends]
        known = {*letters, *numbers}
        for c in (c for c in points if c not in known):
            if len(cut(f"\n{chr(c)}")) == 1:
                spaces.append(c)
        L, N, S = map(_class, (letters, numbers, spaces))
        pattern = f"{CONTRACTIONS}| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        return re.compile(pattern), re.compile("|".join([*special, "[\U00010000-\U0010ffff]"]))

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin1").translate(self.letters)
        one = self.whole.get(spelled)
        ids = array("I", [one] if one is not None else [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if self.other.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, self.cut.findall(text))), np.uint32)


class WholeTokenCounts(WholeToken):
    """Maps a pre-token to its number of tokens."""

    def __missing__(self, piece: str) -> int:
        spelled = piece.encode().decode("latin1").translate(self.letters)
        n = 1 if spelled in self.whole else len(self.model.tokenize(spelled))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.other.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.cut.findall(text)))


@functools.lru_cache(maxsize=2)
def counter(config: str) -> WholeTokenCounts:
    return WholeTokenCounts(config)


@functools.lru_cache(maxsize=2)
def encoder(config: str) -> WholeToken:
    return WholeToken(config)


def is_wholetoken_config(config: str) -> bool:
    """True for what the shortcut covers: byte-level BPE without normaliser, prefix space or post-processor."""
    import json

    c = json.loads(config)
    pre = c.get("pre_tokenizer") or {}
    return (
        c["model"]["type"] == "BPE" and not c.get("normalizer") and not c.get("post_processor")
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not c["model"].get("ignore_merges") and not c["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in c.get("added_tokens", []))
    )
