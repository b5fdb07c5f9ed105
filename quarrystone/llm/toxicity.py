"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on toxic text; windows, calibrated
thresholds."""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_by_one, slices, tidy, whole
from .labelled import id_remainder, labelled_rows

WINDOW_WORDS = 6
#: Distances, in bytes, at which windows are counted; how much each count says is fitted.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 10)
#: Bytes of the two dictionaries at most, and of the segments that training picks; windows that train the ordinary one.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, ORDINARY_WINDOWS = 8192, 4096, 16, 60_000
#: Bytes of a piece of a word, how much evidence makes it telling (G-squared), and how many times as often it must stand
#: in toxic texts.
PIECE, EVIDENCE, TIMES = 7, 24.0, 2.0
#: Shortest reference into a dictionary, and shortest sample that training takes.
REFERENCE, SHORTEST = 6, 8
FOLDS = 3


def _words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def windows(text: str) -> list[bytes]:
    """All words of the text, six at a time, each once."""
    words = _words(text)
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


# --- the sample ----------------------------------------------------------------------------------------------------
def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Of exact and near copies the first stays (texts that share one of six minimum hashes of five-word shingles):
    a text copied many times is one piece of evidence."""
    from .trie_join import NGrams

    odd = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)  # fixed values: odd multipliers
    grams, seen, kept = NGrams(5), set(), []
    for text, y in sample:
        h = grams.of(text)
        marks = set(enumerate((h[None, :] * odd[:, None]).min(axis=1).tolist())) if len(h) else {(-1, 0)}
        if seen.isdisjoint(marks):
            kept.append((text, y))
        seen |= marks
    return kept


class Pieces:
    """The pieces of words (seven bytes, with the blanks beside the word) that each text of a sample holds. Pieces of
    fewer than FEWEST texts can't be telling and are left out."""

    FEWEST = 4

    def __init__(self, texts: list[str]):
        of_word: dict[bytes, np.ndarray] = {}
        held = []
        for text in texts:
            found = []
            for w in set(_words(text)):
                if w not in of_word:
                    of_word[w] = np.array([int.from_bytes(p.ljust(8, b"\0"), "big") for _, p in pieces(w)], np.uint64)
                found.append(of_word[w])
            held.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))
        of_word.clear()
        codes, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        self.codes = codes[counts >= self.FEWEST]
        self.held = [self._places(h) for h in held]

    def _places(self, h: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
        return at[self.codes[at] == h]

    def telling(self, rows: np.ndarray, toxic: np.ndarray) -> set[bytes]:
        """Pieces that toxic texts among ``rows`` hold TIMES as often as ordinary ones, with a G-squared of EVIDENCE."""
        count = lambda which: np.bincount(np.concatenate([self.held[i] for i in which] or [np.zeros(0, np.int64)]), minlength=len(self.codes))
        a, b = rows[toxic[rows]], rows[~toxic[rows]]
        n, m, x, y = len(a), len(b), count(a).astype(float), count(b).astype(float)
        if not n or not m:
            return set()
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (x * np.log(x / ((x + y) * n / (n + m))) + np.where(y > 0, y * np.log(y / ((x + y) * m / (n + m))), 0))
        told = np.flatnonzero((x / n > TIMES * y / m) & (x > 0) & (g >= EVIDENCE))
        return {int(c).to_bytes(8, "big").rstrip(b"\0") for c in self.codes[told]}


def pieces(word: bytes) -> list[tuple[int, bytes]]:
    w = b" " + word + b" "
    return [(i, w[i : i + PIECE]) for i in range(max(1, len(w) - PIECE + 1))]


# --- dictionaries --------------------------------------------------------------------------------------------------
def _trained(samples: list[bytes], size: int, seed: int) -> bytes:
    """What zstandard trains on the samples, of at most size bytes; if they are too few for it, their plain content."""
    import zstandard

    samples = list(samples)
    random.Random(seed).shuffle(samples)
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(sorted(set(samples)))[:TOXIC_BYTES]


def ordinary_dictionary(texts: list[str], seed: int = 7) -> bytes:
    """Trained on windows of ordinary texts."""
    every = [w for t in texts for w in windows(t)]
    random.Random(seed).shuffle(every)
    return _trained(every[:ORDINARY_WINDOWS], ORDINARY_BYTES, seed) or b" the and of "


def toxic_dictionary(texts: list[str], telling: set[bytes], seed: int = 7) -> bytes:
    """Trained on toxic texts: on every stretch of their words that telling pieces cover, as often as it stands there.

    Training keeps what is frequent, and most of a toxic text is ordinary words; without the choice of stretches they
    would fill the dictionary.
    """
    of_word: dict[bytes, bytes | None] = {}
    samples = []
    for text in texts:
        for w in _words(text):
            if w not in of_word:
                at = [i for i, p in pieces(w) if p in telling]
                padded = b" " + w + b" "
                of_word[w] = padded[at[0] : at[-1] + PIECE].ljust(SHORTEST, b"\n") if at else None
            if of_word[w]:
                samples.append(of_word[w])
    return _trained(samples, TOXIC_BYTES, seed) if samples else b""


def _compressor(content: bytes):
    """Greedy matching from six bytes on, so that a shared stretch is always referred to."""
    import zstandard

    log = max(14, (2 * len(content)).bit_length())  # all of the content stays within reach
    parameters = zstandard.ZstdCompressionParameters(
        window_log=log, hash_log=log, chain_log=log, search_log=6, min_match=REFERENCE, target_length=64,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress


class Distances:
    """Of a text: the largest (ordinary length - toxic length) of its windows, how many windows there are, and how many
    reach each threshold. Every window is compressed twice.

    The toxic side has the toxic dictionary before the ordinary one, so that references to ordinary stretches cost the
    same on both sides and lengths differ by what the toxic dictionary adds.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic + ordinary)

    def of(self, text: str) -> tuple[int, ...]:
        ordinary, toxic = self.ordinary, self.toxic
        far = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
        counts = [0] * (len(THRESHOLDS))
        for d in far:
            if d > 0:
                for j, t in enumerate(THRESHOLDS):
                    if d < t:
                        break
                    counts[j] += 1
        return max(0, *far) if far else 0, len(far), *counts


# --- model ---------------------------------------------------------------------------------------------------------
@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def scores(self, found: list[tuple[int, ...]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_evidence(found) @ self.weights, -30, 30)))


def _evidence(found: list[tuple[int, ...]]) -> np.ndarray:
    """The largest distance, and how many windows reach each threshold, by number and by share; the last column is 1."""
    f = np.array(found, float).reshape(len(found), 2 + len(THRESHOLDS))
    reached = f[:, 2:]
    return np.column_stack([np.minimum(f[:, 0], 16), np.log1p(np.minimum(reached, 24)), 10 * reached / np.maximum(f[:, 1:2], 1), np.ones(len(f))])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted Newton iterations; the last column of x is 1 and is not held back."""
    beta, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    hold[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + hold, x.T @ (w * (y - p)) - hold @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(sample: list[tuple[str, int]], counts: dict[int, int]) -> ToxicityModel:
    """Dictionaries from the whole sample (copies count once); the thresholds' weights from distances of each third of
    it to dictionaries of the other two, so that no text is weighed by a toxic dictionary that saw it. ``counts``, the
    labels of each class in all, set the scale of scores. Without telling pieces every score is the prior."""
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    sample = without_copies(sample)
    texts, toxic = [t for t, _ in sample], np.array([y == 1 for _, y in sample], bool)
    held, fold = Pieces(texts), np.arange(len(sample)) % FOLDS
    ordinary = ordinary_dictionary([t for t, y in sample if not y])
    flat = np.zeros(2 + 2 * len(THRESHOLDS))
    flat[-1] = math.log(prior / (1 - prior))

    def dictionary(rows: np.ndarray) -> bytes:
        return toxic_dictionary([texts[i] for i in rows if toxic[i]], held.telling(rows, toxic))

    all_rows = np.arange(len(sample))
    final = dictionary(all_rows)
    if not final:
        return ToxicityModel(b"", ordinary, flat)
    rows, found = [], []
    for k in range(FOLDS):
        seen = dictionary(all_rows[fold != k])
        if seen:
            d = Distances(seen, ordinary)
            rows += all_rows[fold == k].tolist()
            found += [d.of(texts[i]) for i in all_rows[fold == k]]
    y = toxic[rows].astype(float)
    if not 0 < y.sum() < len(y):  # too few to weigh: one far window is toxic
        flat[0], flat[-1] = 0.75, min(flat[-1], -3.0)
        return ToxicityModel(final, ordinary, flat)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return ToxicityModel(final, ordinary, _logistic(_evidence(found), y, weight))


# --- operator ------------------------------------------------------------------------------------------------------
def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 5, held_out: int = 0, per_class: dict[int, int] | None = None, max_chars: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), largest_distance, toxic_windows
    (those with a distance of three bytes or more).

    Learns only from labelled rows whose crc32(id as text) mod modulus differs from held_out, at most per_class of
    each class (1500 toxic, 3000 ordinary). The score depends on the text alone: its windows of six words, all of them,
    whatever its length, are compressed with both dictionaries. Null and empty texts have no windows and get the score
    of a text without toxic ones; rows that repeat get the same score each; a null id has held_out null; an empty table
    gives no rows. No shuffle of texts but those of the sample.
    """
    model = _fitted(docs, labels, id_col, text_col, label, modulus, held_out, per_class, max_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    three = 2 + THRESHOLDS.index(3)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        d = Distances(m.toxic, m.ordinary)
        for batch in batches:
            found = [d.of(t) for t in one_by_one(batch.column("text"))]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(m.scores(found), pa.float64()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[three] for x in found], pa.int32())],
                ["doc_id", "score", "largest_distance", "toxic_windows"],
            )

    scored = rows.mapInArrow(tidy(score), "doc_id long, score double, largest_distance int, toxic_windows int")
    return scored.select("doc_id", (id_remainder("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "largest_distance", "toxic_windows")


def _fitted(docs, labels, id_col, text_col, label, modulus, held_out, per_class, max_chars):
    """The model, broadcast. It is fitted in one task from the bounded sample, so the driver holds the model alone."""
    keep = id_remainder(id_col, modulus) != held_out
    sample, counts = labelled_rows(docs, labels, label, keep, per_class or {1: 1500, 0: 3000}, max_chars, id_col, text_col)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = {}
        for batch in batches:
            for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("__id", "__t", "__y")), strict=True):
                once[i] = max(once.get(i, ("", 0)), (t, y))
        model = fit_toxicity([once[i] for i in sorted(once)], counts)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    spark = docs.sparkSession
    if sample is None:
        return spark.sparkContext.broadcast(fit_toxicity([], counts))
    made = sample.repartition(1).mapInArrow(tidy(fit), "model binary").first()
    return spark.sparkContext.broadcast(pickle.loads(bytes(made["model"])) if made else fit_toxicity([], counts))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 5, held_out: int = 0, per_class: dict[int, int] | None = None, max_chars: int = 20_000, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below cutoff: scored and dropped in one pass, without a join."""
    model = _fitted(docs, labels, id_col, text_col, label, modulus, held_out, per_class, max_chars)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        d = Distances(m.toxic, m.ordinary)
        for batch in slices(batches):
            scores = m.scores([d.of(t or "") for t in one_by_one(batch.column(text_col))])
            yield batch.filter(pa.array(scores < cutoff))

    return docs.mapInArrow(tidy(keep), docs.schema)
