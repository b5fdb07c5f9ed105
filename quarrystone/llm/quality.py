"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_thread, whole
from .labelled import id_remainder, labelled_sample

PAIRS = 65536
BINS = 16
DIMENSIONS, NEIGHBOURS, POWER = 64, 25, 8
BLOCK = 512


def _terms(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte pairs of the whole text with 1 + log counts, and how much of it is said once (in sixteenths)."""
    b = np.frombuffer(text.encode(), np.uint8)
    if len(b) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), BINS - 1
    n = np.bincount(b[:-1].astype(np.int64) * 256 + b[1:], minlength=PAIRS)
    i = np.flatnonzero(n)
    fresh = BINS - 1
    if len(b) >= 8:
        eights = np.lib.stride_tricks.sliding_window_view(b, 8)
        eights = np.ascontiguousarray(eights).view(np.uint64).ravel()
        fresh = min(BINS - 1, int(len(np.unique(eights)) / len(eights) * BINS))
    return i, (1 + np.log(n[i])).astype(np.float32), fresh


@dataclass
class LatentModel:
    idf: np.ndarray  # by byte pair, 0 where unknown
    axes: np.ndarray  # (PAIRS + BINS, dimensions)
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    weights: np.ndarray  # of labels, so that classes vote as they occur
    prior: float

    def embed(self, text: str) -> np.ndarray:
        i, v, fresh = _terms(text)
        v = v * self.idf[i]
        norm = np.linalg.norm(v)
        e = (v / norm) @ self.axes[i] if norm > 0 else np.zeros(self.axes.shape[1], np.float32)
        return e + 0.7 * self.axes[PAIRS + fresh]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Exact cosine products with every labelled vector, a block of texts at a time."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            e = np.stack([self.embed(t) for t in texts[at : at + BLOCK]])
            e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
            s = e @ self.vectors.T
            k = min(NEIGHBOURS, s.shape[1])
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(float) ** POWER * self.weights[near]
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + len(e)] = np.where(total > 0, vote, self.prior)
        return np.clip(out, 0, 1)


def fit_latent(sample: list[tuple[str, int]], counts: dict[int, int], least: int = 3, seed: int = 11) -> LatentModel:
    """tf-idf of byte pairs, then the leading singular vectors by seeded subspace iteration."""
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    terms = [_terms(t) for t, _ in sample]
    seen = np.zeros(PAIRS)
    for i, _, _ in terms:
        seen[i] += 1
    idf = np.where(seen >= least, np.log(max(len(sample), 1) / np.maximum(seen, 1)) + 0.3, 0).astype(np.float32)
    used = np.flatnonzero(idf)
    place = np.zeros(PAIRS, np.int64)
    place[used] = np.arange(len(used))
    a = np.zeros((len(sample), len(used) + BINS), np.float32)
    for r, (i, v, fresh) in enumerate(terms):
        v = v * idf[i]
        norm = np.linalg.norm(v)
        known = idf[i] > 0
        if norm > 0:
            a[r, place[i[known]]] = v[known] / norm
        a[r, len(used) + fresh] = 0.7
    axes = np.zeros((PAIRS + BINS, min(DIMENSIONS, max(1, min(a.shape)))), np.float32)
    if len(sample):
        q = np.random.default_rng(seed).standard_normal((a.shape[1], min(axes.shape[1] + 8, a.shape[1])))
        for _ in range(6):
            q, _ = np.linalg.qr(a.T @ (a @ q))
        _, _, v = np.linalg.svd(a @ q, full_matrices=False)
        lead = (q @ v.T)[:, : axes.shape[1]]
        axes[used, : lead.shape[1]] = lead[: len(used)]
        axes[PAIRS:, : lead.shape[1]] = lead[len(used) :]
        vectors = a @ lead
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    else:
        vectors = np.zeros((0, axes.shape[1]), np.float32)
    y = np.array([c for _, c in sample], float)
    ones = y.mean() if len(y) else 0.5
    weights = np.where(y == 1, prior / max(ones, 1e-9), (1 - prior) / max(1 - ones, 1e-9))
    return LatentModel(idf, axes, vectors.astype(np.float32), y, weights, prior)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", modulus: int = 4, held_out: int = 2, per_class: dict[int, int] | None = None, max_chars: int = 20_000, cutoff: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= cutoff).

    Learns only from labelled rows whose crc32(id as text) mod modulus differs from held_out, at most per_class of
    each class (1000 poor, 1500 good); their vectors (at most 2500 x 64 floats) are broadcast. Every document's whole
    text is compared with all of them, exactly. Texts of less than two bytes, null ones included, have only the
    feature of repetition; without labels every score is 0.5. A null id has held_out null.
    """
    keep = id_remainder(id_col, modulus) != held_out
    sample, counts = labelled_sample(docs, labels, label, keep, per_class or {0: 1000, 1: 1500}, max_chars, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_latent(sample, counts))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        m = model.value
        for batch in batches:
            got = pa.array(m.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.record_batch([batch.column("doc_id"), got], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (id_remainder("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
