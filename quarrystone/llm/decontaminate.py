"""Benchmark decontamination: BM25 retrieval of test items for every passage, then question and answer overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import Index, words_of
from .common import one_by_one, slices, tidy, whole

#: Items (and characters of items) that one broadcast index holds; larger benchmarks take one pass a part.
PART_ITEMS, PART_CHARS = 20_000, 16_000_000
GRAM = 5


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is what follows the last question mark, or else the last sentence; an item of one sentence is all
    question."""
    text = text.strip()
    head, mark, tail = text.rpartition("?")
    if mark and tail.strip():
        return head + mark, tail.strip()
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text)]
    return (text[: cuts[-1]].strip(), text[cuts[-1] :].strip()) if cuts else (text, "")


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Five-word shingles; fewer words are one shingle, none are none."""
    if not words:
        return set()
    k = min(GRAM, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _held(part: set[tuple[bytes, ...]], words: list[bytes], of_text: dict[int, set]) -> float:
    """The share of the part's shingles that the text holds; an empty part is held."""
    if not part:
        return 1.0
    k = len(next(iter(part)))
    if k not in of_text:
        of_text[k] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return len(part & of_text[k]) / len(part)


def _parts(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in order of id, a bounded part at a time; items without words can't leak."""
    part, chars = [], 0
    rows = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long"), item_text).orderBy(item_id, item_text)
    for i, text in rows.toLocalIterator():
        if not words_of(text):
            continue
        part.append((i, text))
        chars += len(text)
        if len(part) >= PART_ITEMS or chars >= PART_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """Pairs doc_id, item_id, score, question_overlap, answer_overlap of documents that hold a test item.

    Every passage of every text is a query to the index of items; an item is retrieved when its BM25 score reaches
    ``share`` of what a passage with all its words would get. It counts when the document holds at least ``overlap``
    of the five-word shingles of its question, and as much of its answer. Null texts hold nothing; null ids pass
    through; documents or items that repeat give a pair each time (equal pairs of one row once); an empty table gives
    no rows. No shuffle; the index is broadcast in parts of bounded size.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], kind)
    for part in _parts(benchmark, item_id, item_text):
        held = spark.sparkContext.broadcast(part)
        found = found.union(texts.mapInArrow(tidy(_search(held, share, overlap)), kind))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that hold no test item: searched and dropped in one pass a part of the benchmark,
    without a join."""
    spark, kept = docs.sparkSession, docs
    for part in _parts(benchmark, item_id, item_text):
        held = spark.sparkContext.broadcast(part)
        kept = kept.mapInArrow(tidy(_keep(held, share, overlap, text_col)), docs.schema)
    return kept


class _Searcher:
    def __init__(self, items: list[tuple[int, str]], share: float, overlap: float):
        self.index, self.overlap = Index([t for _, t in items], share), overlap
        self.parts = [tuple(grams(words_of(x)) for x in question_and_answer(t)) for _, t in items]

    def of(self, text: str) -> list[tuple[int, float, float, float]]:
        """(place of the item, score, question overlap, answer overlap) of the items that the text holds."""
        codes = self.index.codes(text)
        best: dict[int, float] = {}
        for a, b in self.index.passages(codes):
            for i, score in self.index.search(codes[a:b]):
                best[i] = max(best.get(i, 0.0), score)
        words, shingles, out = words_of(text) if best else [], {}, []
        for i, score in sorted(best.items()):
            q = _held(self.parts[i][0], words, shingles)
            a = _held(self.parts[i][1], words, shingles) if q >= self.overlap else 0.0
            if q >= self.overlap and a >= self.overlap:
                out.append((i, score, q, a))
        return out


def _keep(items, share: float, overlap: float, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(items.value, share, overlap)
        for batch in slices(batches):
            yield batch.filter(pa.array([not searcher.of(t or "") for t in one_by_one(batch.column(text_col))], pa.bool_()))

    return keep


def _search(items, share: float, overlap: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(items.value, share, overlap)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), one_by_one(batch.column("text")), strict=True):
                out += [(doc, items.value[i][0], *rest) for i, *rest in searcher.of(text)]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return search
