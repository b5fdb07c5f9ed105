"""A bounded, deterministic sample of labelled documents for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_rows


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int], max_chars: int, id_col: str, text_col: str) -> tuple[DataFrame | None, dict[int, int]]:
    """Up to per_class[c] texts of each class as rows (__id, __t, __y), None without labels, and how many labels of each
    class there are in all.

    Rows are taken in the order of a hash of their id, so reruns agree; ids labelled twice count once, by their
    largest label. Texts of more than max_chars characters are passed over as examples (they are scored like any
    other). The rows are bounded by sum(per_class) * max_chars.
    """
    known = (
        labels.where(keep & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    )
    counts = {int(r["__y"]): int(r["count"]) for r in known.groupBy("__y").count().collect()}
    rows: list[tuple[int, int]] = []
    for c, n in per_class.items():
        rows += [(r[0], c) for r in known.where(F.col("__y") == c).orderBy(F.xxhash64("__id"), "__id").limit(n).select("__id").collect()]
    if not rows:
        return None, counts
    chosen = local_rows(docs.sparkSession, rows, {"__id": pa.int64(), "__y": pa.int32()})
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).where(F.length("__t") <= max_chars)
    # at most sum(per_class) rows of two numbers are broadcast; an id that repeats gives its greatest text
    return texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.max("__t").alias("__t")), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int], max_chars: int, id_col: str, text_col: str) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """labelled_rows, brought to the driver in the order of their ids."""
    rows, counts = labelled_rows(docs, labels, label, keep, per_class, max_chars, id_col, text_col)
    once = {r["__id"]: (r["__t"], r["__y"]) for r in rows.collect()} if rows is not None else {}
    return [once[i] for i in sorted(once)], counts
