"""Append-only event logs: idempotent append, chain validation, cursors, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("planned", "destination_verified", "published", "source_cleaned")


def deduplicated(events: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """key, n, conflict: a key replayed with one payload is one event, with several it is a conflict."""
    return events.groupBy(*key).agg(F.count("*").alias("n"), (F.countDistinct(F.struct(*payload)) > 1).alias("conflict"))


def appended(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key the log doesn't hold: what an append writes (new holds each key once)."""
    return new.join(existing.select(*key).distinct(), key, "left_anti")


def inserted_or_found(existing: DataFrame, new: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """Insert-or-return: key, row_id, disposition (created, reused), the stored row winning."""
    old = existing.select(*key, F.col(row_id).alias("__old"))
    got = new.join(old, key, "left")
    return got.select(*key, F.coalesce("__old", row_id).alias(row_id), F.when(F.col("__old").isNull(), F.lit("created")).otherwise(F.lit("reused")).alias("disposition"))


def upserted(existing: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys; a new row's columns replace the stored ones."""
    n = new.select(key, F.struct(*columns).alias("__n"))
    e = existing.select(key, F.struct(*columns).alias("__e"))
    return e.join(n, key, "full_outer").select(key, F.coalesce("__n", "__e").alias("__r")).select(key, "__r.*")


def batch_after(events: DataFrame, after: int, limit: int, row_id: str = "id") -> DataFrame:
    if after < 0 or not 1 <= limit <= 1000:
        raise ValueError("bad cursor or batch size")
    return events.where(F.col(row_id) > after).orderBy(row_id).limit(limit)


def held_prefix(batch: DataFrame, usable: Column, row_id: str = "id") -> DataFrame:
    """Rows before the first one that can't be interpreted: what a cursor may consume (a batch is at most 1000 rows)."""
    w = Window.orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    return batch.withColumn("__bad", F.sum((~F.coalesce(usable, F.lit(False))).cast("int")).over(w)).where("__bad = 0").drop("__bad")


def latest_phase(events: DataFrame, key: str, seq: str, phase: str) -> DataFrame:
    return events.groupBy(key).agg(F.max(seq).alias("sequence"), F.max_by(phase, seq).alias("phase"))


def revision_fold(events: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Each accepted event raises its key's revision by one: revision after it, label before it, and whether it changed."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(label).over(w)
    return events.withColumn("revision", F.row_number().over(w)).withColumn("label_before", before).withColumn("label_changed", ~F.col(label).eqNullSafe(before))


def optimistic_fold(events: DataFrame, key: str, order: list[str], expected: str, label: str) -> DataFrame:
    """In order, an event is applied if the revision it expects is the key's current one, else it is a conflict.

    Data-dependent, so a fold over each key's ordered events in one aggregate: revision and label at the end, and how
    many were applied and refused. A key's events must fit an array.
    """
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(expected).alias("__e"), F.col(label).alias("__l"))))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit(None).cast("long").alias("label"), F.lit(0).cast("long").alias("refused"))

    def step(s, e):
        fits = e["__e"] == s["revision"]
        return F.struct((s["revision"] + fits.cast("long")).alias("revision"), F.when(fits, e["__l"].cast("long")).otherwise(s["label"]).alias("label"), (s["refused"] + (~fits).cast("long")).alias("refused"))

    return events.groupBy(key).agg(F.aggregate(items, start, step).alias("s")).select(key, "s.*")
