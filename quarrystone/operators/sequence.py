"""What the reference does in ordered loops, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; give a total order, or equals are chosen arbitrarily."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_of_maximum(df: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows of each key's largest revision."""
    return df.withColumn("__m", F.max(revision).over(Window.partitionBy(key))).where(F.col(revision) == F.col("__m")).drop("__m")


def chain_errors(df: DataFrame, key: str, seq: str, same: list[str], settled: str | None = None) -> DataFrame:
    """Rows without a predecessor (seq - 1), or whose identity fields differ from it; ``settled`` must stay from the
    second step on."""
    w = Window.partitionBy(key).orderBy(seq)
    before = F.lag(F.struct(seq, *same, *([settled] if settled else []))).over(w)
    row = df.withColumn("__p", before)
    missing = (F.col(seq) > 0) & ~F.col(f"__p.{seq}").eqNullSafe(F.col(seq) - 1)
    changed = (F.col(seq) > 0) & ~F.struct(*same).eqNullSafe(F.struct(*(F.col(f"__p.{c}").alias(c) for c in same)))
    reason = F.when(missing, F.lit("missing_predecessor")).when(changed, F.lit("identity_changed"))
    if settled:
        reason = reason.when((F.col(seq) > 1) & ~F.col(settled).eqNullSafe(F.col(f"__p.{settled}")), F.lit("destination_changed"))
    return row.withColumn("reason", reason).where("reason IS NOT NULL").drop("__p")


def gaps(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys whose sequence (from its least value) isn't 0, 1, 2 ... without gaps or repeats."""
    got = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(seq).alias("distinct"), F.min(seq).alias("low"), F.max(seq).alias("high"))
    return got.where((F.col("n") != F.col("distinct")) | (F.col("low") != 0) | (F.col("high") - F.col("low") + 1 != F.col("n")))


def uncovered(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Windows that the next one of their key doesn't continue (the last one is never listed). Of equal starts the
    earlier end comes first, so that an empty window goes before the one that begins where it stands; nulls come last,
    and a window whose end or next start is null isn't listed."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    return df.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") != F.col(end))


def stable_runs(df: DataFrame, key: str, order: list[str], at: str, state: list[Column]) -> DataFrame:
    """Adds run (number of the run of equal states) and stable_since (its first time)."""
    w = Window.partitionBy(key).orderBy(*order)
    s = F.struct(*state)
    changed = (~s.eqNullSafe(F.lag(s).over(w))).cast("int")
    runs = df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")
    return runs.withColumn("stable_since", F.min(at).over(Window.partitionBy(key, "run")))


def blocked(df: DataFrame, key: str, order: list[str], exclusive: Column) -> DataFrame:
    """Adds blocked: an exclusive request waits ahead in the queue."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("blocked", F.coalesce(F.bool_or(exclusive).over(w), F.lit(False)))


def running_budget(df: DataFrame, key: str, order: list[str], amount: str, limit: float) -> DataFrame:
    """Adds used (running sum) and within (used <= limit)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(amount).over(w)).withColumn("within", F.col("used") <= limit)


def occurrence(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds occurrence: 0 for the first row of a name, 1 for the second ..."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1)
