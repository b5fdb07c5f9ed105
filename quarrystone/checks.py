"""Integrity rules as queries that must return no rows (Spark enforces none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row; a null in a key exempts it."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, target: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose (non-null) foreign key has no row in target."""
    known = df
    for k in on:
        known = known.where(F.col(k).isNotNull())
    to = target.select(*(F.col(v).alias(f"__{v}") for v in on.values())).distinct()
    condition = [F.col(k) == F.col(f"__{v}") for k, v in on.items()]
    return known.join(to, condition, "left_anti")


def violations(df: DataFrame, rule: Column) -> DataFrame:
    """Rows that break a CHECK; null passes."""
    return df.where(~F.coalesce(rule, F.lit(True)))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rows with the names of the rules they break."""
    named = F.array(*(F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items()))
    return df.withColumn("broken", F.filter(named, lambda x: x.isNotNull()))
