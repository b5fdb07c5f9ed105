"""Windowed feature vectors under validity masks: one row per (bag, window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(df: DataFrame, keys: list[str], values: str, mask: Column | None = None) -> DataFrame:
    """keys, dim, value, valid: one row per element."""
    pairs = F.arrays_zip(F.col(values).alias("v"), (F.transform(values, lambda _: F.lit(True)) if mask is None else mask).alias("m"))
    x = df.select(*keys, F.posexplode(pairs).alias("dim", "e"))
    return x.select(*keys, "dim", F.col("e.v").cast("double").alias("value"), F.col("e.m").alias("valid"))


def masked_summary(x: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of the valid values of each dimension (0 without any), and the mask's coverage."""
    v = F.when(F.col("valid"), F.col("value"))
    return x.groupBy(*keys, "dim").agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"),
        F.count_if("valid").alias("n_valid"), F.avg(F.col("valid").cast("double")).alias("coverage"),
    )


def standardizer(x: DataFrame, bag: str) -> DataFrame:
    """Mean and scale of each dimension where every bag weighs the same: var = E[x^2] - E[x]^2, at least 0; a scale
    below 1e-6 is 1."""
    per_bag = x.groupBy(bag, "dim").agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("s"))
    got = per_bag.groupBy("dim").agg(F.avg("m").alias("mean"), F.avg("s").alias("square"))
    scale = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    return got.select("dim", "mean", F.when(scale < 1e-6, 1.0).otherwise(scale).alias("scale"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def softmax_pool(x: DataFrame, bag: str, attention: DataFrame, window: str) -> DataFrame:
    """Pools windows by softmax of their attention: exp(a - max) weights, so partial sums merge. attention: (bag, window, a)."""
    top = attention.groupBy(bag).agg(F.max("a").alias("__top"))
    w = attention.join(top, bag).withColumn("w", F.exp(F.col("a") - F.col("__top"))).select(bag, window, "w")
    return x.join(w, [bag, window]).groupBy(bag, "dim").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("pooled"))


def vector(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Back to one array per key, by dimension."""
    at = F.sort_array(F.collect_list(F.struct("dim", F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(at, lambda e: e["x"]).alias(name))


def input_vector(modalities: tuple[str, ...]):
    """One array: mean, deviation and coverage of each modality, in the modalities' order (columns <name>_mean, _std,
    _cover)."""
    return F.concat(*(F.col(f"{m}_{part}") for m in modalities for part in ("mean", "std", "cover")))


def window_row(modalities: tuple[str, ...]):
    """One window's values of all modalities, in their order."""
    return F.concat(*map(F.col, modalities))
