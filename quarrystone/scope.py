"""Tenant scope: every read of a scoped table goes through scoped(), every write through assert_scope()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScopeError(ValueError):
    pass


def scoped(df: DataFrame, group: str | None, epoch: str | None) -> DataFrame:
    if group is None or epoch is None:
        raise ScopeError("a scoped table is read without a group")
    return df.where((F.col("dataset_group_id") == group) & (F.col("reset_epoch") == epoch))


def assert_scope(batch: DataFrame, group: str, epoch: str) -> DataFrame:
    """Fails at run time on the first row of another group or a stale epoch; rows pass through as they are."""
    inside = F.col("dataset_group_id").eqNullSafe(group) & F.col("reset_epoch").eqNullSafe(epoch)
    return batch.where(F.when(inside, True).otherwise(F.raise_error(F.lit("write outside the active scope")).cast("boolean")))
