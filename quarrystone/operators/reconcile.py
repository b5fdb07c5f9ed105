"""Directory reconciliation: a full snapshot against tracked state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled(snapshot: DataFrame, state: DataFrame, scan_at: str, stable_s: int, missing_s: int, complete: bool = True, uncertain: bool = False) -> DataFrame:
    """New state and what happened, by path_key.

    snapshot: path_key, role, size_bytes, modified_ns, content. state: the same, with stable_since, missing_since,
    status. A file is stable when its fingerprint hasn't changed for stable_s; a known content under a new path moved;
    an unseen file is missing, after missing_s it matures (a negative label). An incomplete scan takes nothing away; an
    uncertain one (lost notifications) retires instead of reporting missing.
    """
    now = F.lit(scan_at).cast("timestamp_ntz")
    fingerprint = ["size_bytes", "modified_ns", "content"]
    s = snapshot.select("path_key", F.col("role").alias("new_role"), F.struct(*fingerprint).alias("new"))
    o = state.select("path_key", "role", F.struct(*fingerprint).alias("old"), "stable_since", "missing_since", "status")
    known = state.where("status = 'present'").select(F.col("content").alias("__content"), F.col("path_key").alias("moved_from"))
    seen = snapshot.select(F.col("path_key").alias("__p"))
    moved = known.join(seen, F.col("moved_from") == F.col("__p"), "left_anti").groupBy("__content").agg(F.min("moved_from").alias("moved_from"))
    j = s.join(o, "path_key", "full_outer").join(moved, F.col("new.content") == F.col("__content"), "left")
    same = F.col("new").eqNullSafe(F.col("old"))
    stable_since = F.when(F.col("new").isNull(), F.col("stable_since")).when(same, F.col("stable_since")).otherwise(now)
    stable = F.timestamp_diff("SECOND", stable_since, now) >= stable_s
    gone = F.col("new").isNull()
    missing_since = F.when(gone & F.lit(complete), F.coalesce("missing_since", now))
    mature = F.timestamp_diff("SECOND", missing_since, now) >= missing_s
    change = (
        F.when(gone & F.lit(not complete), F.lit("unknown")).when(gone & F.lit(uncertain), F.lit("retired"))
        .when(gone & mature, F.lit("negative")).when(gone, F.lit("missing"))
        .when(F.col("old").isNull() & F.col("moved_from").isNotNull() & F.lit(complete), F.lit("moved")).when(F.col("old").isNull(), F.lit("arrived"))
        .when(~same, F.lit("changed")).when(stable, F.lit("stable")).otherwise(F.lit("settling"))
    )
    return j.select("path_key", F.coalesce("new_role", "role").alias("role"), F.coalesce("new", "old").alias("f"), stable_since.alias("stable_since"), missing_since.alias("missing_since"), change.alias("change"), F.when(F.col("old").isNull(), F.col("moved_from")).alias("moved_from")).select("path_key", "role", "f.*", "stable_since", "missing_since", "change", "moved_from")
