"""Work queues as relations: deduplication, discovery, claims, admission, transition tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")

# The state machines as one table (machine, status, event, next, action).
TRANSITIONS = (
    ("video", "waiting_stable", "unchanged", "ready", "count_check"), ("video", "waiting_stable", "changed", "waiting_stable", "reset_checks"),
    ("video", "ready", "unchanged", "ready", "keep"), ("video", "ready", "changed", "waiting_stable", "reset_checks"),
    ("video", "failed", "unchanged", "failed", "keep"), ("video", "failed", "changed", "waiting_stable", "reset_checks"),
    ("video", "completed", "unchanged", "waiting_stable", "start_again"), ("video", "completed", "changed", "waiting_stable", "start_again"),
    ("video", "ready", "claim", "processing", "count_attempt"), ("video", "ready", "error", "failed", "record"),
    ("video", "processing", "prepared", "validating", "record_output"), ("video", "validating", "published", "cleanup_pending", "record_output"),
    ("video", "cleanup_pending", "cleaned", "completed", "clear_error"),
    ("video", "processing", "error", "failed", "record"), ("video", "validating", "error", "failed", "record"), ("video", "cleanup_pending", "error", "failed", "record"),
    ("image", "waiting_stable", "unchanged", "ready", "count_check"), ("image", "waiting_stable", "changed", "waiting_stable", "reset_checks"),
    ("image", "waiting_stable", "gone", "failed", "record"), ("image", "ready", "claim", "moving", "count_attempt"),
    ("image", "moving", "moved", "processing", "record_start"), ("image", "processing", "compressed", "publishing", "record_manifest"),
    ("image", "publishing", "published", "cleanup_pending", "record_output"), ("image", "cleanup_pending", "cleaned", "completed", "clear_error"),
    ("image", "failed", "retry", "processing", "count_attempt"),
    ("image", "moving", "error", "failed", "record"), ("image", "processing", "error", "failed", "record"), ("image", "publishing", "error", "failed", "record"),
    ("image", "cleanup_pending", "error", "failed", "record"), ("image", "cleanup_pending", "io_error", "cleanup_pending", "record"),
    ("download", "0", "imported", "1", "prepare"), ("download", "1", "imported", "1", "renew"), ("download", "4", "imported", "1", "renew"),
    ("download", "1", "claim", "2", "submit"), ("download", "2", "rejected", "4", "record"), ("download", "2", "file_exists", "9", "finish"),
    ("transfer", "planned", "staged", "destination_verified", "commit"), ("transfer", "planned", "foreign_staging", "conflict", "hold"),
    ("transfer", "destination_verified", "linked", "published", "track"), ("transfer", "published", "cleaned", "source_cleaned", "finish"),
    ("transfer", "published", "changed", "conflict", "hold"),
)


def transitioned(rows: DataFrame, machine: str) -> DataFrame:
    """Adds next and action; what the table doesn't know stays and is rejected."""
    table = rows.sparkSession.createDataFrame([t[1:] for t in TRANSITIONS if t[0] == machine], "status string, event string, next string, action string")
    got = rows.join(F.broadcast(table), ["status", "event"], "left")
    return got.withColumn("action", F.coalesce("action", F.lit("reject"))).withColumn("next", F.coalesce("next", "status"))


def claimed(tasks: DataFrame, order: list[str], running: Column, caps: dict[str, int]) -> DataFrame:
    """Queued tasks that the caps of their kind admit, first come first served: as many of each kind as the cap leaves
    beside those that run, found by a top-k a kind (kinds are those of caps)."""
    busy = {r["kind"]: r["n"] for r in tasks.where(running).groupBy("kind").agg(F.count("*").alias("n")).where(F.col("kind").isin(*caps)).collect()}
    out = tasks.where("false")
    for kind, most in caps.items():
        room = most - busy.get(kind, 0)
        if room > 0:
            out = out.unionByName(tasks.where((F.col("status") == "queued") & (F.col("kind") == kind)).orderBy(*order).limit(room))
    return out


def compare_and_set(rows: DataFrame, row_id: str, wanted: DataFrame, old: str, new: str) -> DataFrame:
    """wanted (ids) whose status is old become new; won tells which did. One writer at a time."""
    w = wanted.select(row_id).distinct().withColumn("__w", F.lit(True))
    got = rows.join(w, row_id, "left")
    won = F.coalesce(F.col("__w"), F.lit(False)) & (F.col("status") == old)
    return got.withColumn("won", won).withColumn("status", F.when(won, F.lit(new)).otherwise(F.col("status"))).drop("__w")


def discovered(candidates: DataFrame, done: DataFrame, key: str, order: list[str], queued: int, limit: int) -> DataFrame:
    """Candidates without a row in done, up to what the queue has room for."""
    return candidates.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(max(0, limit - queued))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))


def admission(leases: DataFrame, free_mib: int, reserve_mib: int, caps: dict[str, int]) -> DataFrame:
    """Each waiting lease's decision on its own: admitted, or the first reason against it.

    leases: id, device, workload, mode, status, created, budget_mib, observed_mib. Pending memory is what active leases
    may still take, and the earliest waiting encoder's budget while none is active.
    """
    active, waiting = F.col("status") == "active", F.col("status") == "waiting"
    pool = Window.partitionBy("device")
    ahead = Window.partitionBy("device").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, -1)
    encoder = (F.col("workload") == "compression") & (F.col("mode") == "shared")
    x = leases.withColumns({
        "pending": F.coalesce(F.sum(F.when(active, F.greatest(F.lit(0), F.col("budget_mib") - F.col("observed_mib")))).over(pool), F.lit(0)),
        "same": F.count_if(active & (F.col("mode") == "shared")).over(Window.partitionBy("device", "workload")),
        "conflicts": F.count_if(F.col("status") == "conflict").over(pool),
        "exclusive": F.count_if(active & (F.col("mode") != "shared")).over(pool),
        "exclusive_ahead": F.coalesce(F.bool_or(waiting & (F.col("mode") != "shared")).over(ahead), F.lit(False)),
        "encoder_active": F.coalesce(F.bool_or(active & encoder).over(pool), F.lit(False)),
        "encoder_ahead": F.first(F.when(waiting & encoder, F.col("budget_mib")), ignorenulls=True).over(ahead),
    })
    pending = F.col("pending") + F.when((F.col("workload") != "compression") & ~F.col("encoder_active"), F.coalesce("encoder_ahead", F.lit(0))).otherwise(0)
    cap = F.coalesce(*(F.when(F.col("workload") == k, F.lit(n)) for k, n in caps.items()), F.lit(0))
    reason = F.coalesce(
        first_reason(
            ("lease_conflict", F.col("conflicts") > 0), ("exclusive_active", F.col("exclusive") > 0), ("exclusive_waiting", F.col("exclusive_ahead")),
            ("capacity_full", F.col("same") >= cap), ("memory_insufficient", F.lit(free_mib) - pending < F.col("budget_mib") + reserve_mib),
        ),
        F.lit("admitted"),
    )
    return x.where("status = 'waiting'").select("id", "device", "workload", pending.cast("long").alias("pending_mib"), (F.lit(free_mib) - pending).cast("long").alias("usable_mib"), reason.alias("reason"))


def backed_off(budget_mib: Column, oom: Column) -> Column:
    """Half as much again after running out of memory."""
    return F.when(oom, F.floor(budget_mib * 1.5)).otherwise(budget_mib).cast("long")
