"""Missions of files: recovery decisions, retries, conflicts, reset targets, shares of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recovered(status: Column, source: Column, output: Column, staging: Column, same: Column, valid: Column) -> Column:
    """What an interrupted video mission becomes, by which of its files exist, whether staging is the same file as the
    output, and whether the file that would be delivered validates. Other statuses stay."""
    foreign = output & staging & ~same
    published = F.when(~output | foreign | ~valid, "failed").otherwise("completed")
    owned = F.when(~staging | ~same | ~valid, "failed").otherwise("cleanup_pending")
    processing = F.when(~source, published).when(output, owned).when(staging & valid, "validating").otherwise("ready")
    validating = (
        F.when(~source, published).when(~staging & output, "failed").when(~staging, "ready").when(foreign | ~valid, "failed").otherwise("cleanup_pending")
    )
    return F.when(status == "processing", processing).when(status == "validating", validating).when(status == "cleanup_pending", published).otherwise(status)


def retryable(missions: DataFrame, exact: tuple[str, ...], prefixes: tuple[str, ...], bounded: tuple[tuple[str, str], ...]) -> DataFrame:
    """Failed missions without a code whose message is one of ``exact``, begins with a prefix, or begins with and
    contains the two parts of a pair."""
    m = F.col("error_message")
    known = m.isin(*exact)
    for p in prefixes:
        known |= m.startswith(p)
    for p, part in bounded:
        known |= m.startswith(p) & m.contains(part)
    return missions.where((F.col("status") == "failed") & F.col("error_code").isNull() & known)


def destination_conflicts(missions: DataFrame) -> DataFrame:
    """missions (id, name, scope, own_scope, status) with the least other mission that has not failed and has the same
    normalised name: one bound to the mission's scope, else a historical one (no scope) whose own folder is that scope.

    The two least ids of each (name, scope) are enough, so no pairs are made.
    """
    live = missions.where("status <> 'failed'")

    def least(rows: DataFrame, scope: str, to: str) -> DataFrame:
        first = rows.groupBy("name", F.col(scope).alias("scope")).agg(F.min("id").alias("x"))
        rest = rows.withColumn("scope", F.col(scope)).join(first, ["name", "scope"]).where("id <> x").groupBy("name", "scope").agg(F.min("id").alias("y"))
        return first.join(rest, ["name", "scope"], "left").select("name", "scope", F.array("x", "y").alias(to))

    bound = least(live.where("scope IS NOT NULL"), "scope", "bound")
    past = least(live.where("scope IS NULL AND own_scope IS NOT NULL"), "own_scope", "past")
    other = lambda c: F.get(F.filter(c, lambda x: x.isNotNull() & (x != F.col("id"))), F.lit(0))
    got = missions.join(bound, ["name", "scope"], "left").join(past, ["name", "scope"], "left")
    return got.withColumn("conflict_id", F.coalesce(other("bound"), other("past"))).drop("bound", "past")


def without_leases(tasks: DataFrame, leases: DataFrame, task_id: str) -> DataFrame:
    """Tasks that no unreleased lease is owned by: owner is the id, or begins with 'filter:', the id and a colon. The id
    is cut out of the owner, so that the anti join has an equal key."""
    owner = F.col("owner")
    of = F.when(owner.startswith("filter:") & (F.size(F.split(owner, ":")) > 2), F.split(owner, ":")[1]).otherwise(owner)
    held = leases.where("status <> 'released'").select(F.explode(F.array_distinct(F.array(of, owner))).alias("__id")).distinct()
    return tasks.join(held, F.col(task_id).cast("string") == F.col("__id"), "left_anti")


def unless_any(rows: DataFrame, blocking: DataFrame) -> DataFrame:
    """All rows, or none if there is a blocking row."""
    flag = blocking.agg((F.count("*") == 0).alias("__free"))
    return rows.join(F.broadcast(flag), F.col("__free")).drop("__free")


def updated_from(rows: DataFrame, targets: DataFrame, key: str, still: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows with ``changes`` where targets holds their key and ``still`` holds; returned tells which."""
    t = targets.select(key).distinct().withColumn("__t", F.lit(True))
    hit = F.coalesce(F.col("__t"), F.lit(False)) & F.coalesce(still, F.lit(False))
    got = rows.join(t, key, "left").withColumn("returned", hit)
    return got.withColumns({c: F.when(F.col("returned"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__t")


def turn(names: DataFrame, order: str, shift: int, remaining: int) -> DataFrame:
    """names in rotated order: place, and the share ceil(remaining / (n - place)) each may take if those before took
    nothing. For a handful of configured groups."""
    n = names.agg(F.count("*").alias("n"))
    x = names.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1).join(F.broadcast(n))
    place = F.pmod(F.col("__i") - F.lit(shift), F.col("n"))
    return x.withColumn("place", place).withColumn("share", F.ceil(F.lit(remaining) / (F.col("n") - place)).cast("long")).drop("__i", "n")


def rotating_page(rows: DataFrame, order: list[str], offset: int, size: int = 100) -> tuple[DataFrame, int]:
    """A page at offset, and where the next one begins: 0 after a short page."""
    page = rows.orderBy(*order).offset(offset).limit(size)
    return page, offset + size if page.count() == size else 0


def bounded_page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page with next_offset (offset and the page's length); limits outside 1..100 and offsets below 0 are errors."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("invalid_page")
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("next_offset", F.lit(offset) + F.count("*").over(Window.partitionBy(F.lit(0))))


def pending(events: DataFrame, after: int, floor: int, scope: Column) -> DataFrame:
    """One row: whether any event of the scope lies beyond the watermark."""
    first = events.where((F.col("event_id") > max(after, floor)) & scope).select("event_id").limit(1)
    return first.agg((F.count("*") > 0).alias("pending"))


def compatible_batch(batches: DataFrame, predictions: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """(key, batch_id) of the newest batch of each key in which every model has a finite score of 0 to 1 under the
    threshold it has now."""
    total = models.agg(F.count("*").alias("__n"))
    good = predictions.where("score >= 0 AND score <= 1").join(F.broadcast(models), ["model_id", "threshold"])
    whole = good.groupBy("batch_id").agg(F.countDistinct("model_id").alias("__found")).join(F.broadcast(total), F.col("__found") == F.col("__n")).select("batch_id")
    fit = batches.join(whole, "batch_id")
    return fit.groupBy(key).agg(F.max_by("batch_id", F.struct("created_at", "batch_id")).alias("batch_id"))


def roles_by_folder(files: DataFrame, roles: DataFrame, path: str) -> DataFrame:
    """files with the role of the folder they lie in directly (first of roles' order); others are outside the scope."""
    parent = F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1)
    first = roles.groupBy("folder").agg(F.min_by("role", "place").alias("role"))
    return files.withColumn("__p", parent).join(F.broadcast(first.withColumnRenamed("folder", "__p")), "__p", "left").drop("__p")


def nested_paths(paths: DataFrame, row_id: str, path: str) -> DataFrame:
    """(outer_id, inner_id) of rows whose path equals or lies in another row's path: each path's ancestors are looked up,
    so no pairs are tried. Equal paths come once, the lesser id as outer."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inner = paths.select(F.col(row_id).alias("inner_id"), F.regexp_replace(path, "/+$", "").alias("own"), F.explode(F.array_distinct(up)).alias("p"))
    outer = paths.select(F.col(row_id).alias("outer_id"), F.regexp_replace(path, "/+$", "").alias("p"))
    met = inner.where("p <> ''").join(outer, "p")
    return met.where("(own <> p AND inner_id <> outer_id) OR (own = p AND outer_id < inner_id)").select("outer_id", "inner_id")


def stable_after(rows: DataFrame, key: str, order: str, values: list[str], checks: int = 1) -> DataFrame:
    """Adds stable: the last ``checks`` observations before this one had the same values."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values)) & F.lag(F.lit(1)).over(w).isNotNull()
    run = F.min(F.col("__same").cast("int")).over(w.rowsBetween(1 - checks, 0))
    return rows.withColumn("__same", same).withColumn("stable", (run == 1) & (F.row_number().over(w) > checks)).drop("__same")


def overlapping_stamps(rows: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """Adds overlaps: the row begins more than one before the end of its predecessor."""
    before = F.lag(F.col(start) + F.col(length)).over(Window.partitionBy(key).orderBy(start, length))
    return rows.withColumn("overlaps", F.coalesce(F.col(start) < before - 1, F.lit(False)))


def enough_of_each(rows: DataFrame, label: str, least: int) -> DataFrame:
    """One row: how many positives and negatives there are, and whether either is too few."""
    one, none = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.agg(one.alias("positives"), none.alias("negatives"), ((one >= least) & (none >= least)).alias("enough"))


def binned_choice(rows: DataFrame, key: str, place: str, count: Column, most: int, draw: Column) -> DataFrame:
    """Of keys with more than ``most`` rows (places 0 to count - 1), one row of each of ``most`` bins of equal width: the
    one with the least draw. Keys with fewer keep all."""
    # bin b covers places floor(b * count / most) to floor((b + 1) * count / most) - 1
    bin_ = F.floor(((F.col(place) + 1) * most - 1) / count)
    x = rows.withColumn("__n", count).withColumn("__bin", F.when(F.col("__n") > most, bin_).otherwise(F.col(place))).withColumn("__draw", draw)
    first = F.row_number().over(Window.partitionBy(key, "__bin").orderBy("__draw", place))
    return x.withColumn("__first", first).where("__first = 1").drop("__n", "__bin", "__draw", "__first")


def merged(defaults: Column, given: Column) -> Column:
    """A map with the entries of both; given ones win."""
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))), F.map_entries(given))))
