"""What the operators of this subpackage share: shared storage, text rules, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links from which on a node is a hub, whose links aren't dealt by node; and how many hubs there can be (24 bytes each).
HUB_LINKS, MOST_HUBS = 1_000, 100_000
#: Links that one task joins (16 bytes each); while there are more, they are dealt by node, round by round.
TASK_LINKS = 1 << 20
#: Links from which on each round's shuffles leave the disk before the next.
RELEASE_LINKS = 1 << 20
#: ASCII white space; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master only, a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Written once to the shared folder; later reads survive lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lower_ascii(col):
    """A-Z only, as the contracts say; lower() would change other letters too."""
    return F.translate(col, UPPER, LOWER)


def whole(col):
    """A null text counts as empty."""
    return F.coalesce(col, F.lit(""))


def tidy(task):
    """A mapInArrow function that keeps library thread pools off and, when its task is done, returns memory to the
    system: idle Python workers stay with the executor and would hold it."""

    def run(batches):
        single_thread()
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def slices(batches, rows: int = 1_000):
    """Arrow batches a few rows at a time, so that what is filtered out of one is small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def one_by_one(column):
    """The values of an Arrow column, never all at once as Python objects."""
    return (x.as_py() for x in column)


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def local_rows(spark: SparkSession, rows: list[tuple], kind: dict[str, pa.DataType]) -> DataFrame:
    """A few rows of the driver, planned as they are. From a plain list they would be read by Python workers of another
    kind than those of Arrow batches, which executors keep beside these, with a daemon of their own."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.table({name: pa.array(c, t) for (name, t), c in zip(kind.items(), columns, strict=True)}))


def by_key(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with known (key, count and others; one row a key), where count tells how many rows a key has: the most frequent keys are
    broadcast, so that their rows stay where they lie; the others' rows are dealt by key."""
    total = known.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) >= max(HUB_LINKS, total // MOST_HUBS)  # so at most MOST_HUBS keys
    hot = F.broadcast(known.where(frequent))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(~frequent), key)
    return rows.join(hot, key).unionByName(rest)


def parted_by(rows: DataFrame, own: Column, ids: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose own id, a long, is among ids, a column of distinct ones; the other rows, those without an id too).

    Texts of other rows than those sought aren't dealt, however many the ids: what is broadcast are masks of 64 ids that
    follow one another. More than ``most`` of these (sparse ids) are masks of hashes instead, ``most`` at most; then only
    rows that meet a mask are joined by a shuffle, which settles the few that meet one by chance.
    """
    ids = ids.toDF("__id")

    def masks(place: str) -> DataFrame:
        at = ids.select(F.expr(f"shiftright({place}, 6)").alias("__at"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))").alias("__bit"))
        return checkpoint(at.groupBy("__at").agg(F.bit_or("__bit").alias("__mask")))

    place = "__id"
    held = masks(place)
    exact = held.count() <= most
    if not exact:
        place = f"pmod(xxhash64(__id), {64 * max(1, most)}L)"
        held = masks(place)
    met = rows.withColumn("__id", own).withColumn("__at", F.expr(f"shiftright({place}, 6)")).join(F.broadcast(held), "__at", "left")
    met = met.withColumn("__met", F.expr(f"__id IS NOT NULL AND coalesce(__mask & shiftleft(1L, cast({place} & 63 AS int)) <> 0, false)"))
    inside, outside = (met.where(F.col("__met") == x).select("__id", *(met[c] for c in rows.columns)) for x in (True, False))
    if not exact:
        inside, outside = inside.join(ids, "__id", "left_semi"), outside.unionByName(inside.join(ids, "__id", "left_anti"))
    return inside.drop("__id"), outside.drop("__id")


def release_shuffles(spark: SparkSession) -> None:
    """Files of shuffles whose results are checkpointed leave the disk only when the driver has collected the plans that
    refer to them, which a driver with free memory may not do for long. Where they are large it is asked to: four times,
    as Spark itself lets go of a plan somewhat later, and on while that helps."""
    import gc
    import time

    sc = spark.sparkContext
    shuffles = sc._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    for k in range(10):
        before = shuffles.size()
        gc.collect()
        sc._jvm.System.gc()
        time.sleep(0.4)
        if not before or k >= 3 and shuffles.size() == before:
            break


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def single_thread() -> None:
    """Python workers share an executor's cores: library thread pools stay off."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes with fewer edges: every node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        for ends in (u, v, label[u], label[v]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _task_stars(limit: int):
    """(a, b) -> (a, b): what a task holds as stars, at most limit links at a time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, amount = [], 0

        def out(a, b):
            for i in range(0, len(a), 50_000):
                yield pa.record_batch([pa.array(x[i : i + 50_000], pa.int64()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            amount += batch.num_rows
            if amount > limit:
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                amount = len(held[0][0])
                if 2 * amount > limit:
                    yield from out(*held[0])
                    held, amount = [], 0
        if held:
            yield from out(*stars(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return joined


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), all of them -> (node, component)."""
    held = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if held:
        node, component = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        least = np.unique(component)
        node, component = np.concatenate([node, least]), np.concatenate([component, least])
        for i in range(0, len(node), 50_000):
            yield pa.record_batch([pa.array(x[i : i + 50_000], pa.int64()) for x in (node, component)], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) of long -> (node, component): the smallest node that links reach. Nodes without links are left out.

    Alternating large-star and small-star rounds: each round is a few aggregations over at most as many edges as
    before and is checkpointed once, and no adjacency list is ever gathered (the minimum of a neighbourhood is an
    ordinary partially aggregated min), so a hub that links a third of all rows does not land in one task: hubs' minima
    are broadcast and their links stay where they lie. Each task first makes stars of its links, and at most TASK_LINKS
    of them are joined in one task without any round: a round's shuffles leave three files a task each, however few
    the links are. Edges that Python made are checkpointed before: in one stage with them, each task would run
    two Python workers, and executors keep all workers that they ever ran at once.
    """
    pairs = checkpoint(edges.where("a <> b").select("a", "b").mapInArrow(tidy(_task_stars(TASK_LINKS)), "a long, b long")).toDF("u", "v")
    last = None
    for _ in range(max_rounds):
        # settled when a round changes nothing
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if state[0] <= TASK_LINKS:
            return checkpoint(pairs.toDF("a", "b").coalesce(1).mapInArrow(tidy(_one_task), "node long, component long"))
        if state == last:
            break
        last = state
        # large star: the larger neighbours of each node go to the least of its neighbourhood
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count("*").alias("n"))
        hub = F.col("n") >= max(HUB_LINKS, 2 * state[0] // MOST_HUBS)  # so at most MOST_HUBS hubs
        larger, hubs = both.where("y > x"), F.broadcast(least.where(hub).select("x", "m"))
        rest = larger.join(hubs, "x", "left_anti").join(least.where(~hub).select("x", "m"), "x")
        large = larger.join(hubs, "x").select("x", "y", "m").union(rest.select("x", "y", "m")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of each node, and the node, go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_least.select("u", F.col("m").alias("v")))
        pairs = checkpoint(small.distinct())
        del both, least, hubs, larger, rest, large, small_least, small
        if state[0] >= RELEASE_LINKS:
            release_shuffles(edges.sparkSession)
    else:
        raise RuntimeError("links did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v"))).distinct()
