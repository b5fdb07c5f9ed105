"""Keyed state over event logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT, STATE = "user_id long, revision long, label long", "revision long, label long, last long"


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each event raises its key's revision by one; the label is that of the largest event id so far, in whatever
    order batches and frames come."""
    revision, label, last = state.get if state.exists else (0, None, -1)
    for df in frames:
        revision += len(df)
        newest = df.loc[df["event_id"].idxmax()]
        if newest["event_id"] > last:
            label, last = int(newest["label"]), int(newest["event_id"])
    state.update((revision, label, last))
    yield pd.DataFrame({"user_id": [key[0]], "revision": [revision], "label": [label]})


def folded(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession, name: str) -> str:
    """In the shared folder that spark.checkpoint.dir names; on a local master without it, a temporary one."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folded_to_table(log: DataFrame, spark: SparkSession, batches: int = 3) -> DataFrame:
    """Replays a log through the stream in ``batches`` files, in order of event, and returns the last state by key.

    Every micro-batch appends the keys it changed (foreachBatch, named by its epoch, so a repeated batch overwrites
    itself); a reader takes the largest revision.
    """
    from pyspark.sql import functions as F

    source, sink, checkpoint = (_folder(spark, n) for n in ("log", "state", "stream"))
    log.repartitionByRange(batches, "event_id").write.parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    q = folded(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).groupBy("user_id").agg(F.max("revision").alias("revision"), F.max_by("label", "revision").alias("label"))
