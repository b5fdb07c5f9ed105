"""Time windows, deduplication and cursors over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import _folder


def tumbling(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of value by tumbling window; windows close when the watermark passes them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def once(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first event of each key; a key's state is dropped when the watermark passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def replayed(stream: DataFrame, sink: str, checkpoint: str, usable) -> None:
    """Cursor consumption: each micro-batch hands on its rows before the first that can't be interpreted (usable is a
    Column over them); what is held back is recorded beside them under the batch's epoch."""
    from ..operators.lineage import held_prefix

    def consume(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        done = held_prefix(batch, usable)
        done.write.mode("overwrite").parquet(f"{sink}/consumed/epoch={epoch}")
        batch.join(done.select("id"), "id", "left_anti").write.mode("overwrite").parquet(f"{sink}/held/epoch={epoch}")
        batch.unpersist()

    stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbled_to_table(sf_dir: str, spark: SparkSession) -> DataFrame:
    """The events table as a stream of daily windows, complete mode, read back."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    sink, checkpoint = _folder(spark, "windows"), _folder(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(source) if _is_folder(spark, source) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    tumbling(rows, "ts", "1 day", "1 day", "event_type").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
