"""File relations: digests of directories, output names, archive members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import assign_names


def manifest(files: DataFrame, scope: str, path: str, size: str, stamp: str) -> DataFrame:
    """Per scope: files, bytes, and the digest of "path NUL size NUL stamp LF" lines in order of path."""
    line = F.concat_ws("\0", path, F.col(size).cast("string"), F.col(stamp).cast("string"))
    lines = F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l"))))
    text = F.concat(F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), F.lit("\n"))
    return files.groupBy(scope).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"), F.sha2(text, 256).alias("digest"))


def content_copies(files: DataFrame, row_id: str, content: str) -> DataFrame:
    """row_id, first_id (smallest id of the same content), copies: a digest shuffle, never of contents."""
    digests = files.select(row_id, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    groups = digests.groupBy("sha256").agg(F.min(row_id).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return digests.join(groups, "sha256").select(row_id, "sha256", "first_id", "copies")


def assigned_names(candidates: DataFrame) -> DataFrame:
    """candidates: scope, provenance, name. The name depends on all names assigned before it, so one task per scope."""
    return candidates.select("scope", "provenance", "name").groupBy("scope").applyInPandas(assign_names, "scope string, provenance string, name string, assigned string")


def member_budget(members: DataFrame, archive: str, order: list[str], size: str, most_members: int, most_bytes: int) -> DataFrame:
    """Adds the running number and bytes of an archive's members and whether both are within limits."""
    from pyspark.sql import Window

    w = Window.partitionBy(archive).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = members.withColumn("nth", F.count("*").over(w)).withColumn("upto", F.sum(size).over(w))
    return x.withColumn("within", (F.col("nth") <= most_members) & (F.col("upto") <= most_bytes))
