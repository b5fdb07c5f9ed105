"""Exact duplicates by a heavy-hitter split (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, whole


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The row with the largest id stays
    (null ids come last; rows that repeat an id as well are told apart by their place in the scan, so exactly one row
    of a group stays).

    A Misra-Gries pass (``freqItems``) yields at most 1/support digests, which include every digest above that share
    of the rows. Their exact sizes and winners come from one partially aggregated pass and are broadcast (at most
    1/support rows), so rows of heavy groups are settled where they lie. All other groups have at most
    support * rows members and go through one ordinary shuffle of (id, digest), never of texts.
    """
    rows = checkpoint(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(lower_ascii(whole(F.col(text_col))), 256)).alias("digest"),
        ).withColumn("at", F.monotonically_increasing_id())
    )
    keyed = rows.withColumn("h", F.xxhash64("digest"))
    frequent = keyed.select("h").freqItems(["h"], support).first()[0] or []
    best = F.max(F.struct("doc_id", "at")).alias("best")
    heavy = (
        keyed.where(F.col("h").isin(*frequent) if frequent else F.lit(False))
        .groupBy("digest").agg(best, F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    heavy = F.broadcast(checkpoint(heavy))
    settled = rows.join(heavy, "digest")
    own = Window.partitionBy("digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").select(
        "digest", "doc_id", "at", F.max(F.struct("doc_id", "at")).over(own).alias("best"), F.count("*").over(own).alias("group_size")
    )
    return settled.select("digest", "doc_id", "at", "best", "group_size").union(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("best.at") == F.col("at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""
