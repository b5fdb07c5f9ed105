"""Positions of all matches of a pattern, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def match_spans(text: Column, pattern: Column | str) -> Column:
    """array<struct<start:int, end:int, value:string>> of the leftmost non-overlapping matches, in code points.

    The pieces between matches (split) and the matches (regexp_extract_all) alternate, so positions are running sums
    of their lengths. Sums run within chunks first, then over chunks: work grows as n * CHUNK + (n / CHUNK)^2 for n
    matches, not as n^2. The pattern must not match empty text.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    item = "struct<start:int,end:int,value:string>"

    def chunk(c: Column) -> Column:
        pairs = F.arrays_zip(
            F.slice(between, c * CHUNK + 1, CHUNK).alias("gap"),
            F.slice(found, c * CHUNK + 1, CHUNK).alias("value"),
        )
        real = F.filter(pairs, lambda p: p["value"].isNotNull())
        return F.aggregate(
            real,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out")),
            lambda a, p: F.struct(
                (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p["gap"])).alias("start"), (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("end"), p["value"].alias("value")))).alias("out"),
            ),
        )

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))), chunk)
    total = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item}>>").alias("out")),
        lambda a, c: F.struct(
            (a["at"] + c["at"]).alias("at"),
            F.concat(a["out"], F.array(F.transform(c["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value"))))).alias("out"),
        ),
    )
    return F.flatten(total["out"])


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")
