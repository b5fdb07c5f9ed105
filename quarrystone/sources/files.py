"""File and text sources."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf


def listed(spark: SparkSession, roots: dict[str, str], pattern: str = "*", recursive: bool = False) -> DataFrame:
    """role, path, size_bytes, modified of the files under each role's root (contents aren't read)."""
    out = None
    for role, root in roots.items():
        got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
        got = got.select(F.lit(role).alias("role"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
        out = got if out is None else out.unionByName(got)
    return out


class StatSource(DataSource):
    """path, size_bytes, modified_ns, device, inode of local files: what binaryFile rounds or lacks."""

    @classmethod
    def name(cls) -> str:
        return "filestat"

    def schema(self) -> str:
        return "path string, size_bytes long, modified_ns long, device long, inode long"

    def reader(self, schema) -> DataSourceReader:
        return _StatReader(self.options["path"])


class _StatReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(d) for d in sorted(d for d, _, files in os.walk(self.root) if files)] or [InputPartition(self.root)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for entry in os.scandir(partition.value):
            if entry.is_file(follow_symlinks=False):
                s = entry.stat(follow_symlinks=False)
                yield entry.path, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino


def records(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of "key = value" lines, parted by blank lines, as maps."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return blocks.select(F.str_to_map(F.regexp_replace("value", r"^\n+|\n+$", ""), F.lit("\n"), F.lit(" = ")).alias("record"))


@udtf(returnType="member string, depth int, size long, content binary")
class ArchiveMembers:
    """Leaves of a zip archive, nested ones expanded with provenance a!/b, up to 16 levels; metadata files left out."""

    def eval(self, name: str, content: bytes):
        queue = [(name, content, 0)]
        while queue:
            at, data, depth = queue.pop(0)
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in sorted(z.infolist(), key=lambda i: i.filename):
                    parts = info.filename.replace("\\", "/").split("/")
                    if info.is_dir() or "__MACOSX" in parts or any(p.startswith("._") for p in parts):
                        continue
                    if info.filename.startswith("/") or ".." in parts:
                        raise ValueError(f"unsafe member {info.filename}")
                    inner, path = z.read(info), f"{at}!/{info.filename}"
                    if info.filename.lower().endswith(".zip") and depth < 16:
                        queue.append((path, inner, depth + 1))
                    else:
                        yield path, depth, len(inner), inner


def strict_config(text: str, keys: set[str], most: int = 1 << 20) -> dict:
    """A JSON object of exactly these keys, none twice, at most 1 MiB."""
    if len(text.encode()) > most:
        raise ValueError("configuration too large")

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    got = json.loads(text, object_pairs_hook=once)
    if not isinstance(got, dict) or set(got) != keys:
        raise ValueError("unexpected keys")
    return got


PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,bit_rate:string,duration:string,tags:struct<rotate:string>>>,format:struct<size:string,bit_rate:string,duration:string>>"


def probed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Probe JSON -> codec, width, height, fps, duration, rotation, bit_rate (stream's, else container's, else from size)."""
    from ..functions.scalars import display_size, fraction, lenient, or_else

    x = df.withColumn("p", F.from_json(raw, PROBE)).withColumn("v", F.filter("p.streams", lambda s: s["codec_type"] == "video")[0])
    duration = F.coalesce(lenient(F.col("v.duration"), "double"), lenient(F.col("p.format.duration"), "double"))
    size = lenient(F.col("p.format.size"), "long")
    computed = F.when((size > 0) & (duration > 0), F.floor(size * 8 / duration)).cast("long")
    rate = or_else(lenient(F.col("v.bit_rate"), "long"), lenient(F.col("p.format.bit_rate"), "long"), computed)
    rotation = F.pmod(F.coalesce(lenient(F.col("v.tags.rotate"), "int"), F.lit(0)), F.lit(360))
    w, h = display_size(F.col("v.width"), F.col("v.height"), rotation)
    keep = [c for c in df.columns if c != raw]
    return x.select(*keep, F.col("v.codec_name").alias("codec"), w.alias("width"), h.alias("height"), fraction(F.col("v.avg_frame_rate")).alias("fps"), duration.alias("duration"), rotation.alias("rotation"), rate.alias("bit_rate"))


def device_rows(df: DataFrame, line: str = "value") -> DataFrame:
    """Device CSV lines "index, name, free MiB" -> typed columns; bad numbers are null."""
    p = F.split(line, r"\s*,\s*")
    return df.select(p[0].try_cast("int").alias("device"), p[1].alias("name"), F.regexp_extract(p[2], r"(\d+)", 1).try_cast("long").alias("free_mib"))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, host, path, title, links of raw HTML pages."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1).alias("path"), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(links).cast("long").alias("links"))
