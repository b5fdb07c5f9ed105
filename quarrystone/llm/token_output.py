"""Token ids as fixed-width bit-packed shards with block offsets.

A shard is one file:

    magic "QTK1", bits (u8), 3 bytes of zero, documents (u64), tokens (u64), tokens a block (u32), blocks (u32)
    document ids (i64 each), whether an id is known (u8 each), tokens of each document (i64 each)
    start of each block in the file (u64 each, and the end)
    blocks: ids in big-endian order, ``bits`` bits each, the last byte of a block filled with zeros

Any span of tokens is read by its blocks alone; a block is unpacked by one numpy call.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, one_by_one, partitions, single_thread, tidy, whole
from .token_counts import read_config

MAGIC = b"QTK1"
HEAD = struct.Struct("<4sB3xQQII")
BLOCK_TOKENS = 8192
SHARD_TOKENS = 1 << 24


# --- packing -------------------------------------------------------------------------------------------------------
def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return np.ascontiguousarray(wide[:, 4 - bits // 8 :]).tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :].ravel()).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    wide = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        wide[:, 4 - bits // 8 :] = raw[: count * bits // 8].reshape(count, bits // 8)
    else:
        full = np.zeros((count, 32), np.uint8)
        full[:, 32 - bits :] = np.unpackbits(raw, count=count * bits).reshape(count, bits)
        wide = np.packbits(full, axis=1)
    return wide.view(">u4").ravel().astype(np.uint32)


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    n, blocks = len(doc_ids), -(-len(ids) // BLOCK_TOKENS)
    packed = [pack(ids[i * BLOCK_TOKENS : (i + 1) * BLOCK_TOKENS], bits) for i in range(blocks)]
    first = HEAD.size + n * 17 + (blocks + 1) * 8
    offsets = np.cumsum([first, *map(len, packed)]).astype("<u8")
    out = io.BytesIO()
    out.write(HEAD.pack(MAGIC, bits, n, len(ids), BLOCK_TOKENS, blocks))
    out.write(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
    out.write(np.array([i is not None for i in doc_ids], np.uint8).tobytes())
    out.write(np.array(lengths, "<i8").tobytes())
    out.write(offsets.tobytes())
    out.writelines(packed)
    return out.getvalue()


class Shard:
    """Reads a shard from a seekable file: its index at once, blocks as they are asked for."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.n_docs, self.n_tokens, self.block, self.blocks = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        ids = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        known = np.frombuffer(file.read(self.n_docs), np.uint8)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.offsets = np.frombuffer(file.read(8 * (self.blocks + 1)), "<u8")

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive), reading only their blocks."""
        stop = min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        self.file.seek(int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b] - self.offsets[a]))
        parts = []
        for k in range(a, b):
            count = min(self.block, self.n_tokens - k * self.block)
            parts.append(unpack(data[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])], self.bits, count))
        got = np.concatenate(parts)
        return got[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


# --- storage -------------------------------------------------------------------------------------------------------
def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _publish(folder: str, name: str, data: bytes) -> None:
    """Written under a name of its own, then moved: a task that runs twice leaves one whole file."""
    filesystem, root = _filesystem(folder)
    filesystem.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(own) as f:
        f.write(data)
    filesystem.move(own, f"{root}/{name}")


def open_shard(folder: str, name: str) -> Shard:
    filesystem, root = _filesystem(folder)
    return Shard(filesystem.open_input_file(f"{root}/{name}"))


# --- operator ------------------------------------------------------------------------------------------------------
def _shards(docs: DataFrame, bytes_each: int = 24 << 20) -> int:
    """Enough for shards of about bytes_each of stored input, by the planner's estimate (no pass over the data)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), -(-size // bytes_each) if size < 1 << 60 else 0)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards in ascending order of document id and returns their manifest (part, piece, name, documents, tokens, base).

    Null texts are empty (one end id); null ids come last; rows that repeat an id follow one another in the order of
    their texts' hashes. Rows are dealt by ranges of (id, hash, place), so that not even one id that a third of all
    rows share lands in one task. A shard holds at most about SHARD_TOKENS tokens (one document more at most).
    """
    spark = docs.sparkSession
    config = spark.sparkContext.broadcast(read_config(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at")
    )
    order = [F.col("doc_id").asc_nulls_last(), "h", "at"]
    dealt = rows.repartitionByRange(_shards(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, vocabulary = _encoder(config.value)
        bits = bits_for(max(vocabulary, end_id + 1))
        doc_ids, lengths, ids, held, piece = [], [], [], 0, 0
        end = np.array([end_id], np.uint32)

        def flush():
            name = f"shard-{part:08d}-{piece:04d}.qtk"
            _publish(folder, name, shard_bytes(doc_ids, lengths, np.concatenate(ids), bits))
            columns = {"part": (part, pa.int32()), "piece": (piece, pa.int32()), "name": (name, pa.string()), "documents": (len(doc_ids), pa.int64()), "tokens": (held, pa.int64())}
            return pa.record_batch([pa.array([v], kind) for v, kind in columns.values()], list(columns))

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), one_by_one(batch.column("text")), strict=True):
                got = encode(text)
                doc_ids.append(i)
                lengths.append(len(got) + 1)
                ids += (got, end)
                held += len(got) + 1
                if held >= SHARD_TOKENS:
                    yield flush()
                    doc_ids, lengths, ids, held, piece = [], [], [], 0, piece + 1
        if doc_ids:
            yield flush()

    dealt.mapInArrow(tidy(write), "part int, piece int, name string, documents long, tokens long").write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row a shard
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _encoder(config: str):
    from .wholetoken import encoder, is_wholetoken_config

    if is_wholetoken_config(config):
        e = encoder(config)
        return e.ids, e.library.get_vocab_size()
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(config)
    library.no_truncation()
    library.no_padding()
    return (lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)), library.get_vocab_size()


def read_index(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = open_shard(folder, name)
                ids = shard.span(0, shard.n_tokens).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    dealt = manifest.select("name", "base").repartition(partitions(spark), "name")
    return dealt.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(manifest_rows: list[tuple[str, int, int]], folder: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the whole corpus, from (name, base, tokens) rows of the manifest: only their blocks are read."""
    parts = []
    for name, base, tokens in sorted(manifest_rows, key=lambda r: r[1]):
        if base < stop and base + tokens > start:
            parts.append(open_shard(folder, name).span(max(0, start - base), min(tokens, stop - base)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, **more) -> DataFrame:
    """Writes all documents to shards and returns what is read back from them. An empty table gives no rows."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    return read_index(spark, write_tokens(docs, folder, tokenizer, **more), folder)
