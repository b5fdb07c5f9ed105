"""Token counts with the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_thread, whole


def read_config(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is a .json file (tokenizers library) or a .model file (sentencepiece), read on the driver and
    broadcast. Null and empty texts have no tokens; null ids and repeated rows pass through. No shuffle: one pass of
    Arrow batches over (id, text).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    if tokenizer.endswith(".model"):
        with open(tokenizer, "rb") as f:
            config = spark.sparkContext.broadcast(f.read())
    else:
        config = spark.sparkContext.broadcast(read_config(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        of = _counter(config.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = pa.array([of(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _counter(config):
    if isinstance(config, bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=config)
        return lambda text: len(model.encode(text))
    from .wholetoken import counter, is_wholetoken_config

    if is_wholetoken_config(config):
        return counter(config).count
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(config)
    library.no_truncation()
    library.no_padding()
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)
