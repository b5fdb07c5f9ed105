"""From raw documents to packed token ids: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. ORACLE_SQL is None: compression distances, BM25 retrieval and byte-level BPE have no SQL form; tests
hold the stages against brute force instead (tests/llm/test_mix_and_pipeline.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import new_folder
from quarrystone.llm.decontaminate import without_contaminated
from quarrystone.llm.mixing import mixed_documents
from quarrystone.llm.ngram_join import keep_one, ngram_components
from quarrystone.llm.queries import tokenizer_path
from quarrystone.llm.token_output import token_output
from quarrystone.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return keep_one(docs, ngram_components(docs, n=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed_documents(docs, weight_cycle=(5, 2, 1), share=1.0)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed shards; doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return token_output(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", write_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
