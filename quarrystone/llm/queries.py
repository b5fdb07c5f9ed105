"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, ngram_join
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .mixing import mix
from .ngram_join import ngram_components
from .pii import find_personal_data
from .quality import quality_scores
from .secrets import scan_secrets
from .token_counts import token_counts
from .token_output import token_output
from .toxicity import toxicity_scores

#: The tokenizer that the queries use; any .json or .model file will do.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), weight_cycle=(5, 2, 1), share=1.0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_documents(spark, sf_dir), tokenizer_path(), end_id=2)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), tokenizer_path(), limit=512)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_documents(spark, sf_dir), n=4, percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_source_mix, op2_decontaminate, op3_exact_dedup, op4_token_output, op5_personal_data, op6_secret_scan, op7_token_counts, op8_toxicity, op9_ngram_join, op10_quality)
}

ORACLE_SQL: dict[str, str] = {"op1_source_mix": mixing.ORACLE_SQL, "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op9_ngram_join": ngram_join.ORACLE_SQL}
