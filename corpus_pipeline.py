"""A corpus pipeline over `documents`: language, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.llm.decontaminate import find_passages
from groundshift.llm.langid import fit_languages, fold, identify
from groundshift.llm.neardup import drop_near_duplicates
from groundshift.llm.packing import encode_queues, pack
from groundshift.llm.queries import TOKENIZER
from groundshift.llm.secrets import redact
from groundshift.llm.tables import file_rows, free_name, shared_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing `lang` takes the prediction."""
    labelled = docs.filter(fold(F.col("doc_id")) != 0).select("lang", "text", F.col("doc_id").alias("key"))
    judged = identify(docs, fit_languages(labelled), keep=tuple(docs.columns)).filter(~F.col("rejected"))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by file and row, so ids may be null or repeat."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = free_name(docs, "row_number")
    located = file_rows(docs, row)
    leaked = find_passages(located, benchmark, id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return located.join(leaked, row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by the name of its kind; `n_chars` follows the new text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, mixed in proportion to the sources."""
    return pack(encode_queues(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

# Neither the learned language model nor tokens can be had in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; every stage's rows are written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
