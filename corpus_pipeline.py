"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Every stage works on all rows that its predecessor kept and passes on the
columns of ``documents``, except the last, which returns where each piece of a
document lies in the packed sequences.

Defined results: rows with a null text, or one without letters, go in the first
stage; rows with a null doc_id are documents like others, told apart by their
texts; of repeated rows, and of rows of one doc_id with several texts, one stays
after near-dedup; a null lang, source or n_chars changes nothing but that null
sources are a source of their own; very long texts go whole through all stages;
an empty table gives an empty result; extra columns are kept up to the last
stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import language, mixing, neardup, packing, privacy
from vectrail.llm.common import free_names, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    samples, weights = language.learn_samples(docs)
    told, score = free_names(docs.columns, "lang_pred", "score")
    return language.identify(docs, samples, weights, docs.columns, (told, score)).filter(F.col(told) != language.UNDETERMINED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced by their kinds; n_chars follows."""
    base, spans = free_names(docs.columns, "base", "spans")
    text = F.when(F.col("text").isNotNull(), privacy.redact(F.col("text"), F.col(spans)))
    clean = privacy.find_spans(docs, (base, spans)).withColumn("text", text)
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/vectrail-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Learned language models, hashes and tokenizers have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None
