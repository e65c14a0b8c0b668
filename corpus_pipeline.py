"""A training-corpus pipeline: toxicity, near duplicates, repeated strings, benchmark leaks, token ids.

Each stage takes what its predecessor kept, and each is written as Parquet and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import bpe_coding, classify, decontaminate, minhash_dedup, nbsvm, suffix_dedup
from fieldglass.llm.common import read_table, shared_dir, spread, text_column
from fieldglass.llm.queries import tokenizer_path

#: SQL can't express the classifier nor the tokenizer; tests compare stages with brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    scored = classify.classified(docs, read_table(spark, sf_dir, "labels"), "toxic", nbsvm.char_features, 0.5)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id, then text hash; rows equal in id and text count as one."""
    return minhash_dedup.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 400-byte strings that occur earlier in the corpus; a text may become empty, its row stays."""
    cut = suffix_dedup.remove_repeats(docs, keep_first=True, as_text=True).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text_column()).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the number of these."""
    return bpe_coding.encode(docs, tokenizer_path("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("suffix_dedup", drop_repeats), ("decontaminate", drop_leaks), ("bpe", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each one's result written to the shared folder."""
    docs, base = spread(read_table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
