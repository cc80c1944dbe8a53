"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

quality (rule ensemble) drops what scores below the threshold; near_duplicates (HyperMinHash, five words, similarity 0.8)
keeps the smallest id of each group; repeated_passages (suffix arrays) cuts strings of 100 bytes and more that start
earlier; decontaminate (spaced seeds) drops documents with a benchmark passage; mix (Pfair) adds each document's slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import decontam, hyperminhash, mixing, quality, suffix_dedup
from scoreframe.llm.common import discard, read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = hyperminhash.near_duplicates(docs, n_words=5, percent=80).filter(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_texts(docs, least=100)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontaminate", drop_benchmark_passages),
    ("mix", mix_sources),
]

#: Trained rules, signatures and suffix arrays have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)  # the next stage reads only its predecessor's table
        before = docs
    return docs
