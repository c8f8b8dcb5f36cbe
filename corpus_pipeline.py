"""From raw documents to packed training sequences: each stage keeps what the next one reads.

1. Language ID: documents without a recognisable language go.
2. Exact dedup: of texts equal but for white space one row stays.
3. SimHash near-dedup: of documents linked by their fingerprints at 2 or fewer differing bits, or beyond that by five-word
   shingles at a similarity of 0.8, the smallest doc_id stays.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. Packing: what is left becomes sequences of 2048 ids, with the ids of each piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import decontamination, exact_dedup, language_id, packing, simhash
from tallyfold.llm.common import short_batches


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return language_id.recognised_rows(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    near = simhash.all_copies(docs)
    return docs.join(near.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language id", drop_unknown_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written to the shared folder and read by the next."""
    from tallyfold.session import fresh_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = fresh_path(spark, "corpus-stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
