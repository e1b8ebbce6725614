"""A training corpus from raw documents: one operator after the other.

Each stage takes (spark, docs, sf_dir) and returns what is left of the
documents, with their columns; the last one returns their tokens. Every stage
works on all rows its predecessor kept, and each result is written to the
shared folder before the next stage reads it.

SQL cannot express the classifier, so ``ORACLE_SQL`` is None; the tests run
the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe_stream, decontam, quality_gbdt, simhash_vp, substring_fm
from folioscope.llm.common import table, written
from folioscope.llm.queries import sha256_of_ids, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    forest = quality_gbdt.train(docs, table(spark, sf_dir, "labels"))
    return quality_gbdt.keep(docs, forest)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that with the smallest id."""
    return simhash_vp.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that begin earlier in the corpus. All
    documents stay; one that is made up of such passages is left empty."""
    kept = substring_fm.without_repeats(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def without_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the text decoded from them."""
    coded = bpe_stream.encode(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        sha256_of_ids(F.col("ids")).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("substrings", without_repeats),
    ("benchmark", without_tests),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
