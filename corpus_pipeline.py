"""A corpus pipeline: language ID, near-dedup, substring dedup, source mix, packing.

Each stage takes what the one before wrote as Parquet. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import copies, langid, mixing, packing, substrings
from framewright.llm.common import bounded_batches, bounded_rows, materialize

#: A document of at least so many letters that needs so many bits a letter in every language is none of them.
LETTERS, BITS = 64, 5.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected go: texts that are null or have no letter, and those that no learned language tells better than chance."""
    bounded_batches(spark)
    bounded_rows(spark)
    texts = langid.training_text(docs, F.lit(True))
    found = langid.identify(docs, texts)
    strange = (F.col("bits") >= BITS) & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= LETTERS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~strange).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id (null ids last): shingles of 5 words, all pairs of a similarity of 0.8 or more."""
    bounded_batches(spark)
    bounded_rows(spark)
    return copies.one_of_copies(docs, k=5, percent=80).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that an earlier document has go; n_chars follows the text."""
    bounded_batches(spark)
    found = substrings.dedup_substrings(docs, min_words=20)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn."""
    bounded_batches(spark)
    return mixing.apply_mix(docs, mixing.mix(docs, weights=(5, 2, 1), most=3))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; sources weigh 5, 2, 1 in turn in every window."""
    bounded_batches(spark)
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, weights=(5, 2, 1))
    return found.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", known_language), ("simhash_near_dedup", one_of_near_copies), ("substring_dedup", without_repeats), ("source_mix", source_mix), ("packing", packed)]
#: SQL can't express the stages; tests/llm holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
