"""Documents to token ids, in five stages.  Each stage reads what the one before wrote.

Every stage but the last returns the columns of documents; n_chars follows the text where a stage changes it.

Defined results: null and empty texts, and texts without a letter, go in the first stage; rows that repeat an id and survive
to the join leave one row; null sources mix as a source of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, language_id, line_dedup, ngram_join, source_mixing
from corvane.llm.common import clear_stored, made, stored
from corvane.llm.queries import BPE_FILE

#: Near-duplicates share this part of their shingles of so many words.
WORDS, THRESHOLD = 5, Fraction(4, 5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells, by dictionaries of the labelled ones."""
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    return language_id.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; documents of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id."""
    found = stored(ngram_join.join(docs.select("doc_id", "text"), WORDS, THRESHOLD))
    gone = stored(found.filter("component_id <> doc_id").select("doc_id").distinct())
    left = docs.join(F.broadcast(gone) if gone.count() <= ngram_join.FEW else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if repeated.take(1):
        once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
        left = left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests that a reader can check them by."""
    out = byte_bpe.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=True)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", delete_repeated_lines),
    ("ngram_join", keep_one_of_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: Compression and byte-pair encoding can't be told in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        clear_stored(spark, before, but=1)  # what led to it, and what the stage before wrote
    return STAGES[-1][1](spark, docs, sf_dir)
