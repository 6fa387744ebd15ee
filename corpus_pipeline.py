"""A corpus pipeline of five stages over `documents`.

Each stage takes the documents that its predecessor kept, as a written table, and returns those that it keeps, with
the columns of `documents`; the last returns token counts and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.line_dedup import line_dedup
from tessera.llm.quality_rules import passing
from tessera.llm.scratch import Scratch
from tessera.llm.sentence_pieces import default_model, encode_digests
from tessera.llm.simhash_dedup import simhash_dedup
from tessera.llm.source_mix import mix_sources

#: Relative weights of the sources in the mix, the weight of all others, and the seed of its draws.
MIX_WEIGHTS, MIX_DEFAULT, MIX_SEED = {"src0": 4.0}, 1.0, 11


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, fitted to all of docs and the labels that cover some."""
    return passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those that lose lines and have no word left go."""
    cut = line_dedup(docs).where(F.expr(r"n_dropped = 0 or rlike(text, '[^\\x20\\x09-\\x0D]')"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: links of at most 15 bits between fingerprints of five-word shingles,
    checked by a shingle similarity of 0.8."""
    return simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, as many as before on average, in a new order."""
    return mix_sources(docs, MIX_WEIGHTS, MIX_DEFAULT, seed=MIX_SEED).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text that they decode to."""
    return encode_digests(docs, default_model())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("source mix", mix),
    ("SentencePiece", encode),
]

#: SQL can express neither the 64-bit hashes of the first three stages nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
