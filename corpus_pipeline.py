"""A corpus pipeline of five stages, each an operator of ``docustrata.llm`` with its production parameters.

Every stage but the last takes and returns the columns of ``documents`` (doc_id, text, lang, source,
n_chars); ``run`` writes what a stage returns and gives the next one what it reads back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm import minhash, packing, quality, secrets, substrings
from docustrata.llm.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade (good and not toxic) reaches the cut stay.

    A null or empty text is graded by its shape; repeated rows are graded alike; with no ratings every document stays; an empty table stays empty.
    """
    model = quality.fit(docs, quality.corpus_ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return quality.grade(docs, model, keep=("text", "lang", "source", "n_chars")).where("kept").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the document with the smallest id stays.

    Rows that repeat an id and a text stay or go together. A null or wordless text is near nothing and stays.
    """
    docs = docs.select(COLUMNS)
    gone = minhash.near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a repeated window of 35 words are cut out of the texts; every document stays. A null text becomes empty."""
    cut = substrings.remove_repeats(docs, 35, keep=("lang", "source"))
    return _documents(cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, those of the fixed patterns and those that the network finds, are replaced by a mark; every document stays. A null text becomes empty."""
    return _documents(secrets.scan(docs, keep=("lang", "source")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, sources in proportion. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substrings", substring_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the first, fourth and fifth stage; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
