"""The corpus pipeline: STAGES in order, each a call of one operator.

Every stage function takes (spark, docs, sf_dir) and returns the documents it
keeps with the columns of ``documents``; the last returns the token ids of
every document that is left.  ``run`` writes each stage's rows as Parquet in
the shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm import op02_spaced_seed, op03_surrogates, op04_transducer_bpe, op05_site_bayes, op09_probminhash
from divaug.llm.common import materialize, prepare, table

PII_KEY = "corpus-2024"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    return op05_site_bayes.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return op09_probminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return op02_spaced_seed.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the text."""
    prepare(spark)
    # a column n_entities of the documents is not the operator's
    out = op03_surrogates.replace(docs.withColumnRenamed("n_entities", "__own"), PII_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col("__own").alias(c) if c == "n_entities" else c for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of every document that is left."""
    prepare(spark)
    return op04_transducer_bpe.TransducerTokenizer(op04_transducer_bpe.tokenizer_path()).fit(docs).encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", pii), ("bpe", bpe)]

# Banding, keyed surrogates and byte-pair merges can't be stated in SQL; tests/llm
# holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
