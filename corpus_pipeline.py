"""Training-data pipeline: stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlens.llm import bpe, decontaminate, near_dedup, pseudonyms, quality
from bazarlens.llm.common import read_table
from bazarlens.llm.queries import PSEUDONYM_KEY
from bazarlens.session import materialize, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    release(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    release(spark)
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares four fifths of its five-word shingles, also of rows that repeat an id or have none."""
    release(spark)
    kept = near_dedup.keep_one_each(docs)
    release(spark)
    return kept


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    release(spark)
    clean = decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    release(spark)
    return clean


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms; ``n_chars`` follows the text."""
    release(spark)
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes."""
    release(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # Its workers also serve the other stages, so it remembers less than it would alone.
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, remember=120_000)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("pii", replace_personal_data),
    ("bpe", encode_texts),
]

#: SQL cannot express the classifier, the subword vectors and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what one keeps is written for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
