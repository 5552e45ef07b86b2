"""From raw documents to packed training sequences: filters and masks, then packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as
Parquet below the shared scratch folder and reads it back, so a lost executor costs one stage at most. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.llm import decontaminate, near_dedup, packing, pii, quality_crf
from issuequarry.llm.common import fresh_names, table
from issuequarry.session import checkpointed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words per shingle of the near-duplicate stage: five, as stages on word shingles have unless a contract says otherwise.
SHINGLE = 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line classifier does not reject."""
    model = quality_crf.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh_names(docs, 1)[0]
    return quality_crf.scored(docs, model, score).filter(F.col(score) >= 0.5).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.kept(docs, SHINGLE)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text; the count of characters follows the text."""
    masked = pii.masked(docs, pii.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their token ids; ``packing.sequences`` puts them together."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: The classifier, the tagger and the tokenizer have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
