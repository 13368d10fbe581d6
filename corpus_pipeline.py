"""From raw documents to packed sequences, in five stages.

Every stage calls an operator of ``aeris.llm`` and works on all that the stage
before it kept. All but the last return the columns of their documents; a
stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aeris.llm.common import ship_code, table
from aeris.llm.decontamination import contaminated_removed
from aeris.llm.packing import TOKENIZER, pack
from aeris.llm.pii import redacted
from aeris.llm.simhash import near_duplicates_removed
from aeris.llm.toxicity import toxic_removed
from aeris.session import ensure_checkpoint_dir

#: No SQL counterpart: the first stage learns a classifier.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    ship_code(spark)
    return toxic_removed(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_code(spark)
    return near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    ship_code(spark)
    return contaminated_removed(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts."""
    ship_code(spark)
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens."""
    ship_code(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("personal_data", personal_data),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
